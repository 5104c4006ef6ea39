"""URL safety verdicts on literal pairs of URL and expected reason, plus block labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators import label as L
from pagecorpus.operators import safety as SF

VERDICTS = [
    ("", "empty"), ("x" * 9000, "too_long"), ("example.com/no-scheme", "no_scheme"),
    ("ftp://example.com/", "bad_scheme"), ("file:///etc/passwd", "bad_scheme"), ("http:///path", "no_host"),
    ("http://localhost:8080/", "localhost"), ("http://127.0.0.1/", "localhost"), ("http://0.0.0.0/", "localhost"),
    ("http://[::1]/", "localhost"), ("http://host.docker.internal/", "docker_host"),
    ("http://metadata.google.internal/", "metadata_host"), ("http://169.254.169.254/", "metadata_host"),
    ("http://unknown.example.com/", "not_allowed"), ("http://lost.example.com/", "unresolved"),
    ("http://private.example.com/", "private_ip"), ("http://10.1.2.3/", "private_ip"), ("http://224.0.0.1/", "private_ip"),
    ("http://user:pw@good.example.com/", None), ("HTTP://GOOD.EXAMPLE.COM/", None), ("http://www.good.example.com/", None),
    ("http://192.0.0.9/", None), ("http://100.64.0.1/", None),
]
DNS = [("good.example.com", "93.184.216.34"), ("www.good.example.com", "93.184.216.34"),
       ("private.example.com", "93.184.216.34"), ("private.example.com", "192.168.1.5"),
       ("10.1.2.3", "10.1.2.3"), ("192.0.0.9", "192.0.0.9"), ("100.64.0.1", "100.64.0.1"),
       ("224.0.0.1", "224.0.0.1")]
ALLOWED = ["good.example.com", "private.example.com", "lost.example.com", "10.1.2.3", "192.0.0.9", "100.64.0.1", "224.0.0.1"]


def test_url_verdicts(spark):
    df = spark.createDataFrame([(i, u) for i, (u, _) in enumerate(VERDICTS)], "i int, url string")
    dns = SF.label_addresses(spark.createDataFrame(DNS, "host string, ip string"), spark)
    allowed = spark.createDataFrame([(d,) for d in ALLOWED], "domain string")
    got = {r.i: r.reason for r in SF.url_verdicts(df, "url", dns, allowed).collect()}
    assert [(u, got[i]) for i, (u, _) in enumerate(VERDICTS)] == VERDICTS


def test_block_labels(spark):
    long_ok = "<html>" + "content " * 100 + "</html>"
    rows = [(1, 403, long_ok), (2, 200, "<p>short</p>"), (3, 200, long_ok + "Please complete the security check"),
            (4, 200, long_ok), (5, 444, long_ok)]
    df = spark.createDataFrame(rows, "id int, status int, html string")
    blocked, rule = L.block_label(F.col("status"), F.col("html"))
    got = {r.id: r.rule for r in df.select("id", rule.alias("rule")).collect()}
    assert got == {1: "status", 2: "too_short", 3: "marker:please complete the security check", 4: None, 5: "status"}
