"""URL and proxy safety (O-U6..O-U11): ordered rule chains as ``when`` expressions, and
private-address labelling as an equi-join on the first octet plus a range filter against a
small fixed range table (no nested-loop join)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagecorpus.functions import urls

# Host names refused as local addresses.
LOCALHOST_HOSTS = ["localhost", "127.0.0.1", "127.0.1.1", "::1", "0.0.0.0", "[::1]", "localhost6"]
# Container-internal host names.
DOCKER_HOSTS = ["host.docker.internal", "gateway.docker.internal", "dockerhost"]
# Cloud metadata host patterns (full match; the names case-insensitive).
METADATA_HOST_RE = r"^((?i:metadata\.google\.internal)|(?i:metadata\.google\.compute)|169\.254\.169\.254)$"
# Schemes a proxy URL may use.
PROXY_SCHEMES = ["http", "https", "socks5"]

# IPv4 blocks that count as private / loopback / link-local / multicast /
# reserved / unspecified (IANA special-purpose registry as Python's ipaddress applies it),
# as (first address, last address, label); 192.0.0.9 and 192.0.0.10 are the registry's
# globally reachable exceptions inside 192.0.0.0/24.
IPV4_BLOCKS = [
    ("0.0.0.0", "0.255.255.255", "this_network"),
    ("10.0.0.0", "10.255.255.255", "private"),
    ("127.0.0.0", "127.255.255.255", "loopback"),
    ("169.254.0.0", "169.254.255.255", "link_local"),
    ("172.16.0.0", "172.31.255.255", "private"),
    ("192.0.0.0", "192.0.0.8", "ietf_protocol"),
    ("192.0.0.11", "192.0.0.255", "ietf_protocol"),
    ("192.0.2.0", "192.0.2.255", "documentation"),
    ("192.168.0.0", "192.168.255.255", "private"),
    ("198.18.0.0", "198.19.255.255", "benchmarking"),
    ("198.51.100.0", "198.51.100.255", "documentation"),
    ("203.0.113.0", "203.0.113.255", "documentation"),
    ("224.0.0.0", "239.255.255.255", "multicast"),
    ("240.0.0.0", "255.255.255.255", "reserved"),
]


def ip_to_long(ip: str) -> int:
    a, b, c, d = (int(x) for x in ip.split("."))
    return (a << 24) | (b << 16) | (c << 8) | d


def ip_blocks(spark: SparkSession) -> DataFrame:
    """The block table expanded to one row per first octet it covers (<= 50 rows)."""
    rows = []
    for lo, hi, label in IPV4_BLOCKS:
        l, h = ip_to_long(lo), ip_to_long(hi)
        for octet in range(l >> 24, (h >> 24) + 1):
            rows.append((octet, l, h, label))
    return spark.createDataFrame(rows, "octet int, lo long, hi long, label string")


def ip_number(ip: Column) -> Column:
    """Dotted IPv4 text to its number; null when it is not a valid dotted quad."""
    parts = F.split(F.trim(ip), r"\.")
    valid = F.trim(ip).rlike(r"^(0|[1-9][0-9]{0,2})(\.(0|[1-9][0-9]{0,2})){3}$")
    nums = [F.try_element_at(parts, F.lit(i)).cast("long") for i in (1, 2, 3, 4)]
    in_range = nums[0] <= 255
    for n in nums[1:]:
        in_range = in_range & (n <= 255)
    return F.when(valid & in_range, nums[0] * 16777216 + nums[1] * 65536 + nums[2] * 256 + nums[3])


def label_addresses(dns: DataFrame, spark: SparkSession) -> DataFrame:
    """O-U8: ``dns(host, ip)`` -> adds ``ip_label`` (null = public) via an equi-join on the
    first octet and a range filter on the (tiny, fixed) block table."""
    d = dns.withColumn("_ipn", ip_number(F.col("ip"))).withColumn("_oct", (F.col("_ipn") / 16777216).cast("int"))
    blocks = F.broadcast(ip_blocks(spark).withColumnRenamed("octet", "_oct"))  # fixed, <= 50 rows
    j = d.join(blocks, "_oct", "left").withColumn(
        "_lab", F.when((F.col("_ipn") >= F.col("lo")) & (F.col("_ipn") <= F.col("hi")), F.col("label")))
    return j.groupBy("host", "ip").agg(F.max("_lab").alias("ip_label"))


#: Prefix of the columns that hold the parts of a URL.
SPLIT = "_sv_"


def split_urls(df: DataFrame, url: str) -> DataFrame:
    """``df`` with the parts of ``url``, to be written once: verdicts and host lookups then read columns."""
    return urls.add_url_parts(df, url, SPLIT)


def url_verdicts(df: DataFrame, url: str, dns_labels: DataFrame | None, allowed: DataFrame | None = None,
                 block_localhost: bool = True, block_private: bool = True) -> DataFrame:
    """O-U6 (+ O-U7 allow-list, O-U8 resolution): first failing rule as ``reason``
    (null = safe).  ``dns_labels(host, ip, ip_label)`` holds every resolved address of a
    host; an absent host is unresolvable.  Rows that carry the parts of their URL already
    (``split_urls``, written) are not split again."""
    p = SPLIT
    d = df if f"{p}hostname" in df.columns else split_urls(df, url)
    host = F.col(f"{p}hostname")
    u = F.col(url)
    if allowed is not None:
        al = allowed.select(urls.strip_www(F.col("domain")).alias("_al")).distinct().withColumn("_in", F.lit(True))
        d = d.withColumn("_nh", urls.strip_www(host)).join(al, F.col("_nh") == F.col("_al"), "left")
        not_allowed = F.col("_in").isNull()
    else:
        not_allowed = F.lit(False)
    if dns_labels is not None and block_private:
        res = dns_labels.groupBy(F.col("host").alias("_dh")).agg(
            F.count(F.lit(1)).alias("_n_ip"), F.max(F.col("ip_label").isNotNull()).alias("_priv"))
        d = d.join(res, host == F.col("_dh"), "left")
        unresolved = F.col("_n_ip").isNull()
        private = F.coalesce(F.col("_priv"), F.lit(False))
    else:
        unresolved = F.lit(False)
        private = F.lit(False)
    reason = (F.when(u.isNull() | (u == ""), F.lit("empty"))
              .when(F.length(u) > 8192, F.lit("too_long"))
              .when(~F.col(f"{p}valid_brackets"), F.lit("parse_error"))
              .when(F.col(f"{p}scheme") == "", F.lit("no_scheme"))
              .when(~F.col(f"{p}scheme").isin("http", "https"), F.lit("bad_scheme"))
              .when(host.isNull(), F.lit("no_host"))
              .when(F.length(host) > 253, F.lit("host_too_long"))
              .when(F.lit(block_localhost) & host.isin(LOCALHOST_HOSTS), F.lit("localhost"))
              .when(F.lit(block_localhost) & host.isin(DOCKER_HOSTS), F.lit("docker_host"))
              .when(host.rlike(METADATA_HOST_RE), F.lit("metadata_host"))
              .when(not_allowed, F.lit("not_allowed"))
              .when(unresolved, F.lit("unresolved"))
              .when(private, F.lit("private_ip")))
    d = d.withColumn("reason", reason)
    return urls.drop_url_parts(d, p).drop(*[c for c in ("_nh", "_al", "_in", "_dh", "_n_ip", "_priv") if c in d.columns])


def proxy_verdicts(df: DataFrame, url: str, dns_labels: DataFrame | None, block_private: bool = True) -> DataFrame:
    """O-U9: proxy URL validation; an unresolvable proxy host is allowed."""
    p = "_pv_"
    d = urls.add_url_parts(df, url, p)
    host = F.col(f"{p}hostname")
    if dns_labels is not None and block_private:
        res = dns_labels.groupBy(F.col("host").alias("_dh")).agg(F.max(F.col("ip_label").isNotNull()).alias("_priv"))
        d = d.join(res, host == F.col("_dh"), "left")
        private = F.coalesce(F.col("_priv"), F.lit(False))
    else:
        private = F.lit(False)
    scheme = F.col(f"{p}scheme")
    u = F.col(url)
    reason = (F.when(u.isNull() | (u == ""), F.lit("empty"))
              .when(~F.col(f"{p}valid_brackets"), F.lit("parse_error"))
              .when(scheme == "", F.lit("no_scheme"))
              .when(scheme == "file", F.lit("file_scheme"))
              .when(~scheme.isin(PROXY_SCHEMES), F.lit("bad_scheme"))
              .when(host.isNull(), F.lit("no_host"))
              .when(F.length(host) > 253, F.lit("host_too_long"))
              .when(host.isin(LOCALHOST_HOSTS) | F.endswith(host, F.lit(".localhost")), F.lit("localhost"))
              .when(private, F.lit("private_ip")))
    d = d.withColumn("proxy_reason", reason)
    return urls.drop_url_parts(d, p).drop(*[c for c in ("_dh", "_priv") if c in d.columns])


def choose_proxy(request_proxy: Column, request_valid: Column, override_allowed: Column,
                 global_proxy: Column) -> tuple[Column, Column]:
    """O-U10: (proxy, error): the request's proxy when overrides are allowed and it is
    valid; a request proxy without permission or an invalid one is an error; else the
    global proxy, else none."""
    has_req = request_proxy.isNotNull() & (request_proxy != "")
    error = (F.when(has_req & ~override_allowed, F.lit("proxy_override_not_allowed"))
             .when(has_req & ~request_valid, F.lit("invalid_proxy")))
    proxy = F.when(error.isNotNull(), F.lit(None).cast("string")).when(has_req, request_proxy).otherwise(global_proxy)
    return proxy, error
