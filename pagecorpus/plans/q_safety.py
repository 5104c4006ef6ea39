"""Registered safety and labelling queries (O-U6..O-U11, O-L1..O-L4, O-V9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.functions import urls
from pagecorpus.operators import label as L
from pagecorpus.operators import safety as SF
from pagecorpus.plans import q_store  # noqa: F401  (its twins come first)
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.registry import ORACLES, register
from pagecorpus.session import materialize
from pagecorpus.sources import derived as D
from pagecorpus.sources.corpus import nodes_table
from pagecorpus.sources.tables import read_table

GLOBAL_PROXY = "http://gw.example.net:3128"
# Variants of every page URL (derived rows exercising each safety rule).
VARIANTS = [
    ("original", None, None),
    ("ftp", r"^https?", "ftp"),
    ("localhost", r"^(https?://)[^/?#]+", "localhost:8080"),
    ("metadata", r"^(https?://)[^/?#]+", "169.254.169.254"),
    ("docker", r"^(https?://)[^/?#]+", "host.docker.internal"),
    ("noscheme", r"^https?://", ""),
    ("private_ip", r"^(https?://)[^/?#]+", "10.0.0.7"),
]


def _variants(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select("page_id", "url")
    out = None
    for name, pat, rep in VARIANTS:
        if pat is None:
            u = F.col("url")
        elif pat.startswith("^(https?://)"):
            u = F.regexp_replace("url", pat, "$1" + rep)
        else:
            u = F.regexp_replace("url", pat, rep)
        df = p.select("page_id", F.lit(name).alias("variant"), u.alias("url"))
        out = df if out is None else out.unionByName(df)
    return out


def _variants_sql() -> str:
    parts = []
    for name, pat, rep in VARIANTS:
        if pat is None:
            u = "url"
        elif pat.startswith("^(https?://)"):
            u = f"regexp_replace(url, '{pat}', '\\1{rep}')"
        else:
            u = f"regexp_replace(url, '{pat}', '{rep}')"
        parts.append(f"SELECT page_id, '{name}' AS variant, {u} AS url FROM pages")
    return "variants AS (" + " UNION ALL ".join(parts) + ")"


def _dns(spark, sf_dir, hosts_df):
    """Resolved addresses: one per crawled host by a rule on its length (some private,
    every seventh length unresolvable); IPv4 literals resolve to themselves.  ``hosts_df`` and the
    pages' hosts are written columns, so no URL is split here."""
    h = F.length("host")
    hosts = (D.page_hosts(spark, sf_dir).select("host")
             .unionByName(D.page_keys(spark, sf_dir).select(F.col("domain").alias("host"))).distinct())
    named = hosts.filter(h % 7 != 0).select(
        "host", F.when(h % 5 == 0, F.concat(F.lit("10.1."), h.cast("string"), F.lit(".7")))
        .when(h % 5 == 1, F.concat(F.lit("192.168."), h.cast("string"), F.lit(".1")))
        .when(h % 5 == 2, F.concat(F.lit("127.0.0."), h.cast("string")))
        .otherwise(F.concat(F.lit("93.184."), h.cast("string"), F.lit(".34"))).alias("ip"))
    literal = hosts_df.filter(SF.ip_number(F.col("host")).isNotNull()).select("host", F.col("host").alias("ip")).distinct()
    # one row per resolved host: written once, so later joins read a small table
    return materialize(SF.label_addresses(named.unionByName(literal).distinct(), spark), "dns")


def _blocks_sql() -> str:
    rows = []
    for lo, hi, label in SF.IPV4_BLOCKS:
        rows.append(f"({SF.ip_to_long(lo)}, {SF.ip_to_long(hi)}, '{label}')")
    return "blocks(lo, hi, label) AS (VALUES " + ", ".join(rows) + ")"


def _ipnum_sql(e: str) -> str:
    parts = f"string_split({e}, '.')"
    return (f"(CASE WHEN regexp_full_match({e}, '(0|[1-9][0-9]{{0,2}})(\\.(0|[1-9][0-9]{{0,2}})){{3}}') "
            f"AND CAST({parts}[1] AS BIGINT) <= 255 AND CAST({parts}[2] AS BIGINT) <= 255 "
            f"AND CAST({parts}[3] AS BIGINT) <= 255 AND CAST({parts}[4] AS BIGINT) <= 255 THEN "
            f"CAST({parts}[1] AS BIGINT) * 16777216 + CAST({parts}[2] AS BIGINT) * 65536 + "
            f"CAST({parts}[3] AS BIGINT) * 256 + CAST({parts}[4] AS BIGINT) END)")


DNS_SQL = ("""hosts AS (
  SELECT DISTINCT host FROM (SELECT hostname AS host FROM (""" + S.url_sql("SELECT url FROM pages", "url", keys=False) + """)
                             UNION ALL SELECT domain FROM page_keys)),
dns0 AS (
  SELECT host, CASE length(host) % 5 WHEN 0 THEN '10.1.' || length(host) || '.7'
                                     WHEN 1 THEN '192.168.' || length(host) || '.1'
                                     WHEN 2 THEN '127.0.0.' || length(host)
                                     ELSE '93.184.' || length(host) || '.34' END AS ip
  FROM hosts WHERE length(host) % 7 <> 0
  UNION SELECT DISTINCT host, host FROM lits WHERE """ + _ipnum_sql("host") + """ IS NOT NULL),
""" + _blocks_sql() + """,
dns AS (SELECT d.host, d.ip, max(b.label) AS ip_label FROM dns0 d LEFT JOIN blocks b
        ON """ + _ipnum_sql("d.ip") + """ BETWEEN b.lo AND b.hi GROUP BY d.host, d.ip),
res AS (SELECT host, count(*) AS n_ip, bool_or(ip_label IS NOT NULL) AS priv FROM dns GROUP BY host)""")


VERDICT_SQL = S.with_views(["page_keys", "policies"], """
SELECT page_id, variant,
  CASE WHEN url IS NULL OR url = '' THEN 'empty' WHEN length(url) > 8192 THEN 'too_long'
       WHEN NOT valid_brackets THEN 'parse_error' WHEN scheme = '' THEN 'no_scheme'
       WHEN scheme NOT IN ('http', 'https') THEN 'bad_scheme' WHEN hostname IS NULL THEN 'no_host'
       WHEN length(hostname) > 253 THEN 'host_too_long'
       WHEN hostname IN ('localhost', '127.0.0.1', '127.0.1.1', '::1', '0.0.0.0', '[::1]', 'localhost6') THEN 'localhost'
       WHEN hostname IN ('host.docker.internal', 'gateway.docker.internal', 'dockerhost') THEN 'docker_host'
       WHEN regexp_full_match(hostname, '(?i:metadata\\.google\\.internal)|(?i:metadata\\.google\\.compute)|169\\.254\\.169\\.254') THEN 'metadata_host'
       WHEN al.d IS NULL THEN 'not_allowed'
       WHEN r.host IS NULL THEN 'unresolved' WHEN r.priv THEN 'private_ip' END AS reason
FROM (""" + S.url_sql("SELECT * FROM variants", "url", keys=False) + """) v
LEFT JOIN (SELECT DISTINCT regexp_replace(domain, '^www\\.', '') AS d FROM policies) al
  ON al.d = regexp_replace(v.hostname, '^www\\.', '')
LEFT JOIN res r ON r.host = v.hostname""", _variants_sql() + ",\nlits AS (SELECT hostname AS host FROM ("
    + S.url_sql("SELECT url FROM variants", "url", keys=False) + ")),\n" + DNS_SQL)


@register("url_safety", VERDICT_SQL)
def q_url_safety(spark, sf_dir):
    """O-U6 / O-U7 / O-U8: safety verdict (first failing rule) for every page URL and six
    derived variants; the policy domains are the allow-list; private resolution is an
    equi-join on the first octet against the fixed block table."""
    v = materialize(SF.split_urls(_variants(spark, sf_dir), "url"), "variants")  # split once
    dns = _dns(spark, sf_dir, v.select(F.col(f"{SF.SPLIT}hostname").alias("host")))
    allowed = D.policies(spark, sf_dir).select("domain")
    return SF.url_verdicts(v, "url", dns, allowed).select("page_id", "variant", "reason")


def _proxies(spark, sf_dir):
    d = D.page_keys(spark, sf_dir).select("domain").distinct()
    n = F.length("domain") % 5
    return d.select("domain", F.when(n == 0, F.concat(F.lit("http://proxy."), F.col("domain"), F.lit(":3128")))
                    .when(n == 1, F.concat(F.lit("socks5://u"), F.length("domain").cast("string"), F.lit(":pw@"), F.col("domain")))
                    .when(n == 2, F.concat(F.lit("ftp://"), F.col("domain")))
                    .when(n == 3, F.lit("http://localhost:8080"))
                    .otherwise(F.concat(F.lit("https://proxy.localhost"))).alias("proxy_url"))


PROXIES_SQL = """proxies AS (
  SELECT domain, CASE length(domain) % 5 WHEN 0 THEN 'http://proxy.' || domain || ':3128'
                   WHEN 1 THEN 'socks5://u' || length(domain) || ':pw@' || domain
                   WHEN 2 THEN 'ftp://' || domain WHEN 3 THEN 'http://localhost:8080'
                   ELSE 'https://proxy.localhost' END AS proxy_url
  FROM (SELECT DISTINCT domain FROM page_keys))"""
PROXY_VERDICT_SQL = S.with_views(["page_keys"], """
SELECT domain, proxy_url,
  CASE WHEN proxy_url IS NULL OR proxy_url = '' THEN 'empty' WHEN NOT valid_brackets THEN 'parse_error'
       WHEN scheme = '' THEN 'no_scheme' WHEN scheme = 'file' THEN 'file_scheme'
       WHEN scheme NOT IN ('http', 'https', 'socks5') THEN 'bad_scheme' WHEN hostname IS NULL THEN 'no_host'
       WHEN length(hostname) > 253 THEN 'host_too_long'
       WHEN hostname IN ('localhost', '127.0.0.1', '127.0.1.1', '::1', '0.0.0.0', '[::1]', 'localhost6')
            OR ends_with(hostname, '.localhost') THEN 'localhost'
       WHEN coalesce(r.priv, false) THEN 'private_ip' END AS proxy_reason,
  CASE WHEN userinfo IS NULL THEN proxy_url
       ELSE scheme || '://***:***@' || coalesce(hostname, '') || CASE WHEN port >= 0 THEN ':' || port ELSE '' END
            || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS redacted
FROM (""" + S.url_sql("SELECT * FROM proxies", "proxy_url", keys=False) + """) v
LEFT JOIN res r ON r.host = v.hostname""", PROXIES_SQL + ",\nlits AS (SELECT hostname AS host FROM ("
    + S.url_sql("SELECT proxy_url FROM proxies", "proxy_url", keys=False) + ")),\n" + DNS_SQL)


def _proxy_table(spark, sf_dir):
    px = _proxies(spark, sf_dir)
    hosts = urls.add_url_parts(px.select("proxy_url"), "proxy_url").select(F.col("hostname").alias("host"))
    dns = _dns(spark, sf_dir, materialize(hosts, "proxy_hosts"))
    out = SF.proxy_verdicts(px, "proxy_url", dns)
    return materialize(urls.add_redacted(out, "proxy_url", "redacted"), "proxies")  # one row per domain


@register("proxy_validation", PROXY_VERDICT_SQL)
def q_proxy_validation(spark, sf_dir):
    """O-U9 / O-U11: proxy URL verdicts (unresolvable hosts allowed) and redacted forms."""
    return _proxy_table(spark, sf_dir).select("domain", "proxy_url", "proxy_reason", "redacted")


def _choice_sql() -> str:
    body = PROXY_VERDICT_SQL[PROXY_VERDICT_SQL.index("\nSELECT domain, proxy_url,"):]
    ctes = PROXY_VERDICT_SQL[len("WITH "):PROXY_VERDICT_SQL.index("\nSELECT domain, proxy_url,")]
    return (f"WITH {ctes},\npv AS ({body}),\nfl AS ({S.DERIVED['fetch_log']})\n"
            f"""SELECT request_id,
  CASE WHEN has_req AND NOT allowed THEN NULL WHEN has_req AND NOT valid THEN NULL
       WHEN has_req THEN redacted ELSE '{GLOBAL_PROXY}' END AS proxy,
  CASE WHEN has_req AND NOT allowed THEN 'proxy_override_not_allowed'
       WHEN has_req AND NOT valid THEN 'invalid_proxy' END AS proxy_error
FROM (SELECT f.request_id, f.request_id % 4 = 0 AS has_req, f.profile IN ('client_1', 'client_2') AS allowed,
             pv.proxy_reason IS NULL AS valid, pv.redacted
      FROM fl f JOIN page_keys k USING (page_id) JOIN pv ON pv.domain = k.domain)""")


@register("proxy_choice", _choice_sql())
def q_proxy_choice(spark, sf_dir):
    """O-U10 / O-M5: per request: its own proxy when overrides are allowed for the caller
    and the proxy is valid, else an error; without one, the global proxy (shown redacted)."""
    px = _proxy_table(spark, sf_dir).select("domain", F.col("proxy_reason").isNull().alias("valid"), "redacted")
    f = D.fetch_log(spark, sf_dir).join(D.page_keys(spark, sf_dir).select("page_id", "domain"), "page_id")
    j = f.join(px, "domain")
    has = F.col("request_id") % 4 == 0
    proxy, error = SF.choose_proxy(F.when(has, F.col("redacted")), F.col("valid"),
                                   F.col("profile").isin("client_1", "client_2"), F.lit(GLOBAL_PROXY))
    return j.select("request_id", proxy.alias("proxy"), error.alias("proxy_error"))


def _page_labels(spark, sf_dir):
    p = read_table(spark, sf_dir, "pages").select("page_id", "html")
    return p.select("page_id", L.page_block_rule(F.col("html")).alias("page_rule"))


def _labels(spark, sf_dir):
    f = D.fetch_log(spark, sf_dir)
    j = f.join(_page_labels(spark, sf_dir), "page_id")
    rule = L.block_rule(F.col("status_code"), F.col("page_rule"))
    return j.withColumn("rule", rule).withColumn("blocked", F.col("rule").isNotNull())


def _marker_sql(e: str, markers) -> str:
    out = "NULL"
    for m in reversed(markers):
        out = f"CASE WHEN contains({e}, '{m}') THEN '{m}' ELSE {out} END"
    return out


LABELS_CTE = f"""lab AS (
  SELECT f.*, k.domain, CASE WHEN f.status_code IN (403, 429, 503, 444) THEN 'status'
         WHEN length({S.py_strip('p.html')}) < 500 THEN 'too_short'
         WHEN {_marker_sql('lower(p.html)', L.BLOCK_MARKERS)} IS NOT NULL
         THEN 'marker:' || {_marker_sql('lower(p.html)', L.BLOCK_MARKERS)} END AS rule
  FROM fetch_log f JOIN pages p USING (page_id) JOIN page_keys k USING (page_id))"""


@register("block_labels", S.with_views(["fetch_log", "page_keys"], """
SELECT request_id, rule IS NOT NULL AS blocked, rule FROM lab""", LABELS_CTE))
def q_block_labels(spark, sf_dir):
    """O-L1: block-page label of every fetch result and the rule that fired.  Page-level
    parts (stripped length, markers) are computed once per page, then joined by page id."""
    return _labels(spark, sf_dir).select("request_id", "blocked", "rule")


CHALLENGE_SQL = f"""
SELECT page_id, coalesce({_marker_sql(f"lower(coalesce({S.py_strip(S.unescape(chr(39) + chr(39) + ' || t'))}, ''))", L.CHALLENGE_MARKERS)},
                         {_marker_sql('lower(html)', L.CHALLENGE_MARKERS)}) AS challenge_marker
FROM (SELECT page_id, html, regexp_extract(regexp_replace(html, '(?si)<(script|style)\\b[^>]*>.*?</(script|style)\\s*>', ' ', 'g'),
                                          '(?si)<title\\b[^>]*>(.*?)</title', 1) AS t FROM pages)"""


@register("challenge_labels", CHALLENGE_SQL)
def q_challenge_labels(spark, sf_dir):
    """O-L2: challenge marker found in the page title first, else in the whole page."""
    from pagecorpus.operators.extract import extract
    title = extract(nodes_table(spark, sf_dir), {"title": {"selector": "title"}}).select("page_id", "extracted.title")
    p = read_table(spark, sf_dir, "pages").select("page_id", "html").join(title, "page_id", "left")
    return p.select("page_id", L.challenge_label(F.col("title"), F.col("html")).alias("challenge_marker"))


@register("auto_routing", S.with_views(["fetch_log", "page_keys"], """
SELECT request_id, CASE WHEN NOT (failed OR rule IS NOT NULL) THEN 'http'
                        WHEN request_id % 3 <> 0 THEN 'browser'
                        WHEN failed THEN 'http_error' ELSE 'browser_error' END AS route
FROM lab WHERE mode = 'auto'""", LABELS_CTE))
def q_auto_routing(spark, sf_dir):
    """O-L3: auto mode -- HTTP unless failed or blocked, then the browser result (which
    fails for every third request id); both failing keeps the HTTP error."""
    http = _labels(spark, sf_dir).filter(F.col("mode") == "auto")
    browser = http.select("request_id", (F.col("request_id") % 3 == 0).alias("b_failed"))
    return L.route_auto(http, browser).select("request_id", "route")


@register("label_rates", S.with_views(["fetch_log", "page_keys"], """
SELECT domain, mode, count(*) AS n, avg(CASE WHEN rule IS NOT NULL THEN 1.0 ELSE 0.0 END) AS blocked_rate
FROM lab GROUP BY domain, mode""", LABELS_CTE))
def q_label_rates(spark, sf_dir):
    """O-L4: blocked share by domain and mode."""
    lab = _labels(spark, sf_dir).join(D.page_keys(spark, sf_dir).select("page_id", "domain"), "page_id")
    return L.label_rates(lab, ["domain", "mode"])


# Error type -> HTTP status.
ERROR_STATUS = [("validation_error", 400), ("security_error", 403), ("timeout_error", 504),
                ("blocked_error", 403), ("http_error", 502), ("browser_error", 502), ("cache_error", 500),
                ("internal_error", 500)]


@register("error_status", S.with_views(["fetch_log", "page_keys"], """
SELECT request_id, error_type, e.status AS http_status
FROM (SELECT request_id, CASE WHEN failed THEN 'http_error' WHEN rule IS NOT NULL THEN 'blocked_error' END AS error_type
      FROM lab) x JOIN errs e ON e.t = x.error_type""",
    LABELS_CTE + ",\nerrs(t, status) AS (VALUES " + ", ".join(f"('{t}', {s})" for t, s in ERROR_STATUS) + ")"))
def q_error_status(spark, sf_dir):
    """O-V9: error rows mapped to their HTTP status through the error dimension (a fixed
    eight-row table, broadcast)."""
    errs = F.broadcast(spark.createDataFrame(ERROR_STATUS, "error_type string, http_status int"))
    lab = _labels(spark, sf_dir).select("request_id", F.when(F.col("failed"), F.lit("http_error"))
                                        .when(F.col("blocked"), F.lit("blocked_error")).alias("error_type"))
    return lab.join(errs, "error_type").select("request_id", "error_type", "http_status")


def _fetched_choices(spark, sf_dir):
    """Proxy choices with the store lookup's outcome: a request answered by the store is not routed."""
    from pagecorpus.plans.q_store import q_store_lookup
    return q_proxy_choice(spark, sf_dir).join(q_store_lookup(spark, sf_dir).select("request_id", "outcome"), "request_id")


def proxy_counters_sql() -> str:
    return f"""
SELECT metric, CAST(value AS DOUBLE) AS value FROM (
  SELECT unnest(['proxy_requests_total', 'proxy_errors_total']) AS metric,
         unnest([count(proxy) FILTER (WHERE outcome <> 'hit'), count(proxy_error)]) AS value
  FROM ({_choice_sql()}) c JOIN ({ORACLES['store_lookup']}) l USING (request_id))"""


@register("proxy_counters", proxy_counters_sql())
def q_proxy_counters(spark, sf_dir):
    """O-M5: requests routed through a proxy (those that the store did not answer) and proxy errors."""
    wide = _fetched_choices(spark, sf_dir).agg(
        F.count(F.when(F.col("outcome") != "hit", F.col("proxy"))).cast("double").alias("proxy_requests_total"),
        F.count("proxy_error").cast("double").alias("proxy_errors_total"))
    return wide.selectExpr("stack(2, 'proxy_requests_total', proxy_requests_total, 'proxy_errors_total', "
                           "proxy_errors_total) AS (metric, value)")
