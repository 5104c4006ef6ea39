"""Registered profile / settings queries (O-P1..O-P9, O-M5 auth counters)."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagecorpus.operators import profiles as P
from pagecorpus.plans import sqlbits as S
from pagecorpus.plans.registry import register
from pagecorpus.sources import derived as D
from pagecorpus.sources.tables import read_table

# Configuration layers (fixed configuration rows: layer, section, key, value).
BASE_LAYERS = [
    ("default", "cache", "default_ttl_seconds", "3600"), ("default", "cache", "stale_if_error", "true"),
    ("default", "scraper", "default_mode", "http"), ("default", "scraper", "timeout_seconds", "90"),
    ("default", "scraper", "max_concurrency", "3"), ("default", "security", "block_private_ips", "true"),
    ("default", "jobs", "max_retained", "1000"), ("default", "server", "api_key", "admin-secret"),
    ("file", "scraper", "timeout_seconds", "45"), ("file", "cache", "default_ttl_seconds", "7200"),
    ("env", "scraper", "max_concurrency", "5"),
]
# Profile overrides (client_3 has no profile: it gets the base settings).
PROFILE_OVERRIDES = [
    ("client_1", "scraper", "timeout_seconds", "30"), ("client_1", "cache", "bogus_key", "1"),
    ("client_2", "cache", "default_ttl_seconds", "60"), ("client_2", "security", "block_private_ips", "false"),
    ("client_0", "jobs", "max_retained", "50"),
]
PROFILE_KEYS = [("client_0", "key-client_0"), ("client_1", "key-client_1"), ("client_2", "key-client_2")]


def _base_rows():
    return F.array(*[F.struct(F.lit(s).alias("section"), F.lit(k).alias("key"), F.lit(v).alias("value"),
                              F.lit(P.PRIORITY[layer]).alias("priority")) for layer, s, k, v in BASE_LAYERS])


def _profile_layer(spark):
    ov = spark.createDataFrame(PROFILE_OVERRIDES, "profile string, section string, key string, value string")
    base = spark.createDataFrame([(s, k) for _, s, k, _ in BASE_LAYERS], "section string, key string")
    return P.known_keys_only(ov, base).withColumn("priority", F.lit(P.PRIORITY["profile"]))


def _request_ttl():
    rid = F.col("request_id")
    return (F.when(rid % 3 == 0, F.lit(0)).when(rid % 3 == 1, F.lit(None).cast("int"))
            .otherwise((60 * (rid % 50 + 1)).cast("int")))


def _sql_values(name, cols, rows):
    vals = ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    return f"{name}({', '.join(cols)}) AS (VALUES {vals})"


_LAYER_CTES = ",\n".join([
    _sql_values("base", ["priority", "section", "key", "value"],
                [(P.PRIORITY[layer], s, k, v) for layer, s, k, v in BASE_LAYERS]),
    _sql_values("pov", ["profile", "section", "key", "value"], PROFILE_OVERRIDES),
    "prof AS (SELECT profile, section, key, value, 3 AS priority FROM pov WHERE (section, key) IN (SELECT section, key FROM base))",
])

RESOLVE_SQL = S.with_views(["fetch_log"], """
SELECT request_id, section, key, arg_max(value, priority) AS value FROM (
  SELECT f.request_id, b.section, b.key, b.value, b.priority FROM fetch_log f, base b
  UNION ALL SELECT f.request_id, p.section, p.key, p.value, p.priority FROM fetch_log f JOIN prof p USING (profile)
  UNION ALL SELECT request_id, 'cache', 'default_ttl_seconds', CAST(ttl AS VARCHAR), 4 FROM (
    SELECT request_id, CASE WHEN request_id % 3 = 0 THEN 0 WHEN request_id % 3 = 1 THEN NULL
                            ELSE 60 * (request_id % 50 + 1) END AS ttl FROM fetch_log) WHERE ttl IS NOT NULL AND ttl <> 0)
GROUP BY request_id, section, key""", _LAYER_CTES)


@register("settings_resolution", RESOLVE_SQL)
def q_settings_resolution(spark, sf_dir):
    """O-P1 / O-P2: effective settings per request -- request > profile > env > file > default, unknown
    profile keys ignored, unknown profile = base.  Settings are resolved once per profile; a request
    takes its profile's map and lays its one own key over it, so the log is not shuffled."""
    f = D.fetch_log(spark, sf_dir).select("request_id", "profile", _request_ttl().alias("ttl"))
    layers = _profile_layer(spark)
    base = layers.select("profile").distinct().select("profile", F.inline(_base_rows()))
    per_profile = P.settings_by(base.unionByName(layers.select(*base.columns)), ["profile"])
    fixed = {}
    for _, section, key, value in sorted(BASE_LAYERS, key=lambda r: P.PRIORITY[r[0]]):
        fixed[section, key] = value
    no_profile = F.map_from_entries(F.array(*(F.struct(F.struct(F.lit(s).alias("section"), F.lit(k).alias("key")).alias("k"),
                                                       F.lit(v).alias("value")) for (s, k), v in fixed.items())))
    j = f.join(F.broadcast(per_profile), "profile", "left")  # as many rows as profiles in the fixed override rows
    own = {("cache", "default_ttl_seconds"): F.when(F.col("ttl") != 0, F.col("ttl").cast("string"))}
    return (j.select("request_id", F.explode(P.overlay(F.coalesce("settings", no_profile), own)).alias("k", "value"))
            .select("request_id", "k.section", "k.key", "value"))


SNAPSHOT_ALLOWED = " OR ".join(f"(section = '{s}' AND key = '{k}')" for s, ks in P.SNAPSHOT_FIELDS.items() for k in ks)
SNAPSHOT_SQL = S.with_views(["fetch_log"], f"""
SELECT profile, string_agg(section || '.' || key || '=' || value, ';' ORDER BY section || '.' || key || '=' || value) AS snapshot
FROM (SELECT profile, section, key, arg_max(value, priority) AS value FROM (
        SELECT f.profile, b.section, b.key, b.value, b.priority FROM (SELECT DISTINCT profile FROM fetch_log) f, base b
        UNION ALL SELECT f.profile, p.section, p.key, p.value, p.priority
        FROM (SELECT DISTINCT profile FROM fetch_log) f JOIN prof p USING (profile))
      GROUP BY 1, 2, 3)
WHERE {SNAPSHOT_ALLOWED}
GROUP BY profile""", _LAYER_CTES)


@register("settings_snapshot", SNAPSHOT_SQL)
def q_settings_snapshot(spark, sf_dir):
    """O-P8: per caller, the job snapshot of allowed sections (no server secrets)."""
    f = D.fetch_log(spark, sf_dir).select("profile").distinct()
    base = f.select("profile", F.inline(_base_rows()))
    prof = f.join(F.broadcast(_profile_layer(spark)), "profile").select("profile", "section", "key", "value", "priority")
    return P.snapshot(P.resolve(base.unionByName(prof), ["profile"]), ["profile"])


def _customer_profiles(spark, sf_dir):
    c = read_table(spark, sf_dir, "customer")
    seg = F.col("c_mktsegment")
    return c.select(
        "c_custkey",
        F.when(F.col("c_acctbal") < 0, F.col("c_name")).otherwise(F.concat(F.lit("customer_"), F.col("c_custkey").cast("string"))).alias("name"),
        F.when(F.col("c_acctbal") < 100, F.lit("")).otherwise(F.concat(F.lit("key-"), F.col("c_nationkey").cast("string"), F.lit("-"), F.lower(seg))).alias("key"),
        F.when(seg == "HOUSEHOLD", "scraper").when(seg == "FURNITURE", "cache").when(seg == "MACHINERY", "security")
        .when(seg == "BUILDING", "auth").otherwise("automobile").alias("section"),
        F.concat(F.lit("API_KEY_"), F.col("c_nationkey").cast("string")).alias("key_var"),
        ((seg != "AUTOMOBILE") | (F.col("c_acctbal") > 5000)).alias("enabled"))


CUSTOMER_PROFILES_SQL = """cp AS (
  SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_name ELSE 'customer_' || c_custkey END AS name,
         CASE WHEN c_acctbal < 100 THEN '' ELSE 'key-' || c_nationkey || '-' || lower(c_mktsegment) END AS key,
         CASE c_mktsegment WHEN 'HOUSEHOLD' THEN 'scraper' WHEN 'FURNITURE' THEN 'cache' WHEN 'MACHINERY' THEN 'security'
                           WHEN 'BUILDING' THEN 'auth' ELSE 'automobile' END AS section,
         'API_KEY_' || c_nationkey AS key_var, c_mktsegment <> 'AUTOMOBILE' OR c_acctbal > 5000 AS enabled
  FROM customer),
env AS (SELECT 'API_KEY_' || n_nationkey AS name FROM nation WHERE n_regionkey <> 4)"""


def _rules_sql() -> str:
    safe = ", ".join(f"'{s}'" for s in P.SAFE_SECTIONS)
    forb = ", ".join(f"'{s}'" for s in P.FORBIDDEN_SECTIONS)
    return ("concat_ws(',', CASE WHEN NOT regexp_full_match(name, '[a-zA-Z0-9_-]{1,64}') THEN 'bad_name' END, "
            "CASE WHEN trim(key) = '' THEN 'empty_key' END, "
            f"CASE WHEN section IN ({forb}) THEN 'forbidden_section' END, "
            f"CASE WHEN section NOT IN ({safe}, {forb}) THEN 'unknown_section' END)")


PROFILE_VALIDATION_SQL = f"""WITH {CUSTOMER_PROFILES_SQL}
SELECT c_custkey, {_rules_sql()} AS rules,
       key IN (SELECT key FROM cp GROUP BY key HAVING count(*) > 1) AS dup_key,
       enabled AND key_var IN (SELECT name FROM env) AND {_rules_sql()} = '' AS active
FROM cp"""


@register("profile_validation", PROFILE_VALIDATION_SQL)
def q_profile_validation(spark, sf_dir):
    """O-P4 / O-P5 / O-P6: profile rows derived from customers -- rule codes (name pattern,
    empty key, forbidden / unknown section), duplicated keys, and whether the profile stays
    active (enabled, key variable present in the environment table, no rule broken)."""
    cp = _customer_profiles(spark, sf_dir)
    env = read_table(spark, sf_dir, "nation").filter(F.col("n_regionkey") != 4).select(
        F.concat(F.lit("API_KEY_"), F.col("n_nationkey").cast("string")).alias("key_var"), F.lit(True).alias("_has"))
    dups = P.duplicated(cp, "key").withColumn("dup_key", F.lit(True))
    rules = P.profile_rules(F.col("name"), F.col("key"), F.col("section"))
    out = (cp.withColumn("rules", F.array_join(rules, ","))
           .join(dups, "key", "left").join(F.broadcast(env), "key_var", "left"))  # env: one row per nation
    return out.select("c_custkey", "rules", F.coalesce("dup_key", F.lit(False)).alias("dup_key"),
                      (F.col("enabled") & F.coalesce("_has", F.lit(False)) & (F.col("rules") == "")).alias("active"))


ATTRIB_SQL = S.with_views(["fetch_log"], """
SELECT request_id, CASE WHEN token IS NULL OR token = '' THEN 'missing' WHEN k.profile IS NULL THEN 'invalid' ELSE 'ok' END AS auth,
       k.profile AS profile_name
FROM (SELECT request_id, CASE WHEN request_id % 10 = 0 THEN NULL WHEN request_id % 10 = 1 THEN 'bad-token'
                              ELSE 'key-' || profile END AS token FROM fetch_log) r
LEFT JOIN keys k ON k.h = sha256(r.token)""",
    "keys(profile, h) AS (VALUES " + ", ".join(f"('{p}', sha256('{k}'))" for p, k in PROFILE_KEYS) + ")")


def _attribution(spark, sf_dir):
    rid = F.col("request_id")
    r = D.fetch_log(spark, sf_dir).select("request_id", F.when(rid % 10 == 0, F.lit(None).cast("string"))
                                          .when(rid % 10 == 1, F.lit("bad-token"))
                                          .otherwise(F.concat(F.lit("key-"), F.col("profile"))).alias("token"))
    profs = spark.createDataFrame(PROFILE_KEYS, "name string, key string").select(
        "name", F.sha2("key", 256).alias("key_hash"))
    return P.attribute(r, profs)


@register("request_attribution", ATTRIB_SQL)
def q_request_attribution(spark, sf_dir):
    """O-P7: token hash -> profile; missing / invalid tokens rejected."""
    return _attribution(spark, sf_dir).select("request_id", "auth", "profile_name")


AUTH_COUNTERS_SQL = S.with_views(["fetch_log"], """
SELECT 'auth_requests_total' AS metric, CAST(count(*) FILTER (WHERE auth = 'ok') AS DOUBLE) AS value FROM a
UNION ALL SELECT 'auth_failures_total', CAST(count(*) FILTER (WHERE auth <> 'ok') AS DOUBLE) FROM a""",
    "keys(profile, h) AS (VALUES " + ", ".join(f"('{p}', sha256('{k}'))" for p, k in PROFILE_KEYS) + "),\n"
    + """a AS (SELECT CASE WHEN token IS NULL OR token = '' THEN 'missing' WHEN k.profile IS NULL THEN 'invalid' ELSE 'ok' END AS auth
FROM (SELECT CASE WHEN request_id % 10 = 0 THEN NULL WHEN request_id % 10 = 1 THEN 'bad-token'
                  ELSE 'key-' || profile END AS token FROM fetch_log) r LEFT JOIN keys k ON k.h = sha256(r.token))""")


@register("auth_counters", AUTH_COUNTERS_SQL)
def q_auth_counters(spark, sf_dir):
    """O-M5: authenticated requests and authentication failures."""
    a = _attribution(spark, sf_dir)
    ok = F.col("auth") == "ok"
    return a.agg(F.count(F.when(ok, 1)).cast("double").alias("auth_requests_total"),
                 F.count(F.when(~ok, 1)).cast("double").alias("auth_failures_total")) \
        .selectExpr("stack(2, 'auth_requests_total', auth_requests_total, 'auth_failures_total', auth_failures_total) AS (metric, value)")


DOMAIN_SQL = S.with_views(["fetch_log", "page_keys", "policies"], """
SELECT profile, domain, key, arg_max(value, priority) AS value FROM (
  SELECT x.profile, x.domain, 'min_delay_seconds' AS key, CAST(CAST(p.min_delay_seconds AS DOUBLE) AS VARCHAR) AS value, 1 AS priority
  FROM x JOIN policies p USING (domain)
  UNION ALL SELECT x.profile, x.domain, 'max_concurrent_requests', CAST(p.max_concurrent_requests AS VARCHAR), 1
  FROM x JOIN policies p USING (domain)
  UNION ALL SELECT profile, domain, 'min_delay_seconds', '0.5', 3 FROM x
  WHERE profile = 'client_1' AND length(domain) % 3 = 0)
GROUP BY profile, domain, key""",
    "x AS (SELECT DISTINCT f.profile, k.domain FROM fetch_log f JOIN page_keys k USING (page_id))")


@register("domain_settings", DOMAIN_SQL)
def q_domain_settings(spark, sf_dir):
    """O-P3: per (caller, domain) deep merge of the file's domain policy and the caller's
    domain overrides, for the pairs seen in the fetch log."""
    x = D.fetch_log(spark, sf_dir).join(D.page_keys(spark, sf_dir).select("page_id", "domain"), "page_id") \
        .select("profile", "domain").distinct()
    pol = D.policies(spark, sf_dir)
    fl = x.join(pol, "domain").select(  # policy rows grow with domains: no forced broadcast
        "profile", "domain", F.inline(F.array(
            F.struct(F.lit("min_delay_seconds").alias("key"), F.col("min_delay_seconds").cast("double").cast("string").alias("value")),
            F.struct(F.lit("max_concurrent_requests").alias("key"), F.col("max_concurrent_requests").cast("string").alias("value")))),
        F.lit(1).alias("priority"))
    ov = x.filter((F.col("profile") == "client_1") & (F.length("domain") % 3 == 0)).select(
        "profile", "domain", F.lit("min_delay_seconds").alias("key"), F.lit("0.5").alias("value"), F.lit(3).alias("priority"))
    layers = fl.unionByName(ov)
    return layers.groupBy("profile", "domain", "key").agg(F.max_by("value", "priority").alias("value"))


FLAT_SQL = S.with_views(["fetch_log"], """
SELECT f.profile, b.section, b.key, b.section || '_' || b.key AS name, b.value
FROM (SELECT DISTINCT profile FROM fetch_log) f, base b WHERE b.priority = 1""", _LAYER_CTES)


@register("settings_flatten", FLAT_SQL)
def q_settings_flatten(spark, sf_dir):
    """O-P9: the file layer as nested ``section -> key -> value`` maps per caller, flattened
    to ``section_key`` names."""
    f = D.fetch_log(spark, sf_dir).select("profile").distinct()
    file_rows = [(s, k, v) for layer, s, k, v in BASE_LAYERS if layer == "file"]
    sections = sorted({s for s, _, _ in file_rows})
    nested = F.create_map(*[x for s in sections for x in (
        F.lit(s), F.create_map(*[y for s2, k, v in file_rows if s2 == s for y in (F.lit(k), F.lit(v))]))])
    return P.flatten(f.select("profile", nested.alias("settings"))).select("profile", "section", "key", "name", "value")


@register("profile_duplicates", f"""WITH {CUSTOMER_PROFILES_SQL},
named AS (SELECT *, CASE WHEN c_custkey % 3 = 0 THEN section || '-' || key_var ELSE name END AS profile FROM cp)
SELECT 'name' AS kind, profile AS value, count(*) AS n FROM named GROUP BY profile HAVING count(*) > 1
UNION ALL SELECT 'key', key, count(*) FROM named GROUP BY key HAVING count(*) > 1""")
def q_profile_duplicates(spark, sf_dir):
    """O-P5: profile names and keys that occur more than once (every third profile is named by its section
    and key variable)."""
    cp = _customer_profiles(spark, sf_dir).withColumn("profile", F.when(
        F.col("c_custkey") % 3 == 0, F.concat("section", F.lit("-"), "key_var")).otherwise(F.col("name")))
    pairs = cp.select(F.inline(F.array(F.struct(F.lit("name").alias("kind"), F.col("profile").alias("value")),
                                       F.struct(F.lit("key").alias("kind"), F.col("key").alias("value")))))
    return pairs.groupBy("kind", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@register("snapshot_domains", f"""
SELECT profile, string_agg('domains.' || domain || '.' || key || '=' || value, ';' ORDER BY 'domains.' || domain || '.' || key || '=' || value) AS snapshot
FROM ({DOMAIN_SQL}) GROUP BY profile""")
def q_snapshot_domains(spark, sf_dir):
    """O-P8: the ``domains`` section of each caller's job snapshot: its merged per-domain overrides."""
    entry = F.concat(F.lit("domains."), F.col("domain"), F.lit("."), F.col("key"), F.lit("="), F.col("value"))
    return q_domain_settings(spark, sf_dir).groupBy("profile").agg(
        F.array_join(F.array_sort(F.collect_list(entry)), ";").alias("snapshot"))
