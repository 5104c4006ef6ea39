"""Profiles and layered settings (O-P1..O-P9) in long form ``(scope.., priority, section,
key, value)``: resolution is one ``max_by(value, priority)`` aggregate, never a per-row
merge of nested dictionaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME_PATTERN = r"^[a-zA-Z0-9_-]{1,64}$"
# Sections a profile may override, and sections it must never override.
SAFE_SECTIONS = ["cache", "scraper", "security", "domains", "debug", "browser", "jobs"]
FORBIDDEN_SECTIONS = ["server", "auth", "config_path", "log_level"]
# The settings a job snapshot may carry, per section.
SNAPSHOT_FIELDS = {
    "cache": ["default_ttl_seconds", "stale_if_error", "max_html_size_mb"],
    "scraper": ["default_mode", "timeout_seconds", "max_concurrency", "headless", "user_agent_profile"],
    "security": ["allowed_domains", "block_private_ips", "block_localhost"],
    "debug": ["screenshots", "html_dumps"],
    "browser": ["arguments", "idle_timeout_seconds", "max_uses"],
    "jobs": ["max_concurrency", "max_retained", "result_ttl_seconds"],
}
# Layer priorities: request > profile > environment > file > default.
PRIORITY = {"default": 0, "file": 1, "env": 2, "profile": 3, "request": 4}


def resolve(layers: DataFrame, scope: list[str]) -> DataFrame:
    """O-P1: highest-priority value per ``(scope.., section, key)``."""
    return layers.groupBy(*scope, "section", "key").agg(F.max_by("value", "priority").alias("value"))


def settings_by(layers: DataFrame, scope: list[str]) -> DataFrame:
    """O-P1 / O-P2, once for each scope (a profile, say): its effective settings as one map from
    (section, key) to value."""
    entry = F.struct(F.struct("section", "key").alias("k"), F.col("value"))
    return resolve(layers, scope).groupBy(*scope).agg(F.map_from_entries(F.collect_list(entry)).alias("settings"))


def overlay(settings: Column, own: dict[tuple[str, str], Column]) -> Column:
    """``settings`` with a request's own values in place; a null one leaves the setting as it is."""
    def value(k: Column, v: Column) -> Column:
        for (section, key), mine in own.items():
            v = F.when((k["section"] == section) & (k["key"] == key), F.coalesce(mine, v)).otherwise(v)
        return v
    return F.transform_values(settings, value)


def known_keys_only(overrides: DataFrame, base: DataFrame) -> DataFrame:
    """O-P2: overrides for keys the base settings do not have are ignored."""
    return overrides.join(base.select("section", "key").distinct(), ["section", "key"], "left_semi")


def profile_rules(name: Column, key: Column, section: Column) -> Column:
    """O-P4: validation rule codes (empty array = valid)."""
    codes = F.array(
        F.when(~F.coalesce(name.rlike(NAME_PATTERN), F.lit(False)), F.lit("bad_name")),
        F.when(F.coalesce(F.trim(key), F.lit("")) == "", F.lit("empty_key")),
        F.when(section.isin(FORBIDDEN_SECTIONS), F.lit("forbidden_section")),
        F.when(section.isNotNull() & ~section.isin(SAFE_SECTIONS + FORBIDDEN_SECTIONS), F.lit("unknown_section")))
    return F.filter(codes, lambda c: c.isNotNull())


def duplicated(df: DataFrame, col: str) -> DataFrame:
    """O-P5: values of ``col`` that occur more than once (groupBy + having)."""
    return df.groupBy(col).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1).select(col)


def attribute(requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """O-P7: ``requests(token)`` -> profile by SHA-256 of the token (profiles keep only key
    hashes); no token -> ``missing``, unknown hash -> ``invalid``."""
    hashes = profiles.select(F.col("key_hash").alias("_h"), F.col("name").alias("profile_name"))
    r = requests.withColumn("_h", F.sha2(F.col("token"), 256))
    j = r.join(hashes, "_h", "left")  # the optimizer broadcasts a small profile table
    status = (F.when(F.col("token").isNull() | (F.col("token") == ""), F.lit("missing"))
              .when(F.col("profile_name").isNull(), F.lit("invalid")).otherwise(F.lit("ok")))
    return j.withColumn("auth", status).drop("_h")


def snapshot(resolved: DataFrame, scope: list[str]) -> DataFrame:
    """O-P8: per scope, the allowed sections' settings as ``section.key=value`` entries
    (sorted, ';'-joined) -- secrets and other sections never enter."""
    allowed = [(s, k) for s, ks in SNAPSHOT_FIELDS.items() for k in ks]
    ok = F.lit(False)
    for s, k in allowed:
        ok = ok | ((F.col("section") == s) & (F.col("key") == k))
    entries = resolved.filter(ok).select(*scope, F.concat_ws("", "section", F.lit("."), "key", F.lit("="), "value").alias("e"))
    return entries.groupBy(*scope).agg(F.array_join(F.array_sort(F.collect_list("e")), ";").alias("snapshot"))


def flatten(nested: DataFrame, col: str = "settings") -> DataFrame:
    """O-P9: ``map<section, map<key, value>>`` to ``(section, key, name, value)`` rows with
    the flat ``section_key`` names."""
    s = nested.select("*", F.explode(col).alias("section", "_kv")).drop(col)
    k = s.select("*", F.explode("_kv").alias("key", "value")).drop("_kv")
    return k.withColumn("name", F.concat_ws("_", "section", "key"))
