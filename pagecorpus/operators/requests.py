"""The full request schema (O-S3) and its rules (O-V1, O-V2, O-V3): read, fill defaults, accept or reject.

Requests are JSON lines read with a fixed nested schema.  A line that does not parse, or holds a value of
another type, is rejected whole as ``malformed``.  All other rules are codes with the path of the value that
breaks them, so one request gives as many rejection rows as it breaks rules.  Field specs nest: the schema
holds ``DEPTH`` levels of ``extract.fields``, and a deeper one is rejected by its path.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagecorpus.operators.clean import FEATURES, PRESETS
from pagecorpus.operators.validate import MODES

#: Levels of nested extraction fields that a request may have.
DEPTH = 3
MALFORMED = "_malformed"
# Wait strategies, field types, bounds and defaults of the request fields.
WAITS = ["load", "domcontentloaded", "networkidle", "networkidle0"]
FIELD_TYPES = ["text", "html", "attr", "object"]
BOUNDS = {"cache_ttl_seconds": (60, 2592000), "timeout_seconds": (5, 180), "scroll.max_scrolls": (1, 100), "scroll.delay_ms": (100, 30000)}
BATCH_BOUNDS = {"items": (1, 50), "max_concurrency": (1, 10)}
MAX_URL, MAX_SELECTOR = 8192, 500
DEFAULTS = {"mode": "auto", "force_refresh": False, "wait_until": "networkidle", "timeout_seconds": 90,
            "proxy.enabled": False, "scroll.enabled": False, "scroll.max_scrolls": 5, "scroll.delay_ms": 1000,
            "scroll.stop_when_no_growth": True, "debug.screenshot": False, "debug.html_dump": False,
            "normalize.enabled": False, "extract.enabled": False}


def _struct(**kinds) -> T.StructType:
    return T.StructType([T.StructField(n, k) for n, k in kinds.items()])


_S, _B, _I, _L = T.StringType(), T.BooleanType(), T.IntegerType(), T.LongType()


def field_schema(depth: int = DEPTH) -> T.StructType:
    """One extraction field; ``fields`` below the last level is kept as text, to be rejected."""
    below = T.MapType(_S, field_schema(depth - 1)) if depth > 1 else _S
    return _struct(selector=_S, type=_S, attribute=_S, multiple=_B, default=_S, required=_B, absolute_url=_B, fields=below)


REQUEST = _struct(
    request_id=_L, url=_S, mode=_S, cache_ttl_seconds=_I, force_refresh=_B, wait_until=_S, wait_selector=_S, timeout_seconds=_I,
    proxy=_struct(enabled=_B, url=_S, country=_S),
    scroll=_struct(enabled=_B, max_scrolls=_I, delay_ms=_I, stop_when_no_growth=_B),
    debug=_struct(screenshot=_B, html_dump=_B),
    normalize=_struct(enabled=_B, preset=_S, **{f: _B for f in FEATURES}),
    extract=_struct(enabled=_B, base_url=_S, fields=T.MapType(_S, field_schema())))


def read_requests(spark: SparkSession, path: str) -> DataFrame:
    """Single requests; ``MALFORMED`` holds the line of one that does not fit the schema.

    Lines are parsed by ``from_json``: the JSON reader would check only the columns that a query uses."""
    schema = T.StructType([*REQUEST.fields, T.StructField(MALFORMED, _S)])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": MALFORMED}
    return spark.read.text(path).select(F.from_json("value", schema, options).alias("r")).select("r.*")


def _broken(path: Column | str, code: str, when: Column) -> Column:
    path = F.lit(path) if isinstance(path, str) else path
    return F.when(when, F.struct(path.alias("path"), F.lit(code).alias("code")))


def _field_rules(fields: Column, path: Column, depth: int) -> Column:
    """Broken rules of a map of extraction fields and of the fields below, as an array."""
    none = F.array().cast("array<struct<path:string,code:string>>")

    def one(entry: Column) -> Column:
        f, at = entry["value"], F.concat(path, F.lit("."), entry["key"])
        own = F.array(_broken(F.concat(at, F.lit(".selector")), "missing", f["selector"].isNull()),
                      _broken(F.concat(at, F.lit(".type")), "enum", f["type"].isNotNull() & ~f["type"].isin(FIELD_TYPES)))
        below = F.concat(at, F.lit(".fields"))
        if depth > 1:
            return F.concat(own, _field_rules(f["fields"], below, depth - 1))
        return F.concat(own, F.array(_broken(below, "depth", f["fields"].isNotNull())))

    return F.coalesce(F.flatten(F.transform(F.map_entries(fields), one)), none)


def broken_rules(cross_field: bool = True) -> Column:
    """All broken rules of a request as an array of (path, code); a missing value with a default breaks none.
    Batch items skip the cross-field rule."""
    col = F.col
    rules = [_broken("url", "missing", col("url").isNull()),
             _broken("url", "length", ~F.length("url").between(1, MAX_URL))]
    rules += [_broken(p, "enum", ~col(p).isin(allowed)) for p, allowed in
              (("mode", MODES), ("wait_until", WAITS), ("normalize.preset", list(PRESETS)))]
    rules += [_broken(p, "range", ~col(p).between(lo, hi)) for p, (lo, hi) in BOUNDS.items()]
    rules.append(_broken("wait_selector", "length", F.length("wait_selector") > MAX_SELECTOR))
    if cross_field:
        # the default timeout counts as given: a browser request without one breaks the rule
        timeout = F.coalesce(col("timeout_seconds"), F.lit(DEFAULTS["timeout_seconds"]))
        rules.append(_broken("timeout_seconds", "browser_over_60", (col("mode") == "browser") & (timeout > 60)))
    nested = _field_rules(col("extract.fields"), F.lit("extract.fields"), DEPTH)
    return F.filter(F.concat(F.array(*rules), nested), lambda r: r.isNotNull())


def with_defaults(requests: DataFrame) -> DataFrame:
    """Missing values replaced by their defaults, missing sections by their defaults throughout."""
    def filled(kind: T.StructType, path: str) -> list[Column]:
        out = []
        for f in kind.fields:
            at = f"{path}{f.name}"
            if isinstance(f.dataType, T.StructType):
                out.append(F.struct(*filled(f.dataType, at + ".")).alias(f.name))
                continue
            value = F.col(at)
            default = DEFAULTS.get(at, False if path == "normalize." and f.name in FEATURES else None)
            if default is not None:
                value = F.coalesce(value, F.lit(default))
            if at == "extract.fields":
                value = F.coalesce(value, F.map_from_arrays(F.array(), F.array()).cast(f.dataType))
            out.append(value.alias(f.name))
        return out
    return requests.select(*filled(REQUEST, ""))


def accepted(requests: DataFrame, cross_field: bool = True) -> DataFrame:
    """Requests that break no rule, with defaults."""
    return with_defaults(requests.where(F.col(MALFORMED).isNull() & (F.size(broken_rules(cross_field)) == 0)))


def rejected(requests: DataFrame, cross_field: bool = True) -> DataFrame:
    """Rows (request_id, path, code, line): one for each broken rule; malformed ones with their line."""
    bad = F.col(MALFORMED).isNotNull()
    whole = F.array(F.struct(F.lit("$").alias("path"), F.lit("malformed").alias("code")))
    named = F.coalesce("request_id", F.expr(f"try_cast(regexp_extract({MALFORMED}, '\"request_id\":([0-9]+)', 1) as bigint)"))
    return (requests.select(named.alias("request_id"), F.col(MALFORMED).alias("line"), F.when(bad, whole).otherwise(broken_rules(cross_field)).alias("rules"))
            .select("request_id", F.explode("rules").alias("r"), "line").select("request_id", "r.path", "r.code", "line"))
