"""Sources and sinks beyond plain parquet: request JSON (O-S3), response JSON (O-S6), the
HTML dump (O-S5) and the store compaction report (O-C18)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

REQUEST_ITEM = T.StructType([T.StructField("request_id", T.LongType()), T.StructField("url", T.StringType()),
                             T.StructField("mode", T.StringType())])
BATCH_REQUEST = T.StructType([T.StructField("batch_id", T.LongType()),
                              T.StructField("items", T.ArrayType(REQUEST_ITEM)),
                              T.StructField("max_concurrency", T.IntegerType())])


def dump_name(url: Column) -> Column:
    """``://``, ``/`` and ``?`` become ``_``; first 100 characters; ``.html`` appended."""
    safe = F.replace(F.replace(F.replace(url, F.lit("://"), F.lit("_")), F.lit("/"), F.lit("_")), F.lit("?"), F.lit("_"))
    return F.concat(F.substring(safe, 1, 100), F.lit(".html"))


def write_html_dump(pages: DataFrame, path: str) -> None:
    """O-S5: pages with their dump names, parquet partitioned by domain (not one file per page)."""
    out = pages.select(F.regexp_extract("url", r"^https?://(?:www\.)?([^/:?#]+)", 1).alias("domain"),
                       dump_name(F.col("url")).alias("file_name"), "html")
    # rebalanced by domain: a domain with many pages is split over several tasks and files
    out.hint("rebalance", "domain").write.mode("overwrite").partitionBy("domain").parquet(path)


#: Times in JSON lines keep their microseconds (the writer's own format stops at milliseconds).
JSON_TIMES = {"timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


def write_responses(records: DataFrame, path: str) -> None:
    """O-S6: JSON lines, one record per response, partitioned by mode."""
    records.withColumn("_mode", F.col("metadata.mode")).write.mode("overwrite").partitionBy("_mode") \
        .options(**JSON_TIMES).json(path)


def write_batch_requests(log: DataFrame, path: str, batch_size: int) -> None:
    """Batches of request items as nested JSON (the shape clients send)."""
    b = log.withColumn("batch_id", (F.col("request_id") / batch_size).cast("long"))
    nested = b.groupBy("batch_id").agg(
        F.array_sort(F.collect_list(F.struct("request_id", "url", "mode"))).alias("items"),
        F.lit(3).alias("max_concurrency"))
    nested.write.mode("overwrite").json(path)


def read_batch_requests(spark: SparkSession, path: str) -> DataFrame:
    """O-S3: JSON with a fixed nested schema, one row per item."""
    raw = spark.read.schema(BATCH_REQUEST).json(path)
    return raw.select("batch_id", F.explode("items").alias("i")).select("batch_id", "i.request_id", "i.url", "i.mode")


def compact(spark: SparkSession, store: DataFrame, path: str, ts: str) -> DataFrame:
    """O-C18: write the store as it arrives, rewrite it rebalanced by fetch date (large dates are split),
    and report files and bytes before and after (from the files' metadata)."""
    before, after = path + "/before", path + "/after"
    store.write.mode("overwrite").parquet(before)
    spark.read.parquet(before).withColumn("fetch_date", F.to_date(ts)).hint("rebalance", "fetch_date") \
        .write.mode("overwrite").partitionBy("fetch_date").parquet(after)

    def files(p: str, label: str) -> DataFrame:
        m = spark.read.parquet(p).select(F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("s"))
        per = m.groupBy("f").agg(F.max("s").alias("s"), F.count(F.lit(1)).alias("rows"))
        return per.agg(F.lit(label).alias("phase"), F.count(F.lit(1)).alias("files"),
                       F.sum("s").alias("bytes"), F.sum("rows").alias("rows"))

    return files(before, "before").unionByName(files(after, "after"))


def write_metrics_text(lines: DataFrame, path: str) -> None:
    """O-S7: the exposition as one text file (metrics are a bounded set of lines, so one
    ordered partition is safe)."""
    lines.orderBy("metric", "line_no").select("line").coalesce(1).write.mode("overwrite").text(path)
