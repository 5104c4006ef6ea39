"""Values of matched elements for extraction: attributes (O-X4/O-X5, O-X12).  Text values (O-X2) are
slices of the page's strings and stand with the spec compiler in :mod:`extract`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.functions import urls


def attr_value(attribute: str | None) -> Column:
    """Named attribute, or ``href`` falling back to ``src`` when it is missing or empty."""
    if attribute:
        return F.try_element_at(F.col("attrs"), F.lit(attribute))
    href = F.try_element_at(F.col("attrs"), F.lit("href"))
    src = F.try_element_at(F.col("attrs"), F.lit("src"))
    return F.when(href.isNotNull() & (href != ""), href).otherwise(src)


def absolutize(df: DataFrame, value: str, base: str, out: str) -> DataFrame:
    """O-X12: resolve non-empty values of column ``value`` against column ``base``."""
    d = urls.add_joined_url(df, base, value, "_abs")
    v = F.col(value)
    return d.withColumn(out, F.when(v.isNotNull() & (v != ""), F.col("_abs")).otherwise(v)).drop("_abs")
