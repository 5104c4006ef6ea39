"""Fetch-result labelling and routing (O-L1..O-L4)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagecorpus.functions.text import py_strip

# Status codes that look like a block page.
BLOCKED_STATUS = [403, 429, 503, 444]
# Fixed value: shorter stripped bodies count as blocked / empty.
MIN_VALID_HTML_LENGTH = 500
# Block-page markers (case-insensitive substrings), in checking order.
BLOCK_MARKERS = ["access denied", "captcha", "unusual traffic", "please complete the security check",
                 "blocked", "cf-browser-verification", "challenge-platform"]
# Challenge-page markers (title first, then the whole page).
CHALLENGE_MARKERS = ["access denied", "just a moment", "checking your browser", "attention required",
                     "cf-challenge", "customdeny"]


def _first_marker(text: Column, markers: list[str]) -> Column:
    out = F.lit(None).cast("string")
    for m in reversed(markers):
        out = F.when(F.contains(text, F.lit(m)), F.lit(m)).otherwise(out)
    return out


def page_block_rule(html: Column) -> Column:
    """The part of O-L1 that depends on the page alone: ``too_short`` or ``marker:<text>``."""
    lower = F.lower(F.coalesce(html, F.lit("")))
    marker = _first_marker(lower, BLOCK_MARKERS)
    return (F.when(F.length(py_strip(F.coalesce(html, F.lit("")))) < MIN_VALID_HTML_LENGTH, F.lit("too_short"))
            .when(marker.isNotNull(), F.concat(F.lit("marker:"), marker)))


def block_rule(status: Column, page_rule: Column) -> Column:
    """O-L1 from a request's status and its page's rule."""
    return F.when(status.isin(BLOCKED_STATUS), F.lit("status")).otherwise(page_rule)


def block_label(status: Column, html: Column) -> tuple[Column, Column]:
    """O-L1: (blocked, rule) -- rule is ``status``, ``too_short`` or ``marker:<text>``."""
    rule = block_rule(status, page_block_rule(html))
    return rule.isNotNull(), rule


def challenge_label(title: Column, html: Column) -> Column:
    """O-L2: first challenge marker in the lower-cased title, else in the whole page."""
    t = _first_marker(F.lower(F.coalesce(title, F.lit(""))), CHALLENGE_MARKERS)
    h = _first_marker(F.lower(F.coalesce(html, F.lit(""))), CHALLENGE_MARKERS)
    return F.coalesce(t, h)


def route_auto(http: DataFrame, browser: DataFrame) -> DataFrame:
    """O-L3: auto mode -- keep the HTTP result unless it failed or looks blocked; then the
    browser result; when the browser fails too, the HTTP error stands.
    ``http(request_id, failed, blocked, ...)``, ``browser(request_id, b_failed, b_status)``."""
    j = http.join(browser, "request_id", "left")
    need = F.col("failed") | F.col("blocked")
    route = (F.when(~need, F.lit("http"))
             .when(F.coalesce(~F.col("b_failed"), F.lit(False)), F.lit("browser"))
             .when(F.col("failed"), F.lit("http_error"))
             .otherwise(F.lit("browser_error")))
    return j.withColumn("route", route)


def label_rates(labels: DataFrame, keys: list[str]) -> DataFrame:
    """O-L4: blocked share per group."""
    return labels.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"),
                                     F.avg(F.col("blocked").cast("double")).alias("blocked_rate"))
