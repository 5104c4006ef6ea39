"""Whitespace classes and text-piece expressions shared by cleaning, text and selectors.

Python's ``\\s`` and ``str.strip()`` treat every Unicode space as whitespace; Java's ``\\s``
does not, so the class is spelled out once here (and in the same order for DuckDB).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Code points Python counts as whitespace (str.isspace), as ranges.
WHITESPACE_RANGES = [
    (0x09, 0x0D), (0x1C, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680),
    (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000),
]
# Code points that end a line for str.splitlines().
LINE_BREAKS = [0x0A, 0x0B, 0x0C, 0x0D, 0x1C, 0x1D, 0x1E, 0x85, 0x2028, 0x2029]


def _java_cp(cp: int) -> str:
    return f"\\x{{{cp:X}}}"


def java_class(ranges) -> str:
    parts = []
    for lo, hi in ranges:
        parts.append(_java_cp(lo) if lo == hi else f"{_java_cp(lo)}-{_java_cp(hi)}")
    return "[" + "".join(parts) + "]"


WS = java_class(WHITESPACE_RANGES)
LB = java_class([(c, c) for c in LINE_BREAKS])


def py_strip(col: Column) -> Column:
    """``str.strip()``: drop leading and trailing Unicode whitespace."""
    return F.regexp_replace(col, f"^{WS}+|{WS}+$", "")


def collapse_ws(col: Column) -> Column:
    """``re.sub(r'\\s+', ' ', s)``."""
    return F.regexp_replace(col, f"{WS}+", " ")


def text_lines(col: Column) -> Column:
    """One text piece to its visible lines: split at line breaks, collapse, strip, drop
    blanks; joined with newlines ('' when nothing is left)."""
    lines = F.transform(F.split(col, LB), lambda l: py_strip(collapse_ws(l)))
    return F.array_join(F.filter(lines, lambda l: l != ""), "\n")
