"""Spans of quotes: parsing, overlap and location."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def strip(c: Column) -> Column:
    """Without white space at either end, Unicode's included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _whole(c: Column) -> Column:
    """A whole number; most are plain, and only others are stripped."""
    return F.coalesce(c.try_cast("int"), strip(c).try_cast("int"))


def _once(value: Column, use) -> Column:
    """``use`` of a value that is made once, however often it is named there."""
    return F.transform(F.array(value), use)[0]


def parse_range(c: Column, form: str = "dash") -> Column:
    """``a-b`` or ``a:b`` to ``a:b``; null unless there are exactly two whole numbers."""
    if form not in ("dash", "colon"):
        raise ValueError(f"unknown range format: {form}")
    parts = F.split(c, "-" if form == "dash" else ":")
    a, b = _whole(F.get(parts, 0)), _whole(F.get(parts, 1))
    return F.when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), F.concat_ws(":", a, b))


def parse_span(c: Column) -> Column:
    """``start:end`` to a struct; null if malformed or ending before its start."""
    ends = _once(F.split(c, ":"), lambda p: F.when(F.size(p) == 2, F.struct(_whole(F.get(p, 0)).alias("start"), _whole(F.get(p, 1)).alias("end"))))
    return _once(ends, lambda s: F.when(s["end"] >= s["start"], s))


def span_overlap(x: Column, y: Column) -> Column:
    """Jaccard overlap of two half-open spans; two empty ones overlap fully, one empty not at all."""
    return _once(F.struct(x.alias("x"), y.alias("y")), lambda s: _overlap(s["x"], s["y"]))


def _overlap(x: Column, y: Column) -> Column:
    n, m = x["end"] - x["start"], y["end"] - y["start"]
    both = F.greatest(F.lit(0), F.least(x["end"], y["end"]) - F.greatest(x["start"], y["start"]))
    jaccard = both.cast("double") / (n + m - both)
    return F.when(x.isNull() | y.isNull(), F.lit(None)).when((n == 0) & (m == 0), F.lit(1.0)).when((n == 0) | (m == 0), F.lit(0.0)).otherwise(jaccard)


def find_quote(text: Column, quote: Column) -> Column:
    """``start:end`` of the quote's first place in the text, in code points; null if absent or empty."""
    at = F.instr(text, quote)
    return F.when((F.length(quote) > 0) & (at > 0), F.concat_ws(":", at - 1, at - 1 + F.length(quote)))


def _find_all(texts: pa.Array, quotes: pa.Array) -> pa.Array:
    def places(text: str | None, some: list[str | None] | None) -> list[str | None] | None:
        if some is None:
            return None
        at = [text.find(q) if q and text is not None else -1 for q in some]
        return [f"{i}:{i + len(q)}" if i >= 0 else None for i, q in zip(at, some, strict=True)]

    rows = zip(texts.to_pylist(), quotes.to_pylist(), strict=True)
    return pa.array([places(*r) for r in rows], pa.list_(pa.string()))


def find_quotes(text: Column, quotes: Column) -> Column:
    """``find_quote`` of each of an array of quotes, as an array.

    The text goes to a task's Python once for all of its quotes: there a search passes over most letters, while
    ``instr`` compares at each of them, and a row a quote would copy the text.
    """
    return F.arrow_udf(_find_all, "array<string>")(text, quotes)
