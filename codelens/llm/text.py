"""Column helpers that the text operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What separates words: space and the control characters tab to carriage return.
SPACES = r"[\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and give it to ``body``, however often that refers to it."""
    return F.transform(F.array(value), body)[0]


def unit_hash(*parts: Column) -> Column:
    """A number in (0, 1) fixed by its parts: 52 bits of an MD5 digest."""
    digest = F.md5(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("null")) for p in parts]))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(2**52)


def unused(name: str, columns: list[str]) -> str:
    """The name, or it with marks behind that no column has."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def aside(docs: DataFrame, names: list[str]) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of these names called otherwise, and what gives them their names and order again."""
    taken, now = {n.lower() for n in names}, {}
    for c in docs.columns:
        now[c] = unused(f"{c}_given", [*docs.columns, *now.values()]) if c.lower() in taken else c
    return docs.withColumnsRenamed({c: n for c, n in now.items() if c != n}), [F.col(f"`{n}`").alias(c) for c, n in now.items()]
