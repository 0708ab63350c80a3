"""Tables as they are shown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import ALL, COUNTS

STATS = "interviews_with_construct [p5-p95]"


def truncate(c: Column, n: int) -> Column:
    """Longer texts cut to ``n`` characters, the last three being dots."""
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n - 3), F.lit("..."))).otherwise(c)


def coding_table(instances: DataFrame, max_quote_length: int | None = None) -> DataFrame:
    quote = truncate(F.col("quote"), max_quote_length) if max_quote_length else F.col("quote")
    return instances.select("doc_id", "construct", quote.alias("quote"), "speaker_id", "quote_index", "confidence")


def _two(c: str) -> Column:
    """Two decimals of the binary value, ties to even."""
    return F.expr(f"format_number(`{c}`, '0.00')")


def _stats() -> Column:
    return F.concat(F.col("n_docs"), F.lit(" ["), _two("p5"), F.lit("-"), _two("p95"), F.lit("]")).alias(STATS)


def format_pooled(pooled: DataFrame) -> DataFrame:
    shown = [F.when(F.col(m).isNull(), F.lit("-")).otherwise(_two(m)).alias(m) for m in ALL]
    return pooled.select("construct", *COUNTS, *shown, _stats())


def format_weighted(weighted: DataFrame) -> DataFrame:
    span = lambda m: F.concat(_two(f"{m}_median"), F.lit(" ["), _two(f"{m}_min"), F.lit("-"), _two(f"{m}_max"), F.lit("]"))
    return weighted.select("construct", *COUNTS, *[F.coalesce(span(m), F.lit("-")).alias(m) for m in ALL], _stats())
