"""Places of quotes in their documents, exact or, where the quote does not stand as it is, fuzzy."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import Places, best_window
from ..functions.spans import find_quote
from ..scratch import materialise

#: Quotes that one row of work holds about, and that a task gets about.
BLOCK, TASK = 256, 2048
FOUND = "key string, quote string, place string"


def fuzzy_places(quotes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """``(key, quote, place)`` of the distinct ``(key, quote)`` that have a fuzzy place in the text of their key.

    A document's quotes are searched together, since its grams are sorted once for all of them, but no more
    than a block at a time, so that a document with any number of quotes spreads over tasks.  A text is sent
    once a block, never once a quote.  ``texts`` has ``key, text``, a row a key.
    """
    one = materialise(quotes.select("key", "quote").distinct(), "quotes")
    n = one.count()
    spark = quotes.sparkSession
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK))
    blocks = one.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    own = F.pmod(F.xxhash64("quote"), F.col("blocks")).alias("block")
    grouped = one.join(blocks, "key").select("key", own, "quote").groupBy("key", "block").agg(F.collect_list("quote").alias("quotes"))
    work = grouped.join(texts.select("key", "text"), "key").select("key", "text", "quotes", "block")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text, some in zip(*(batch.column(i) for i in range(3)), strict=True):
                text = text.as_py()
                places, key = Places(text), key.as_py()
                rows = [(key, q, best_window(text, q, threshold, places)) for q in some.as_py()]
                rows = [r for r in rows if r[2]]
                if rows:
                    yield pa.record_batch([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], ["key", "quote", "place"])

    # So many partitions, whatever their bytes: the work is in Python, and texts are small beside it.
    return work.repartition(tasks, "key", "block").mapInArrow(run, FOUND)


def locate_quotes(rows: DataFrame, threshold: float | None = None, docs: DataFrame | None = None, key: str = "doc_id") -> DataFrame:
    """``rows`` (with ``text`` and ``quote``) with ``quote_index`` in place of ``text``: exact, else fuzzy if a threshold is given.

    ``docs`` has the text of each ``key``, once; without it, texts are gathered from the rows.  With ``docs``, rows
    may have a ``quote_index`` of what is found exactly in place of ``text``.  Rows are
    written with what is found exactly, so they are made once, and only quotes that are not found go to the
    fuzzy search.  A null or empty quote, or text, has no place; rows with a null key are found exactly alone.
    """
    other = [c for c in rows.columns if c != "text"]
    other = [c for c in other if c != "quote_index"]
    place = F.col("quote_index") if "quote_index" in rows.columns else find_quote(F.col("text"), F.col("quote"))
    exact = rows.select(*other, place.alias("quote_index"))
    if threshold is None:
        return exact
    if docs is None:
        docs = rows.groupBy(key).agg(F.any_value("text").alias("text"))
    written = materialise(exact, "exact")
    missing = written.where(F.col("quote_index").isNull() & (F.length("quote") > 0))
    texts = docs.where(F.length("text") > 0).select(F.col(key).cast("string").alias("key"), "text")
    found = materialise(fuzzy_places(missing.select(F.col(key).cast("string").alias("key"), "quote"), texts, threshold), "fuzzy")
    w, f = written.alias("w"), found.alias("f")
    both = w.join(f, F.col("w.quote_index").isNull() & (F.col(f"w.{key}").cast("string") == F.col("f.key")) & (F.col("w.quote") == F.col("f.quote")), "left")
    return both.select(*[F.col(f"w.{c}") for c in other], F.coalesce("w.quote_index", "f.place").alias("quote_index"))
