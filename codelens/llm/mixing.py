"""Efraimidis-Spirakis mixing of sources to target weights."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .text import SPACES, unit_hash, words

#: Slots that the keys of a source fall into at each of the two levels of its prefix sums.
SLOTS = 4096
#: Characters that count against a document's quality weight.
SYMBOLS = "#*$%&|<>"


def quality_weight(text: Column) -> Column:
    """Between 0.5 and 1: less for texts with many symbols."""
    t = F.coalesce(text, F.lit(""))
    symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
    return 0.5 + 0.5 / (1.0 + 20.0 * symbols / F.greatest(F.length(t), F.lit(1)))


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``(source, source_size)`` to the same with ``target``.

    Sources in order of code points, null last, weigh ``weights``, repeating, and share ``share`` of all
    sizes.  A target stops at ``most`` times its source's size; those that stop are the first in order of
    that bound over weight, and the rest share what is left.  One row a source.
    """
    table = F.array(*[F.lit(float(w)) for w in weights])
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("w", F.get(table, nth % len(weights))).withColumn("cap", most * F.col("source_size"))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = up.rowsBetween(Window.unboundedPreceding, -1), up.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = share * F.sum("source_size").over(everything)
    level = (total - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    s = s.withColumn("level", level).withColumn("free", F.col("cap") >= F.col("level") * F.col("w"))
    first = F.min(F.when(F.col("free"), F.struct(F.col("cap") / F.col("w"), "level"))).over(everything)["level"]
    return s.select("source", "source_size", F.least("cap", F.coalesce(first * F.col("w"), F.col("cap"))).alias("target"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken)`` for every row (see ``_mix``)."""
    return _mix(docs, weights, share, most, seed, id_col, text_col, source_col).drop("hash")


def _mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, hash, source, size, source_size, target, taken)`` for every row, the hash being the text's.

    ``size`` is the number of words.  ``taken`` counts the words that the mix takes: every document of a
    source once for each complete epoch that its target holds, then documents in order of exponential keys
    over their quality weights until the rest is reached; the last is cut to meet it.  The order's prefix
    sums go over slots of the keys' range, then slots of the one slot where the rest is reached, and only
    the rows of that last slot are sorted, so a source may hold any share of the rows.

    A key is fixed by id and text, so rows without an id have keys of their own.  Ties go to the smaller id,
    and rows that repeat id and text take equal places in turn.  Reruns agree.  A null text has size 0 and takes 0 words; a null source is a source of its own; a null id
    has a key like any other.  An empty table gives an empty one.
    """
    text = F.col(text_col).cast("string")
    size = F.when(text.isNull(), F.lit(0)).otherwise(F.size(words(text))).cast("long")
    key = -F.ln(unit_hash(F.lit(seed), F.col("doc_id"), F.col("digest"))) / F.col("weight")
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), size.alias("size"), quality_weight(text).alias("weight"), F.md5(text).alias("digest"), F.xxhash64(text).alias("hash"))
    rows = materialise(rows.withColumn("key", key).drop("digest"), "mix")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.avg("weight").alias("mean"))
    plan = targets(sizes.select("source", "source_size"), weights, share, most)
    plan = plan.join(sizes.select(F.col("source").alias("_s"), "mean"), F.col("source").eqNullSafe(F.col("_s"))).drop("_s")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    plan = plan.withColumn("epochs", epochs).withColumn("rest", F.round(F.col("target") - F.col("epochs") * F.col("source_size")).cast("long"))
    plan = materialise(plan.withColumnRenamed("source", "_s"), "plan")

    def placed(r: DataFrame, p: DataFrame) -> DataFrame:
        return r.join(p, F.col("source").eqNullSafe(F.col("_s"))).drop("_s")

    def crossing(r: DataFrame, slot: str, more: list[str]) -> DataFrame:
        """The slot of each source where its rest is reached, and the words before that slot."""
        by_slot = r.groupBy("source", *more, slot).agg(F.sum("size").alias("words"), F.first("rest").alias("rest"), *([F.first("base").alias("base")] if more else [F.lit(0).cast("long").alias("base")]))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy(slot)) + F.col("base")
        at = by_slot.withColumn("upto", upto).where("upto > rest").groupBy("source").agg(F.min(F.struct(slot, F.col("upto") - F.col("words"))).alias("at"))
        return at.select(F.col("source").alias("_s"), F.col("at")[slot].alias(f"at_{slot}"), F.col("at").getField("col2").alias("base"))

    # Keys of a source spread evenly over (0, 1) if its weights are alike.
    spread = 1 - F.exp(-F.col("key") * F.col("mean"))
    r = placed(rows, plan).withColumn("spread", spread)
    r = r.withColumn("s1", F.least(F.floor(F.col("spread") * SLOTS), F.lit(SLOTS - 1)).cast("int"))
    r = r.withColumn("s2", F.least(F.floor((F.col("spread") * SLOTS - F.col("s1")) * SLOTS), F.lit(SLOTS - 1)).cast("int"))
    one = materialise(crossing(r, "s1", []), "slots")
    inside = placed(r, one).where("s1 = at_s1")
    two = materialise(crossing(inside, "s2", ["s1"]).join(one.select(F.col("_s").alias("_t"), "at_s1"), F.col("_s").eqNullSafe(F.col("_t"))).drop("_t"), "slots")
    r = r.join(two, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s")
    whole = F.col("epochs") * F.col("size")
    here = F.coalesce((F.col("s1") == F.col("at_s1")) & (F.col("s2") == F.col("at_s2")), F.lit(False))
    early = F.col("at_s1").isNull() | (F.col("s1") < F.col("at_s1")) | ((F.col("s1") == F.col("at_s1")) & (F.col("s2") < F.col("at_s2")))
    rest = r.where(~here).withColumn("part", F.when(early & (F.col("rest") > 0), F.col("size")).otherwise(F.lit(0)))
    order = Window.partitionBy("source").orderBy("key", F.col("doc_id").asc_nulls_last(), "size", "hash").rowsBetween(Window.unboundedPreceding, -1)
    prior = F.col("base") + F.coalesce(F.sum("size").over(order), F.lit(0))
    edge = r.where(here).withColumn("part", F.greatest(F.lit(0), F.least("size", F.col("rest") - prior)))
    out = rest.unionByName(edge)
    return out.select("doc_id", "hash", "source", "size", "source_size", "target", (whole + F.col("part")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """``docs`` as the mix takes them: a row for each time a document is taken, the last of a source cut.

    Documents of which nothing is taken go.  Rows that repeat id and text are taken alike.  A column
    ``n_chars`` is counted anew; others are kept.
    """
    found = _mix(docs, **options).where("taken > 0").groupBy("doc_id", "hash").agg(F.max("taken").alias("taken"), F.max("size").alias("size"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    d = docs.select(row, F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text")).withColumn("h", F.xxhash64("text"))
    rows = d.join(found, F.col("id").eqNullSafe(F.col("doc_id")) & (F.col("h") == F.col("hash"))).select("row", "text", "taken", "size")
    full, part = F.floor(F.col("taken") / F.col("size")).cast("int"), F.col("taken") % F.col("size")
    counts = F.concat(F.array_repeat(F.col("size"), full), F.when(part > 0, F.array(part)).otherwise(F.array().cast("array<bigint>")))
    rows = rows.select("row", "text", "size", F.explode(counts).alias("words"))
    pieces = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, 1, F.col("words").cast("int")), "")
    rows = rows.select("row", F.when(F.col("words") < F.col("size"), cut).otherwise(F.col("text")).alias("text"))
    made = {"text": F.col("text"), "n_chars": F.length("text").cast("long")}
    return rows.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


#: The same in SQL, with the parameters of the registered query.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) END::BIGINT AS size,
    0.5 + 0.5 / (1.0 + 20.0 * (length(coalesce(text, '')) - length(translate(coalesce(text, ''), '{SYMBOLS}', ''))) / greatest(length(coalesce(text, '')), 1))::DOUBLE AS w,
    (('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, 'null') || ':' || coalesce(md5(text), 'null')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
k AS (SELECT *, -ln(u) / w AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
n AS (
  SELECT *, ([5.0, 2.0, 1.0]::DOUBLE[])[((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS sw, 2.0::DOUBLE * source_size AS cap FROM s),
v AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / sw, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(sw) OVER (ORDER BY cap / sw, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM n),
x AS (SELECT min_by(level, cap / sw) AS level FROM v WHERE cap >= level * sw),
t AS (SELECT v.source, v.source_size, least(v.cap, coalesce(x.level * v.sw, v.cap)) AS target FROM v LEFT JOIN x ON true),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS epochs FROM t),
p AS (
  SELECT k.*, e.source_size, e.target, e.epochs, round(e.target - e.epochs * e.source_size)::BIGINT AS rest,
    coalesce(sum(k.size) OVER (PARTITION BY k.source ORDER BY k.key, k.doc_id NULLS LAST, k.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS prior
  FROM k JOIN e ON k.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, source, size, source_size, target, epochs * size + greatest(0, least(size, rest - prior)) AS taken FROM p
"""
