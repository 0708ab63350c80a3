"""Comparing two codings of the same documents, quote by quote."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.spans import parse_span, span_overlap
from ..schemas import COMPARISON_COLUMNS
from ..scratch import materialise

KEYS = ["doc_id", "construct"]
#: Quotes are numbered, and proposals walked, in blocks of so many places, as powers of two.
BLOCK_BITS, WALK_BITS = 12, 16
#: Quotes of a group from which it is dealt by words and cells, to a part for each so many.
GROUP = 4096
_QUOTE = ["quote", "quote_index", "confidence"]


def _rows(df: DataFrame) -> DataFrame:
    """The fifteen columns from both sides' fields; a side without a quote is missing."""
    h, m = F.col("h.quote").isNotNull(), F.col("m.quote").isNotNull()
    flag = lambda c: c.cast("int")
    values = {
        "status": F.when(h & m, F.lit("matched")).when(h, F.lit("human_only")).otherwise(F.lit("llm_only")),
        "human_quote": F.col("h.quote"), "llm_quote": F.col("m.quote"), "human_indices": F.col("h.quote_index"), "llm_indices": F.col("m.quote_index"),
        "human_confidence": F.col("h.confidence"), "llm_confidence": F.col("m.confidence"),
        "paraphrase": F.when(h & m, F.col("paraphrase")), "match_confidence": F.when(h & m, F.col("match_confidence")),
        "span_overlap": F.when(h & m, span_overlap(parse_span(F.col("h.quote_index")), parse_span(F.col("m.quote_index")))),
        "tp": flag(h & m), "fp": flag(~h & m), "fn": flag(h & ~m),
    }
    return df.select(*KEYS, *[c.alias(n) for n, c in values.items()]).select(*COMPARISON_COLUMNS)


def compare_exact(human: DataFrame, llm: DataFrame) -> DataFrame:
    """Pairs equal quotes of a document and construct, the k-th on one side with the k-th on the other."""

    def side(df: DataFrame, name: str) -> DataFrame:
        k = F.row_number().over(Window.partitionBy(*KEYS, "quote").orderBy("ord"))
        return df.select(*KEYS, "quote", k.alias("k"), F.struct(*_QUOTE).alias(name))

    both = side(human, "h").join(side(llm, "m"), [*KEYS, "quote", "k"], "full_outer")
    return _rows(both.withColumns({"paraphrase": F.lit(False), "match_confidence": F.lit(1.0)}))


def group_quotes(instances: DataFrame, name: str) -> DataFrame:
    """The quotes of each document and construct in their order."""
    item = F.struct("ord", *_QUOTE)
    return instances.groupBy(*KEYS).agg(F.array_sort(F.collect_list(item)).alias(name))


def align(human: DataFrame, llm: DataFrame) -> DataFrame:
    """Both sides' quotes for every document and construct that either has; a missing side is empty."""
    none = F.array().cast("array<struct<ord:int,quote:string,quote_index:string,confidence:int>>")
    both = group_quotes(human, "hs").join(group_quotes(llm, "ms"), KEYS, "full_outer")
    return both.withColumns({"hs": F.coalesce("hs", none), "ms": F.coalesce("ms", none)})


def numbered_quotes(instances: DataFrame) -> DataFrame:
    """The quotes of each document and construct with their place ``i`` among them, from 0.

    Quotes are ordered within blocks of ``ord``, and blocks numbered by the sizes of those before, so no task
    gets all quotes of a group.
    """
    block = F.shiftright(F.coalesce("ord", F.lit(0)), BLOCK_BITS)
    rows = instances.select(*KEYS, "ord", *_QUOTE, block.alias("_b"))
    before = F.sum("_n").over(Window.partitionBy(*KEYS).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(*KEYS, "_b").agg(F.count("*").alias("_n")).select(*KEYS, "_b", F.coalesce(before, F.lit(0)).alias("_before"))
    nth = F.row_number().over(Window.partitionBy(*KEYS, "_b").orderBy("ord", *_QUOTE)) - 1
    return rows.withColumn("_i", nth).join(blocks, [*KEYS, "_b"]).select(*KEYS, (F.col("_i") + F.col("_before")).cast("int").alias("i"), "ord", *_QUOTE)


def _walk(proposals: DataFrame) -> DataFrame:
    """Proposals that a walk in their order accepts, for each document and construct on its own.

    Rows come sorted, and a task remembers only which quotes of the group at hand are taken.
    """
    rows = proposals.repartition(*KEYS).sortWithinPartitions(*KEYS, "ord", "human_index", "llm_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, humans, models = None, set(), set()
        for batch in batches:
            kept = []
            for k, (*key, h, m) in enumerate(zip(*(batch.column(c).to_pylist() for c in (*KEYS, "human_index", "llm_index")), strict=True)):
                if key != group:
                    group, humans, models = key, set(), set()
                if h not in humans and m not in models:
                    humans.add(h)
                    models.add(m)
                    kept.append(k)
            yield batch.take(pa.array(kept, pa.int64()))

    return rows.mapInArrow(run, rows.schema)


def accepted(proposals: DataFrame) -> DataFrame:
    """Proposals that a walk in order of ``ord`` accepts, each quote once: pairs of quotes that both exist are given.

    A walk is done in rounds over what is left.  In a round each group's first block of ``ord`` is walked, and
    of the other proposals those are taken that come first for both their quotes, as nothing before them can
    take either.  Then all proposals for taken quotes drop out.  Most groups are one block, done in one round; one
    of any size is never in one row or task.  Proposals of equal ``ord`` are taken by their indices.
    """
    order = F.struct("ord", "human_index", "llm_index")
    left, taken = materialise(proposals, "proposals"), None
    while True:
        blocks = left.withColumn("_b", F.shiftright("ord", WALK_BITS))
        first = blocks.groupBy(*KEYS).agg(F.min("_b").alias("_first"), F.max("_b").alias("_last"))
        marked = blocks.join(first, KEYS)
        now = _walk(marked.where("_b = _first").select(*left.columns))
        more = not first.where("_last > _first").isEmpty()
        if more:
            least = lambda side: left.groupBy(*KEYS, side).agg(F.min(order).alias(f"_{side}"))  # noqa: B023, E731
            later = marked.where("_b > _first").withColumn("_o", order).join(least("human_index"), [*KEYS, "human_index"]).join(least("llm_index"), [*KEYS, "llm_index"])
            now = now.unionByName(later.where("_o = _human_index AND _o = _llm_index").select(*left.columns))
        now = materialise(now, "accepted")
        taken = now if taken is None else taken.unionByName(now)
        if not more:
            return taken
        rest = marked.where("_b > _first").select(*left.columns)
        for side in ("human_index", "llm_index"):
            rest = rest.join(now.select(*KEYS, side), [*KEYS, side], "left_anti")
        left = materialise(rest.select(*left.columns), "proposals")


def compare(human: DataFrame, llm: DataFrame, proposals: DataFrame) -> DataFrame:
    """Greedy one-to-one pairs by ``proposals``; what stays unpaired is on one side only.

    Proposals are ``doc_id, construct, ord, human_index, llm_index, paraphrase, match_confidence``; those for
    quotes that do not exist are passed over.  Quotes meet by document, construct and place, so a group of any size spreads.
    """
    hs, ms = (materialise(numbered_quotes(side), "quotes") for side in (human, llm))
    real = proposals.select(*KEYS, "ord", "human_index", "llm_index", "paraphrase", "match_confidence")
    for side, name in ((hs, "human_index"), (ms, "llm_index")):
        real = real.join(side.select(*KEYS, F.col("i").alias(name)), [*KEYS, name], "left_semi")
    pairs = accepted(real).select(*KEYS, F.col("human_index").alias("i"), "llm_index", "paraphrase", "match_confidence")
    item = F.struct("ord", *_QUOTE)
    # A quote without a partner gets a key of its own that no quote on the other side has.
    left = hs.join(pairs, [*KEYS, "i"], "left").select(*KEYS, F.coalesce("llm_index", -1 - F.col("i")).alias("_at"), item.alias("h"), "paraphrase", "match_confidence")
    right = ms.select(*KEYS, F.col("i").alias("_at"), item.alias("m"))
    return _rows(left.join(right, [*KEYS, "_at"], "full_outer"))


def indexed_quotes(instances: DataFrame, name: str) -> DataFrame:
    return numbered_quotes(instances).select(*KEYS, F.col("i").alias(f"{name}_index"), F.col("quote").alias(f"{name}_quote"), F.col("quote_index").alias(f"{name}_span"))


def _level(n: Column) -> Column:
    """Whole binary logarithm of a positive number."""
    return F.length(F.bin(n)) - 1


def _bins(span: Column, levels: Column) -> Column:
    """Keys of the cells that a span touches, those of a level being two to that power long."""
    cells = lambda k: F.sequence(F.floor(span["start"] / F.pow(F.lit(2), k)), F.floor((span["end"] - 1) / F.pow(F.lit(2), k)))
    keys = F.flatten(F.transform(levels, lambda k: F.transform(cells(k), lambda x: F.concat_ws(":", F.lit("s"), k, x))))
    return F.when(span.isNull(), F.array().cast("array<string>")).when(span["end"] == span["start"], F.array(F.lit("e"))).otherwise(keys)


def _rare_first(words: Column, threshold: float) -> Column:
    """So many words, longest first, that sets with a Jaccard share of ``threshold`` have one of them in common."""
    n = F.size(words)
    order = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("l"), w.alias("w"))))
    return F.transform(F.slice(order, 1, n - F.ceil(n * threshold - 1e-9).cast("int") + 1), lambda x: F.concat(F.lit("w:"), x["w"]))


def propose_similar(human: DataFrame, llm: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Proposals for quotes whose spans overlap, or words agree, by a Jaccard share of ``threshold`` or more.

    Candidates of a document and construct meet in a word, of the longest of either, or in a cell that both
    spans touch, of a size near their lengths; every pair that reaches the threshold meets so.  A quote is
    sent to its group once, as numbers of its words and cells; a large group is dealt by these.  Only the
    pairs that meet, each once, get their quotes back.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    group = F.xxhash64(*KEYS).alias("group")
    sides = {name: materialise(indexed_quotes(df, name).select(group, "*"), name) for name, df in (("human", human), ("llm", llm))}
    groups = sides["human"].select("group").unionByName(sides["llm"].select("group")).groupBy("group").agg(F.count("*").alias("n"))
    large = materialise(groups.where(F.col("n") > GROUP).select("group", F.ceil(F.col("n") / GROUP).alias("parts")), "large")
    words = lambda c: F.array_distinct(F.split(F.lower(c), r"\s+"))

    def side(name: str, levels) -> DataFrame:
        rows = sides[name].withColumn("span", parse_span(F.col(f"{name}_span"))).withColumn("words", words(f"{name}_quote"))
        # Odd numbers are cells, even ones words.
        cells = F.transform(_bins(F.col("span"), levels(F.col("span.end") - F.col("span.start"))), lambda k: F.hash(k).bitwiseOR(F.lit(1)))
        rare = F.coalesce(F.transform(_rare_first(F.col("words"), threshold), lambda k: F.hash(k).bitwiseAND(F.lit(-2))), F.array().cast("array<int>"))
        rows = rows.select("group", F.lit(name == "human").alias("human"), F.col(f"{name}_index").alias("at"), F.size("words").alias("n"), F.array_distinct(F.concat(cells, rare)).alias("keys"))
        part = lambda k: F.pmod(F.shiftright(k, 1), F.coalesce("parts", F.lit(1)))
        dealt = rows.join(large, "group", "left").withColumn("part", F.explode(F.array_distinct(F.transform("keys", part))))
        return dealt.select("group", "part", "human", "at", "n", F.filter("keys", lambda k: part(k) == F.col("part")).alias("keys"))

    def near(n: Column) -> Column:
        least, most = F.greatest(F.lit(1), F.floor(n * threshold)).cast("long"), F.ceil(n / threshold).cast("long")
        return F.when(n > 0, F.sequence(_level(least), _level(most)))

    quotes = side("human", near).unionByName(side("llm", lambda n: F.array(_level(n)))).repartition("group", "part")
    own = F.struct("at", "n")
    met = quotes.withColumn("key", F.explode("keys")).groupBy("group", "part", "key").agg(F.collect_list(F.when(F.col("human"), own)).alias("hs"), F.collect_list(F.when(~F.col("human"), own)).alias("ms"))
    pairs = met.where((F.size("hs") > 0) & (F.size("ms") > 0)).withColumn("h", F.explode("hs")).withColumn("m", F.explode("ms"))
    fits = F.least("h.n", "m.n") >= F.greatest("h.n", "m.n") * (threshold - 1e-9)
    pairs = pairs.where((F.col("key") % 2 != 0) | fits).select("group", F.col("h.at").alias("human_index"), F.col("m.at").alias("llm_index")).distinct()
    both = pairs.join(sides["human"], ["group", "human_index"]).join(sides["llm"].withColumnsRenamed({k: f"_{k}" for k in KEYS}), ["group", "llm_index"])
    both = both.where(" AND ".join(f"{k} = _{k}" for k in KEYS)).withColumns({"a": words("human_quote"), "b": words("llm_quote"), "x": parse_span(F.col("human_span")), "y": parse_span(F.col("llm_span"))})
    shared = F.size(F.array_intersect("a", "b"))
    jaccard = F.try_divide(shared.cast("double"), F.size("a") + F.size("b") - shared)
    scored = both.withColumn("score", F.greatest(F.coalesce(span_overlap(F.col("x"), F.col("y")), F.lit(0.0)), F.coalesce(jaccard, F.lit(0.0)))).where(F.col("score") >= threshold)
    found = scored.select(*KEYS, "human_index", "llm_index", (F.col("human_quote") != F.col("llm_quote")).alias("paraphrase"), F.col("score").alias("match_confidence"))
    order = Window.partitionBy(*KEYS).orderBy(F.desc("match_confidence"), "human_index", "llm_index")
    return found.select(*KEYS, (F.row_number().over(order) - 1).alias("ord"), "human_index", "llm_index", "paraphrase", "match_confidence")


def ordered(comparison: DataFrame) -> DataFrame:
    """Rows in the order in which they are shown: documents, constructs, then matched, human only, LLM only."""
    rank = F.array_position(F.array(F.lit("matched"), F.lit("human_only"), F.lit("llm_only")), F.col("status"))
    return comparison.orderBy(*KEYS, rank, "human_indices", "llm_indices")


def format_quotes(quotes: Column) -> Column:
    """Numbered lines ``i. "quote" (indices: s:e)`` of a matcher's prompt."""
    line = lambda q, i: F.concat(i, F.lit('. "'), q["quote"], F.lit('" (indices: '), F.coalesce(q["quote_index"], F.lit("N/A")), F.lit(")"))
    return F.array_join(F.transform(quotes, line), "\n")
