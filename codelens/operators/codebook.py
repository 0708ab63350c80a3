"""Construct names and codebooks: renaming, checks, refinement and merging."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise

#: Parts in which a construct's quotes are ranked before all of them.
PARTS = 64


@dataclass(frozen=True)
class Meta:
    """What a codebook says of itself; ``built_from`` has names and versions of those it comes from."""

    name: str = ""
    version: int | None = 1
    citation: str = ""
    built_from: tuple[tuple[str, int | None], ...] = ()
    partial: bool = False

    def refined(self) -> Meta:
        """Of a partial codebook that was refined from this one; it has no version until it is merged."""
        return Meta(self.name, None, self.citation, ((self.name, self.version),), True)

    def merged(self, partial: Meta, version: int | None = None) -> Meta:
        """Of this codebook after a merge with a partial one, the next version if none is given."""
        if not partial.partial:
            warnings.warn("the codebook to merge is not flagged as partial; its constructs replace the base's all the same", stacklevel=2)
        return Meta(self.name, merged_version(self.version or 1, version), self.citation, ((self.name, self.version),))


def rename_constructs(instances: DataFrame, mapping: DataFrame) -> DataFrame:
    """New names by ``mapping(old, new)``; others stay."""
    m = mapping.select(F.col("old").alias("construct"), F.col("new").alias("_new"))
    return instances.join(m, "construct", "left").withColumn("construct", F.coalesce("_new", "construct")).select(*instances.columns)


def unused_mapping(instances: DataFrame, mapping: DataFrame) -> DataFrame:
    """Old names that no instance has."""
    names = instances.select(F.col("construct").alias("old")).distinct()
    return mapping.select("old").distinct().join(names, "old", "left_anti").orderBy("old")


def unknown_constructs(instances: DataFrame, codebook: DataFrame, strict: bool | None = None) -> DataFrame:
    """Constructs that the codebook lacks; with ``strict`` false or true, a warning or an error if there are any."""
    out = instances.select("construct").distinct().join(codebook.select("construct"), "construct", "left_anti").orderBy("construct")
    if strict is not None and (names := [r[0] for r in out.limit(20).collect()]):
        text = f"constructs that are not in the codebook: {', '.join(map(str, names))}"
        if strict:
            raise ValueError(text)
        warnings.warn(text, stacklevel=2)
    return out


def only_constructs(instances: DataFrame, constructs: DataFrame) -> DataFrame:
    return instances.join(constructs.select("construct").distinct(), "construct", "left_semi").select(*instances.columns)


def underperforming(pooled: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Constructs whose rounded PABAK is below the threshold."""
    return pooled.where(~F.col("is_overall") & (F.col("pabak") < threshold)).select("construct")


def not_in_codebook(pooled: DataFrame, codebook: DataFrame, threshold: float = 0.8) -> DataFrame:
    """Constructs below the threshold that refining skips, since the codebook lacks them."""
    return underperforming(pooled, threshold).join(codebook.select("construct"), "construct", "left_anti").orderBy("construct")


def sample_size(n: int | str) -> int | None:
    if n == "all":
        return None
    if isinstance(n, bool) or not isinstance(n, int) or n <= 0:
        raise ValueError("sample size must be a positive whole number or 'all'")
    return n


def _of_constructs(comparison: DataFrame, codebook: DataFrame) -> DataFrame:
    """Rows of the codebook's constructs, left where they are: dealt by construct, all quotes of one would stay in a task."""
    return comparison.join(F.broadcast(codebook.select("construct")), "construct", "left_semi")


def fresh_quotes(comparison: DataFrame, known: DataFrame, status: str, column: str, n: int | str, seed: int) -> DataFrame:
    """``(construct, digest, quote)``: distinct trimmed quotes of a status that ``known(construct, quote)`` lacks.

    At most ``n`` of a construct, the first by a digest of quote and seed.  These are the first of the first of
    each of ``PARTS`` parts of a construct's quotes, so no task ranks them all.
    """
    quotes = comparison.where(F.col("status") == status).select("construct", F.btrim(column, F.lit(" \t\n\r")).alias("quote")).where("quote <> ''").distinct()
    fresh = quotes.join(known.distinct(), ["construct", "quote"], "left_anti").select("construct", F.md5(F.concat("quote", F.lit(f":{seed}"))).alias("digest"), "quote")
    limit = sample_size(n)
    if limit is None:
        return fresh
    for part in ([F.pmod(F.xxhash64("quote"), F.lit(PARTS))], []):
        fresh = fresh.withColumn("_n", F.row_number().over(Window.partitionBy("construct", *part).orderBy("digest", "quote"))).where(F.col("_n") <= limit)
    return fresh.drop("_n")


def new_quotes(comparison: DataFrame, known: DataFrame, status: str, column: str, n: int | str, seed: int) -> DataFrame:
    """``(construct, quotes)``: what ``fresh_quotes`` finds, as an array a construct."""
    fresh = fresh_quotes(comparison, known, status, column, n, seed)
    own = fresh.groupBy("construct").agg(F.array_sort(F.collect_list(F.struct("digest", "quote"))).alias("q"))
    return own.select("construct", F.transform("q", lambda x: x["quote"]).alias("quotes"))


def refined_entries(comparison: DataFrame, pooled: DataFrame, codebook: DataFrame, threshold: float = 0.8, n_examples: int | str = "all", n_counterexamples: int | str = "all", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """The partial codebook of ``refine`` as tables without arrays, for any number of quotes.

    ``(heads, entries)``: ``construct, ord, definition, extra`` of the constructs that gain something, and their
    ``construct, kind, place, digest, quote``: own entries by their place first, then new ones by their digest.
    """
    own = codebook.join(underperforming(pooled, threshold), "construct", "left_semi")
    rows = _of_constructs(comparison, own)
    sides = (("examples", "human_only", "human_quote", n_examples), ("counter_examples", "llm_only", "llm_quote", n_counterexamples))
    old, new = [], []
    for kind, status, column, n in sides:
        entries = own.select("construct", F.posexplode(kind).alias("place", "quote"))
        old.append(entries.select("construct", F.lit(kind).alias("kind"), F.col("place").cast("int").alias("place"), F.lit("").alias("digest"), "quote"))
        fresh = fresh_quotes(rows, entries.select("construct", "quote"), status, column, n, seed)
        new.append(fresh.select("construct", F.lit(kind).alias("kind"), F.lit(None).cast("int").alias("place"), "digest", "quote"))
    gained = materialise(new[0].unionByName(new[1]), "gained")
    heads = own.join(F.broadcast(gained.select("construct").distinct()), "construct", "left_semi").select("construct", "ord", "definition", "extra")
    kept = old[0].unionByName(old[1]).join(F.broadcast(heads.select("construct")), "construct", "left_semi")
    return heads, kept.unionByName(gained)


def refine(comparison: DataFrame, pooled: DataFrame, codebook: DataFrame, threshold: float = 0.8, n_examples: int | str = 50, n_counterexamples: int | str = 50, seed: int = 0) -> DataFrame:
    """Partial codebook: constructs that agree badly, with missed quotes as examples and wrong ones as counter-examples.

    Only constructs of the codebook that gain something are returned, with their own entries first; those it
    lacks are the rows of ``not_in_codebook``.
    """
    own = codebook.join(underperforming(pooled, threshold), "construct", "left_semi")
    rows = _of_constructs(comparison, own)

    def known(c: str) -> DataFrame:
        return own.select("construct", F.explode(c).alias("quote"))

    more = new_quotes(rows, known("examples"), "human_only", "human_quote", n_examples, seed).withColumnRenamed("quotes", "ex")
    less = new_quotes(rows, known("counter_examples"), "llm_only", "llm_quote", n_counterexamples, seed).withColumnRenamed("quotes", "cx")
    none = F.array().cast("array<string>")
    both = own.join(more.join(less, "construct", "full_outer"), "construct")
    add = lambda old, new: F.concat(F.coalesce(old, none), F.coalesce(new, none)).alias(old)
    return both.select("construct", "ord", "definition", add("examples", "ex"), add("counter_examples", "cx"), "extra")


def merge(base: DataFrame, partial: DataFrame) -> DataFrame:
    """Entries of the partial codebook replace the base's whole; new ones come after."""
    own = F.struct("ord", "definition", "examples", "counter_examples", "extra")
    both = base.select("construct", own.alias("b")).join(partial.select("construct", own.alias("p")), "construct", "full_outer")
    e = F.coalesce("p", "b")
    last = base.agg(F.coalesce(F.max("ord"), F.lit(-1))).first()[0]
    order = F.coalesce(F.col("b.ord"), F.col("p.ord") + last + 1).alias("ord")
    return both.select("construct", order, *[e[c].alias(c) for c in ("definition", "examples", "counter_examples", "extra")])


def merged_version(base_version: int, version: int | None = None) -> int:
    return base_version + 1 if version is None else version
