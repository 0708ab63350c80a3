"""Corpus description: metrics over all documents, and aggregates of annotation tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Label, column and form of each row of the summary, in order; labels are fixed values.
ROWS = [
    ("Document length (words)", "n_tokens", "range"),
    ("Sentences per document", "n_sentences", "range"),
    ("Sentence length (words)", "sentence_length_mean", "range"),
    ("Tokens per document", "n_tokens", "range"),
    ("Unique tokens per document", "n_unique_tokens", "range"),
    ("Type-token ratio (TTR)", "type_token_ratio", "range"),
    ("Characters per document", "n_characters", "range"),
    ("Stop words per document (N)", "n_stop_words", "range"),
    ("Stop words (%)", "prop_stop_words", "percent"),
    ("1st-person pronoun proportion", "prop_1st_person", "percent"),
    ("Lexical density (content words %)", "lexical_density", "percent"),
    ("Alpha-token ratio", "alpha_ratio", "range"),
]
READABILITY = [
    ("Flesch Reading Ease", "flesch_reading_ease", "range"),
    ("Flesch–Kincaid Grade", "flesch_kincaid_grade", "range"),
    ("Gunning Fog Index", "gunning_fog", "range"),
    ("Coleman–Liau Index", "coleman_liau_index", "range"),
    ("Automated Readability Index (ARI)", "automated_readability_index", "range"),
    ("SMOG", "smog", "range"),
]
EXTRA = [
    *[(f"Proportion {p}", f"pos_prop_{p}", "percent") for p in ("NOUN", "VERB", "ADJ", "ADV", "PRON")],
    ("Dependency distance (mean)", "dependency_distance_mean", "range"),
    ("Dependency distance (SD across sentences)", "dependency_distance_std", "range"),
    ("Parse tree depth (mean)", "mean_tree_depth", "range"),
    ("Semantic coherence — SBERT (cosine sim.)", "coherence_sbert", "range"),
]


def _shown(form: str, decimals: int) -> Column:
    digits = "0" + "." * (decimals > 0) + "0" * decimals
    k, unit = ("100 * ", "%") if form == "percent" else ("", "")
    number = lambda c: F.coalesce(F.expr(f"format_number({k}{c}, '{digits}')"), F.lit("nan"))
    return F.concat(number("mean"), F.lit(f"{unit} ("), number("sd"), F.lit(f"{unit}) ["), number("min"), F.lit(f"{unit}–"), number("max"), F.lit(f"{unit}]"))


def summarize(metrics: DataFrame, readability: bool = False, decimals: int = 2) -> DataFrame:
    """``position, metric, n, mean, sd, min, max, value``: one pass over the per-document metrics.

    Rows whose column is missing are left out; a metric that is null everywhere shows ``N/A``.
    """
    wanted = [r for r in ROWS + (READABILITY if readability else []) + EXTRA if r[1] in metrics.columns]
    columns = list(dict.fromkeys(r[1] for r in wanted))
    aggregates = [F.count("*").alias("all")]
    for c in columns:
        v = F.col(c).cast("double")
        aggregates += [F.count(v).alias(f"{c}__n"), F.avg(v).alias(f"{c}__mean"), F.stddev_samp(v).alias(f"{c}__sd"), F.min(v).alias(f"{c}__min"), F.max(v).alias(f"{c}__max")]
    one = metrics.agg(*aggregates)
    null = F.lit(None).cast("double")
    first = F.struct(F.lit(0).alias("position"), F.lit("N (documents)").alias("metric"), F.lit("count").alias("form"), F.col("all").alias("n"), *[null.alias(s) for s in ("mean", "sd", "min", "max")])
    rest = [F.struct(F.lit(i + 1).alias("position"), F.lit(label).alias("metric"), F.lit(form).alias("form"), F.col(f"{c}__n").alias("n"), *[F.col(f"{c}__{s}").alias(s) for s in ("mean", "sd", "min", "max")]) for i, (label, c, form) in enumerate(wanted)]
    rows = one.select(F.inline(F.array(first, *rest)))
    value = F.when(F.col("form") == "count", F.col("n").cast("string")).when(F.col("n") == 0, F.lit("N/A")).when(F.col("form") == "percent", _shown("percent", decimals)).otherwise(_shown("range", decimals))
    return rows.withColumn("value", value).drop("form")


def pos_proportions(tokens: DataFrame) -> DataFrame:
    """Shares of part-of-speech tags of ``tokens(doc_id, sent, i, pos, head)``."""
    return tokens.groupBy("doc_id").agg(*[(F.count_if(F.col("pos") == p) / F.count("*")).alias(f"pos_prop_{p}") for p in ("NOUN", "VERB", "ADJ", "ADV", "PRON")])


def sentence_complexity(tokens: DataFrame, rounds: int = 16) -> DataFrame:
    """Dependency distance and tree depth of each document, over its sentences.

    A root is its own head.  Depths come from pointer doubling inside a sentence, in as many rounds as its
    number of words has binary digits, but at most ``rounds``, which reach trees of a depth of two to that
    power.  Sentences without a root have no depth.
    """
    by = tokens.groupBy("doc_id", "sent").agg(F.array_sort(F.collect_list(F.struct("i", "head"))).alias("a"), F.avg(F.abs(F.col("i") - F.col("head")).cast("double")).alias("distance"))
    at = F.transform("a", lambda x: F.array_position(F.transform("a", lambda y: y["i"]), x["head"]).cast("int") - 1)
    dense = F.forall("a", lambda x: x["i"] < F.size("a"))  # places 0 to n - 1: heads are places
    heads = F.when(dense & (F.get("a", 0)["i"] == 0), F.transform("a", lambda x: x["head"].cast("int"))).otherwise(at)
    by = by.withColumn("h", heads)
    start = F.struct(F.col("h").alias("up"), F.transform("h", lambda x, i: (x != i).cast("int")).alias("d"))
    step = lambda s, _: F.struct(F.transform(s["up"], lambda x: F.get(s["up"], x)).alias("up"), F.transform(s["d"], lambda d, i: d + F.get(s["d"], F.get(s["up"], i))).alias("d"))
    done = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(rounds), F.length(F.bin(F.size("h"))))), start, step)
    rooted = F.exists("h", lambda x: x.isNotNull()) & F.exists(F.transform("h", lambda x, i: x == i), lambda x: x)
    by = by.withColumn("depth", F.when(rooted, F.array_max(F.transform(done["d"], lambda x: x))))
    return by.groupBy("doc_id").agg(F.avg("distance").alias("dependency_distance_mean"), F.stddev_samp("distance").alias("dependency_distance_std"), F.avg("depth").alias("mean_tree_depth"))


def coherence(sentences: DataFrame) -> DataFrame:
    """Mean cosine of neighbouring sentences' embeddings of ``(doc_id, sent, embedding)``; null for one sentence."""
    unit = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = sentences.select("doc_id", "sent", v.alias("v")).withColumn("norm", unit(F.col("v")))
    order = Window.partitionBy("doc_id").orderBy("sent")
    pair = rows.withColumns({"pv": F.lag("v").over(order), "pn": F.lag("norm").over(order)})
    dot = F.aggregate(F.zip_with("v", "pv", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    return pair.groupBy("doc_id").agg(F.avg(F.when(F.col("pv").isNotNull(), F.try_divide(dot, F.col("norm") * F.col("pn")))).alias("coherence_sbert"))
