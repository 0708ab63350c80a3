"""Agreement metrics: counts, pooled and per document, PR-AUC and weighted summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import METRICS, OVERALL
from ..scratch import materialise

#: Values that a key's window holds, and ranges into which more are cut.
MOST, CUTS = 1 << 16, 64
ALL = [*METRICS, "pr_auc"]
COUNTS = ["tp", "fp", "fn"]


def with_metrics(counts: DataFrame) -> DataFrame:
    """``union`` and the metrics of ``tp, fp, fn``; null where a denominator is zero."""
    tp, fp, fn = (F.col(c) for c in COUNTS)
    ratio = lambda a, b: F.try_divide(a.cast("double"), b.cast("double"))
    union = tp + fp + fn
    return counts.withColumns({"union": union, "sensitivity": ratio(tp, tp + fn), "precision": ratio(tp, tp + fp), "f1": ratio(2 * tp, 2 * tp + fp + fn), "pabak": 2 * ratio(tp, union) - 1})


def _sums() -> list[Column]:
    return [F.sum(F.col(c).cast("long")).alias(c) for c in COUNTS]


def _rounded(df: DataFrame, names: list[str]) -> DataFrame:
    return df.withColumns({n: F.bround(n, 4) for n in names})


def rounded(per_doc: DataFrame) -> DataFrame:
    """Metrics of each document and construct to four places, as they are shown."""
    return _rounded(per_doc, METRICS)


def pr_auc(comparison: DataFrame, keys: list[str]) -> DataFrame:
    """Average precision of the LLM's confidences for each key; null unless both labels occur.

    Predictions are summed by score before the window, so a window sees a row a score.
    """
    preds = comparison.where("status IN ('matched', 'llm_only') AND llm_confidence IS NOT NULL")
    by = preds.groupBy(*keys, "llm_confidence").agg(F.sum((F.col("status") == "matched").cast("long")).alias("t"), F.count("*").alias("n"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    up = part.orderBy(F.desc("llm_confidence")).rowsBetween(Window.unboundedPreceding, 0)
    cum = by.withColumns({"ct": F.sum("t").over(up), "cn": F.sum("n").over(up), "p": F.sum("t").over(part), "all": F.sum("n").over(part)})
    term = F.col("t") / F.col("p") * F.col("ct") / F.col("cn")
    out = cum.where("p > 0 AND p < all").groupBy(*keys).agg(F.bround(F.sum(term), 4).alias("pr_auc"))
    return out if keys else out.where("pr_auc IS NOT NULL")


def document_counts(comparison: DataFrame) -> DataFrame:
    """Counts of each document and construct, with their metrics but PR-AUC."""
    return with_metrics(comparison.groupBy("doc_id", "construct").agg(*_sums()))


def per_document(comparison: DataFrame) -> DataFrame:
    """Unrounded metrics of each document and construct (PR-AUC is rounded as it is computed)."""
    keys = ["doc_id", "construct"]
    return document_counts(comparison).join(pr_auc(comparison, keys), keys, "left")


def document_stats(per_doc: DataFrame) -> DataFrame:
    """``construct, is_overall, n_docs, p5, p95`` of the counts of each document and construct.

    Documents without a construct count as zeros.  They enter the exact percentiles as one row whose
    frequency is their number, so no grid of documents and constructs is built.
    """
    rows = per_doc.select("doc_id", "construct", F.col("union").alias("u"))
    total = F.broadcast(rows.agg(F.countDistinct("doc_id").alias("docs"), F.countDistinct("construct").alias("constructs")))  # one row
    by = rows.groupBy("construct", "u").agg(F.count("*").alias("n"))
    flagged = by.select(F.lit(False).alias("is_overall"), "construct", "u", "n").unionByName(by.select(F.lit(True).alias("is_overall"), F.lit(OVERALL).alias("construct"), "u", "n"))
    there = flagged.groupBy("is_overall", "construct").agg(F.sum("n").alias("n"))
    there = there.join(total)
    possible = F.when(F.col("is_overall"), F.col("docs") * F.col("constructs")).otherwise(F.col("docs"))
    zeros = there.select("is_overall", "construct", F.lit(0).cast("long").alias("u"), (possible - F.col("n")).alias("n")).where("n > 0")
    p = F.percentile("u", F.array(F.lit(0.05), F.lit(0.95)), F.col("n"))
    out = flagged.unionByName(zeros).groupBy("is_overall", "construct").agg(p.alias("p"))
    n_docs = F.when(F.col("is_overall"), F.col("docs")).otherwise(F.col("n"))
    return there.join(out, ["is_overall", "construct"]).select("is_overall", "construct", n_docs.cast("long").alias("n_docs"), F.bround(F.col("p")[0], 2).alias("p5"), F.bround(F.col("p")[1], 2).alias("p95"))


def pooled(comparison: DataFrame, per_doc: DataFrame) -> DataFrame:
    """A row a construct and one over all, flagged ``is_overall`` (a construct may bear that name)."""
    by = comparison.groupingSets([["construct"], []], "construct").agg(*_sums(), F.grouping("construct").alias("g"))
    named = by.select((F.col("g") == 1).alias("is_overall"), F.when(F.col("g") == 1, F.lit(OVERALL)).otherwise(F.col("construct")).alias("construct"), *COUNTS)
    named = named.where("tp IS NOT NULL")
    auc = pr_auc(comparison, ["construct"]).withColumn("is_overall", F.lit(False)).unionByName(pr_auc(comparison, []).withColumns({"construct": F.lit(OVERALL), "is_overall": F.lit(True)}))
    keys = ["is_overall", "construct"]
    out = with_metrics(named).join(document_stats(per_doc), keys, "left").join(auc, keys, "left")
    return _rounded(out, METRICS).orderBy(*keys)


def weighted_median(rows: DataFrame, keys: list[str], value: str, weight: str, most: int = MOST) -> DataFrame:
    """Smallest value whose weight, with those of smaller ones, reaches half of all; equal values are summed first.

    Only a key with up to ``most`` values is summed up in a window.  Where there are more, a key's values
    are cut at some of their quantiles, sums of the ranges tell in which one half is reached, and only that
    range goes on.  Cuts that do not divide a key's values, as for one value alone, do not occur, since values are distinct.
    """
    by = materialise(rows.groupBy(*keys, value).agg(F.sum(weight).alias("_w")), "weights")
    same = lambda a, b: [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys]
    ends = by.groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.sum("_w").alias("_t"))
    left = by.withColumn("_before", F.lit(0).cast("long"))
    totals = materialise(ends, "totals")
    while not left.groupBy(*keys).count().where(F.col("count") > most).isEmpty():
        cuts = left.groupBy(*keys).agg(F.percentile_approx(value, [k / CUTS for k in range(1, CUTS)], 100 * CUTS).alias("_cuts"), F.count("*").alias("_n"))
        of = F.when(F.col("_n") > most, F.size(F.filter("_cuts", lambda c: c < F.col(f"l.{value}")))).otherwise(0)
        ranged = materialise(left.alias("l").join(cuts.alias("c"), same("l", "c")).select("l.*", of.alias("_range")), "ranges")
        sums = ranged.groupBy(*keys, "_range").agg(F.sum("_w").alias("_s"), F.max("_before").alias("_before"))
        up = Window.partitionBy(*keys).orderBy("_range")  # a row a range
        upto = sums.withColumn("_upto", F.col("_before") + F.sum("_s").over(up))
        reached = upto.alias("u").join(totals.alias("t"), same("u", "t")).where("2 * u._upto >= t._t")
        here = reached.groupBy(*[F.col(f"u.{k}") for k in keys]).agg(F.min("_range").alias("_range"), F.min_by(F.col("_upto") - F.col("_s"), "_range").alias("_before"))
        one = ranged.alias("l").join(here.alias("h"), [*same("l", "h"), F.col("l._range") == F.col("h._range")])
        left = materialise(one.select(*[F.col(f"l.{c}") for c in (*keys, value, "_w")], "h._before"), "weights")
    cum = left.withColumn("_c", F.col("_before") + F.sum("_w").over(Window.partitionBy(*keys).orderBy(value)))
    half = cum.alias("c").join(totals.alias("t"), same("c", "t")).where("2 * c._c >= t._t")
    found = half.groupBy(*[F.col(f"c.{k}") for k in keys]).agg(F.min(value).alias("median"))
    return totals.alias("t").join(found.alias("f"), same("t", "f"), "left").select(*[F.col(f"t.{k}") for k in keys], "median", "min", "max")


def weighted_summary(per_doc: DataFrame) -> DataFrame:
    """For each construct, and over all, the union-weighted median and the range of each metric over documents."""
    keys = ["is_overall", "construct"]
    both = per_doc.withColumn("is_overall", F.lit(False)).unionByName(per_doc.withColumns({"is_overall": F.lit(True), "construct": F.lit(OVERALL)}))
    counts = both.groupBy(*keys).agg(*_sums())
    long = both.unpivot([*keys, "union"], ALL, "metric", "value").where("value IS NOT NULL AND union > 0")
    each = weighted_median(long, [*keys, "metric"], "value", "union")
    wide = [F.max(F.when(F.col("metric") == m, F.bround(s, 4))).alias(f"{m}_{s}") for m in ALL for s in ("median", "min", "max")]
    out = counts.join(each.groupBy(*keys).agg(*wide), keys, "left")
    return out.join(document_stats(per_doc), keys, "left").orderBy(*keys)


def pooled_summary(comparison: DataFrame) -> DataFrame:
    """The pooled table alone, without what only the others need."""
    return pooled(comparison, document_counts(comparison))


def summary_tables(comparison: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(per_doc, pooled, weighted)``; metrics are rounded to four places, weighted ones after weighing."""
    exact = per_document(comparison)
    return _rounded(exact, METRICS), pooled(comparison, exact), weighted_summary(exact)
