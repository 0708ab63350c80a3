"""Sentences, tokens and per-document text metrics, all as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: First-person pronouns that are counted.
FIRST_PERSON = ["i", "me", "my", "myself", "mine", "we", "us", "our", "ourselves", "ours"]
#: Words without content of their own; any list can be given instead.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "but", "by", "for", "from", "has", "he", "her", "his", "i", "in", "is", "it", "not", "of", "on", "or", "she", "that", "the", "they", "this", "to", "was", "we", "were", "with", "you"]
BLANKS = " \t\n\r"


def sentences(text: Column) -> Column:
    parts = F.transform(F.split(text, r"[.!?]+(\s+|$)"), lambda s: F.btrim(s, F.lit(BLANKS)))
    return F.filter(parts, lambda s: s != "")


def tokens(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}_]+"), lambda t: t != "")


def _share(part: Column, whole: Column) -> Column:
    return F.try_divide(part.cast("double"), whole.cast("double"))


def document_metrics(docs: DataFrame, stop_words: Sequence[str] = STOP_WORDS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """One row a document with its counts, shares and readability scores; a map over ``docs``."""
    held = lambda xs: F.size(F.filter("_t", lambda t: t.isin(*xs)))
    base = docs.select(*keep, "text", tokens(F.col("text")).alias("_t"), sentences(F.col("text")).alias("_s"))
    out = base.select(
        *keep,
        F.size("_t").alias("n_tokens"),
        F.size(F.array_distinct("_t")).alias("n_unique_tokens"),
        F.length("text").alias("n_characters"),
        F.size("_s").alias("n_sentences"),
        held(stop_words).alias("n_stop_words"),
        held(FIRST_PERSON).alias("n_first_person"),
        F.regexp_count(F.lower("text"), F.lit(r"(?<![\p{L}\p{N}_])\p{L}++(?![\p{N}_])")).alias("n_alpha"),
        F.regexp_count("text", F.lit(r"\p{L}")).alias("n_letters"),
        F.regexp_count(F.lower("text"), F.lit("[aeiouy]+")).alias("n_syllables"),
        F.size(F.filter("_t", lambda t: t.rlike("[aeiouy][^aeiouy]++[aeiouy]++[^aeiouy]++[aeiouy]"))).alias("n_long_words"),
    )
    c = F.col
    w, s, y, p, l = (c(n).cast("double") for n in ("n_tokens", "n_sentences", "n_syllables", "n_long_words", "n_letters"))
    per_s, per_w = F.try_divide(w, s), lambda x: F.try_divide(x, w)
    return out.withColumns({
        "sentence_length_mean": per_s,
        "type_token_ratio": _share(c("n_unique_tokens"), c("n_tokens")),
        "prop_stop_words": _share(c("n_stop_words"), c("n_tokens")),
        "lexical_density": _share(c("n_tokens") - c("n_stop_words"), c("n_tokens")),
        "prop_1st_person": _share(c("n_first_person"), c("n_tokens")),
        "alpha_ratio": _share(c("n_alpha"), c("n_tokens")),
        "flesch_reading_ease": 206.835 - 1.015 * per_s - 84.6 * per_w(y),
        "flesch_kincaid_grade": 0.39 * per_s + 11.8 * per_w(y) - 15.59,
        "gunning_fog": 0.4 * (per_s + 100 * per_w(p)),
        "coleman_liau_index": 0.0588 * (100 * per_w(l)) - 0.296 * (100 * per_w(s)) - 15.8,
        "automated_readability_index": 4.71 * per_w(l) + 0.5 * per_s - 21.43,
        "smog": 1.043 * F.sqrt(F.try_divide(30 * p, s)) + 3.1291,
    })
