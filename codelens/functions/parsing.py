"""Responses of coders and matchers: lenient JSON, with an error for each way to be wrong."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spans import find_quote


def validate_responses(responses: DataFrame, items: str = "instances") -> DataFrame:
    """``responses`` with ``parsed`` (a variant, null if wrong) and ``invalid`` (what is wrong, else null)."""
    v = responses.withColumn("parsed", F.try_parse_json("response_text"))
    kind = F.expr(f"schema_of_variant(try_variant_get(parsed, '$.{items}', 'variant'))")
    wrong = (
        F.when(F.col("response_text").isNull(), F.lit("No response"))
        .when(F.col("parsed").isNull(), F.lit("Invalid JSON"))
        .when(~F.coalesce(F.expr("schema_of_variant(parsed) LIKE 'OBJECT%'"), F.lit(False)), F.lit("Not an object"))
        .when(~F.coalesce(kind.startswith("ARRAY"), F.lit(False)), F.lit(f"No list of {items}"))
    )
    return v.withColumn("invalid", wrong).withColumn("parsed", F.when(wrong.isNull(), F.col("parsed")))


def _field(name: str, kind: str) -> str:
    return f"try_variant_get(value, '$.{name}', '{kind}')"


def _text_or(name: str, default: str) -> str:
    """A JSON string, the default if the field is missing; null for JSON null and other types."""
    v = _field(name, "variant")
    return f"CASE WHEN {v} IS NULL THEN {default} WHEN schema_of_variant({v}) = 'STRING' THEN {_field(name, 'string')} END"


def extract_instances(valid: DataFrame, keep_text: bool = False) -> DataFrame:
    """One row an item of the list: ``doc_id, construct, ord, speaker_id, quote, quote_index, confidence``.

    ``valid`` has ``doc_id``, ``text`` and ``parsed``.  A missing construct is ``Unknown``, a missing quote is
    empty, a missing confidence 1; confidences are cut to whole numbers.  Items that are no objects, or have
    a wrong type or a confidence outside 0 to 2, are dropped.  ``keep_text`` gives the text in place of
    ``quote_index``, for quotes that are located afterwards.
    """
    conf = _field("confidence", "variant")
    rows = valid.sparkSession.sql(f"""
        SELECT doc_id, text, pos AS ord, {_text_or('construct', "'Unknown'")} AS construct, {_text_or('quote', "''")} AS quote,
          {_text_or('speaker_id', 'NULL')} AS speaker_id,
          {_field('speaker_id', 'variant')} IS NULL OR is_variant_null({_field('speaker_id', 'variant')}) OR schema_of_variant({_field('speaker_id', 'variant')}) = 'STRING' AS speaker_ok,
          CASE WHEN {conf} IS NULL THEN 1 WHEN is_variant_null({conf}) THEN NULL
            WHEN schema_of_variant({conf}) LIKE 'DECIMAL%' OR schema_of_variant({conf}) = 'DOUBLE' THEN CAST({_field('confidence', 'double')} AS INT)
            ELSE {_field('confidence', 'int')} END AS confidence
        FROM {{valid}}, LATERAL variant_explode(variant_get(parsed, '$.instances', 'variant'))
        WHERE parsed IS NOT NULL AND schema_of_variant(value) LIKE 'OBJECT%'""", valid=valid)
    rows = rows.where("construct IS NOT NULL AND quote IS NOT NULL AND speaker_ok AND confidence BETWEEN 0 AND 2")
    return rows.select("doc_id", "construct", F.col("ord").cast("int").alias("ord"), "speaker_id", "quote", F.col("text") if keep_text else find_quote(F.col("text"), F.col("quote")).alias("quote_index"), "confidence")


def extract_matches(valid: DataFrame) -> DataFrame:
    """Proposals of a matcher: ``doc_id, construct, ord, human_index, llm_index, paraphrase, match_confidence``.

    A missing confidence is 0.5 and any is held within 0 and 1; paraphrase is false if missing; items without
    two whole indices are dropped.
    """
    para = _field("paraphrase", "variant")
    rows = valid.sparkSession.sql(f"""
        SELECT doc_id, construct, CAST(pos AS INT) AS ord, {_field('human_index', 'int')} AS human_index, {_field('llm_index', 'int')} AS llm_index,
          CASE WHEN {para} IS NULL THEN false WHEN schema_of_variant({para}) = 'STRING' THEN {_field('paraphrase', 'string')} <> ''
            ELSE coalesce({_field('paraphrase', 'boolean')}, false) END AS paraphrase,
          CASE WHEN {_field('match_confidence', 'variant')} IS NULL THEN 0.5D ELSE {_field('match_confidence', 'double')} END AS match_confidence
        FROM {{valid}}, LATERAL variant_explode(variant_get(parsed, '$.matches', 'variant'))
        WHERE parsed IS NOT NULL AND schema_of_variant(value) LIKE 'OBJECT%'""", valid=valid)
    rows = rows.where("human_index IS NOT NULL AND llm_index IS NOT NULL AND match_confidence IS NOT NULL")
    return rows.withColumn("match_confidence", F.least(F.greatest("match_confidence", F.lit(0.0)), F.lit(1.0)))


def first_success(responses: DataFrame) -> DataFrame:
    """For each document its first valid attempt, else the last one's error.

    ``responses`` has been validated; added are ``num_retries`` and, on failure, ``error_message``.
    """
    own = F.struct(*[c for c in responses.columns if c != "doc_id"])
    ok = F.col("invalid").isNull()
    best = responses.groupBy("doc_id").agg(F.min_by(F.when(ok, own), F.when(ok, F.col("attempt"))).alias("good"), F.max_by(own, "attempt").alias("last"), F.count("*").alias("attempts"))
    pick = best.select("doc_id", "attempts", F.col("good").isNotNull().alias("ok"), F.coalesce("good", "last").alias("r"))
    failed = F.concat(F.lit("Failed after "), F.col("attempts"), F.lit(" attempts: "), F.col("r.invalid"))
    return pick.select("doc_id", "r.response_text", "r.parsed", F.col("r.attempt").alias("num_retries"), F.when(~F.col("ok"), failed).alias("error_message"))
