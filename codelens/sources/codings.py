"""Human codings, saved results, error records and codebooks."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.spans import find_quote, parse_range, strip  # noqa: F401
from ..operators.codebook import Meta
from ..schemas import ERRORS

RESULT = "document_id string, instances array<struct<construct:string,speaker_id:string,quote:string,quote_index:string,confidence:int>>"


def split_codes(c, separator: str = ","):
    """Names in a cell, stripped, without empty ones."""
    parts = F.split(c, r"\Q" + separator + r"\E")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def human_codings(rows: DataFrame, doc_id_col: str, quote_col: str, construct_col: str, range_col: str | None = None, range_format: str = "dash", separator: str = ",") -> tuple[DataFrame, DataFrame]:
    """Coded excerpts to ``(instances, coded documents)``: an instance a construct, documents without any kept."""
    needed = [doc_id_col, quote_col, construct_col] + ([range_col] if range_col else [])
    missing = [c for c in needed if c not in rows.columns]
    if missing:
        raise ValueError(f"missing required columns: {', '.join(missing)}")
    kept = rows.dropna(subset=[doc_id_col, quote_col, construct_col])
    span = parse_range(F.col(range_col).cast("string"), range_format) if range_col else F.lit(None).cast("string")
    flat = kept.select(strip(F.col(doc_id_col).cast("string")).alias("doc_id"), strip(F.col(quote_col).cast("string")).alias("quote"), span.alias("quote_index"), split_codes(F.col(construct_col).cast("string"), separator).alias("codes"))
    one = flat.select("doc_id", "quote", "quote_index", F.posexplode("codes").alias("ord", "construct"))
    instances = one.select("doc_id", "construct", "ord", F.lit(None).cast("string").alias("speaker_id"), "quote", "quote_index", F.lit(None).cast("int").alias("confidence"))
    return instances, flat.select("doc_id").distinct()


def read_human_coding(spark: SparkSession, path: str, options: dict[str, str] | None = None, **columns: str) -> tuple[DataFrame, DataFrame]:
    """A CSV or TSV table of coded excerpts (see ``human_codings``)."""
    sep = {".csv": ",", ".tsv": "\t"}.get(path[path.rfind(".") :].lower())
    if sep is None:
        raise ValueError(f"Unsupported file extension: {path}")
    rows = spark.read.options(**({"header": "true", "multiLine": "true", "sep": sep} | (options or {}))).csv(path)
    return human_codings(rows, **columns)


def _flat(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    flat = rows.select("doc_id", F.posexplode("instances").alias("ord", "i"))
    return flat.select("doc_id", "i.construct", "ord", "i.speaker_id", "i.quote", "i.quote_index", "i.confidence"), rows.select("doc_id")


def read_results(spark: SparkSession, path: str, named: bool = True) -> tuple[DataFrame, DataFrame]:
    """Saved results as ``(instances, documents)``: a run's part of ``encodings``, or result files or their folder; an invalid file fails.

    A run is Parquet; other results are a JSON file a document, which then bears the name of its file,
    or the id that the file gives, if it is not ``named``.
    """
    below = spark._jvm.org.apache.hadoop.fs.Path(path, "encodings")
    fs = below.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    where = below.toString() if fs.exists(below) else path
    if fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(where, "*.parquet")):
        return _flat(spark.read.schema(RESULT).parquet(where).withColumnRenamed("document_id", "doc_id"))
    rows = spark.read.schema(RESULT).json(where, multiLine=True, mode="FAILFAST", pathGlobFilter="*.json")
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    rows = rows.select((F.regexp_replace(name, r"\.json$", "") if named else F.col("document_id")).alias("doc_id"), "instances")
    return _flat(rows)


def read_runs(spark: SparkSession, root: str, kind: str, schema: str, runs: list[str] | None = None) -> DataFrame:
    """One table of many runs with their ``run_id``; ``runs`` selects partitions, and other runs are not read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(root, kind)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], f"{schema}, run_id string")
    rows = spark.read.schema(f"{schema}, run_id string").parquet(where.toString())
    return rows if runs is None else rows.where(F.col("run_id").isin(runs))


def read_run_results(spark: SparkSession, root: str, runs: list[str] | None = None) -> DataFrame:
    """``run_id`` and the instances of many runs."""
    rows = read_runs(spark, root, "encodings", RESULT, runs)
    flat = rows.select("run_id", F.col("document_id").alias("doc_id"), F.posexplode("instances").alias("ord", "i"))
    return flat.select("run_id", "doc_id", "i.construct", "ord", "i.speaker_id", "i.quote", "i.quote_index", "i.confidence")


def read_errors(spark: SparkSession, root: str, run: str) -> DataFrame:
    """Error records of a run's documents that have no result, the last of each; none if there are no errors."""
    rows = read_runs(spark, root, "errors", ERRORS, [run])
    done = read_runs(spark, root, "encodings", RESULT, [run]).select(F.col("document_id").alias("doc_id"))
    last = rows.join(done, "doc_id", "left_anti").groupBy("doc_id").agg(F.max_by(F.struct("document_path", "error_message", "model_used", "ts"), "ts").alias("e"))
    return last.select("doc_id", "e.*")


def read_error_files(spark: SparkSession, folder: str) -> DataFrame:
    """Error records that are a JSON file each, named ``..._error.json``; a malformed one fails, and a missing folder has none."""
    try:
        rows = spark.read.schema(ERRORS.replace("ts timestamp", "timestamp timestamp").replace("doc_id", "document_id")).json(folder, multiLine=True, mode="FAILFAST", pathGlobFilter="*_error.json")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], ERRORS)
    return rows.withColumnsRenamed({"document_id": "doc_id", "timestamp": "ts"})


ENTRY = "struct<definition:string,examples:array<string>,counter_examples:array<string>>"


def parse_codebook(texts: DataFrame) -> DataFrame:
    """JSON in ``value`` (an envelope or the flat form) to codebook rows, in the order of its keys.

    Fields that the library does not know are kept in ``extra``, as JSON.
    """
    known = F.coalesce(
        F.from_json(F.get_json_object("value", "$.codebook"), f"map<string,{ENTRY}>"),
        F.when(F.get_json_object("value", "$.codebook").isNull(), F.from_json("value", f"map<string,{ENTRY}>")),
    )
    raw = F.coalesce(F.get_json_object("value", "$.codebook"), F.col("value"))
    extra = F.from_json(raw, "map<string,map<string,variant>>")
    rows = texts.select(F.posexplode(known).alias("ord", "construct", "e"), extra.alias("x"))
    fields = ["definition", "examples", "counter_examples"]
    rest = F.transform_values(F.map_filter(F.col("x")[F.col("construct")], lambda k, _: ~k.isin(fields)), lambda _, v: F.to_json(v))
    return rows.where("construct <> 'metadata' OR e IS NOT NULL").select("construct", "ord", "e.definition", "e.examples", "e.counter_examples", rest.alias("extra"))


def _codebook_text(spark: SparkSession, path: str) -> DataFrame:
    if not path.lower().endswith(".json"):
        raise ValueError(f"Codebook must be a .json file: {path}")
    texts = spark.read.text(path, wholetext=True)
    if texts.where(F.try_parse_json("value").isNull()).limit(1).count():
        raise ValueError(f"Invalid JSON in codebook: {path}")
    return texts


def read_codebook(spark: SparkSession, path: str) -> DataFrame:
    """A codebook file; it must be JSON."""
    return parse_codebook(_codebook_text(spark, path))


def read_codebook_meta(spark: SparkSession, path: str) -> Meta:
    """Name, version, citation and lineage of a codebook file; those of a new codebook for the flat form."""
    found = json.loads(_codebook_text(spark, path).first().value).get("metadata")
    if not isinstance(found, dict):
        return Meta()
    built = tuple((b.get("name", ""), b.get("version")) for b in found.get("built_from") or [])
    return Meta(found.get("name", ""), found.get("version"), found.get("citation", ""), built, bool(found.get("partial")))
