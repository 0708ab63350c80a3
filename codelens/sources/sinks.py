"""What runs write: results, metadata, errors, summaries, comparisons and codebooks."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.codebook import Meta
from ..scratch import folder


def run_id(name: str, at: datetime | None = None) -> str:
    return f"{name}_{(at or datetime.now(UTC)).strftime('%Y-%m-%d_%H%M%S')}"


def run_path(root: str, kind: str, run: str) -> str:
    """Where a run has its part of a table; the name of the run is a partition value."""
    return f"{root}/{kind}/run_id={run}"


def write_run(table: DataFrame, root: str, kind: str, run: str, form: str = "parquet", add: bool = False) -> str:
    """Write a run's part of a table, ``encodings``, ``metadata``, ``errors``, ``summary`` or ``comparison``.

    Runs are partitions of one table, so that a query can read any number of them and prunes the others.
    A run's part is never written over; ``add`` appends to it.
    """
    path = run_path(root, kind, run)
    writer = table.write.mode("append" if add else "errorifexists")
    writer.options(header=True, escape='"').csv(path) if form == "csv" else writer.format(form).save(path)
    return path


def write_ordered(table: DataFrame, root: str, kind: str, run: str) -> str:
    """Write a sorted table as CSV parts that follow one another, each with a header, and a list of them.

    Rows are dealt to parts by ranges of their order, so no task has them all.  ``manifest`` beside the parts
    has a row a part: its place, name and number of rows.
    """
    path = write_run(table, root, kind, run, "csv")
    parts = table.sparkSession.read.csv(path, header=True, schema=table.schema, multiLine=True, escape='"').groupBy(F.col("_metadata.file_name").alias("part")).agg(F.count("*").alias("rows"))
    place = F.row_number().over(Window.orderBy("part")) - 1  # a row a part
    write_run(parts.select(place.alias("place"), "part", "rows"), root, f"{kind}_manifest", run)
    return path


def nested_results(instances: DataFrame, documents: DataFrame) -> DataFrame:
    """``(document_id, instances)`` with a row for documents without any, as saved results have it."""
    own = F.struct("ord", F.struct("construct", "speaker_id", "quote", "quote_index", "confidence").alias("i"))
    some = instances.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(own)), lambda x: x["i"]).alias("instances"))
    return documents.select("doc_id").distinct().join(some, "doc_id", "left").select(F.col("doc_id").alias("document_id"), F.coalesce("instances", F.array()).alias("instances"))


def run_summary(outcomes: DataFrame, run: str, model: str, codebook: str, source: str) -> DataFrame:
    """One row with counts of all, coded and failed documents, and how the failed are spread.

    ``outcomes`` has ``doc_id`` and ``error_message``, null where coding went well.  Failed ids are a table
    of their own, ``failed_ids``, since their number has no bound.
    """
    failed = F.count_if(F.col("error_message").isNotNull())
    return outcomes.agg(F.lit(run).alias("run_id"), F.lit(model).alias("model"), F.lit(codebook).alias("codebook"), F.lit(source).alias("input"), F.count("*").alias("total"), F.count_if(F.col("error_message").isNull()).alias("successful"), failed.alias("failed"))


def failed_ids(outcomes: DataFrame) -> DataFrame:
    return outcomes.where("error_message IS NOT NULL").select("doc_id")


def codebook_json(codebook: DataFrame, meta: Meta) -> DataFrame:
    """The envelope of a codebook as one indented JSON text, its further fields included; a codebook is a small table."""
    known = F.from_json(F.to_json(F.struct("definition", "examples", "counter_examples")), "map<string,variant>")  # without nulls
    rest = F.transform_values(F.coalesce("extra", F.create_map().cast("map<string,string>")), lambda _, v: F.parse_json(v))
    entry = F.map_concat(known, rest)
    ordered = F.array_sort(F.collect_list(F.struct("ord", "construct", F.to_json(entry).alias("e"))))
    book = F.map_from_entries(F.transform(ordered, lambda x: F.struct(x["construct"], F.parse_json(x["e"]))))
    return codebook.agg(F.to_json(F.struct(F.parse_json(F.lit(_about(meta))).alias("metadata"), book.alias("codebook")), {"pretty": "true"}).alias("value"))


def pass_name(base: str, version: int, at: datetime | None = None) -> str:
    """Name of the file of an optimisation pass."""
    return f"{run_id(f'{base}_optimized_codebook_v{version:03d}', at)}.json"


def write_codebook(codebook: DataFrame, meta: Meta, path: str) -> str:
    """Write a codebook as one JSON file, which ``read_codebook`` reads."""
    spark = codebook.sparkSession
    text = codebook_json(codebook, meta).first().value
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    return path


def _about(meta: Meta) -> str:
    about = {"name": meta.name, "version": meta.version, "citation": meta.citation, "built_from": [{"name": n, "version": v} for n, v in meta.built_from]}
    return json.dumps(about | ({"partial": True} if meta.partial else {}), ensure_ascii=False)


def codebook_lines(heads: DataFrame, entries: DataFrame, meta: Meta) -> DataFrame:
    """The lines of a codebook's JSON, a quote a line, with what orders them: no row or task holds a construct's quotes.

    ``heads`` and ``entries`` are those of ``refined_entries``; a comma stands before all but the first of a list.
    """
    kinds = F.create_map(F.lit("examples"), F.lit(1), F.lit("counter_examples"), F.lit(3))
    at = F.struct(F.col("place").isNull().alias("new"), F.coalesce("place", F.lit(0)).alias("place"), "digest", "quote")
    rows = entries.join(heads.select("construct", "ord"), "construct").select("construct", "ord", kinds[F.col("kind")].alias("section"), at.alias("at"), "quote")
    first = rows.groupBy("construct", "section").agg(F.min("at").alias("first"))
    comma = F.when(F.col("at") == F.col("first"), F.lit("")).otherwise(F.lit(","))
    quotes = rows.join(first, ["construct", "section"]).select("ord", "construct", "section", "at", F.concat(F.lit("   "), comma, F.to_json(F.array("quote")).substr(F.lit(2), F.length(F.to_json(F.array("quote"))) - 2)).alias("value"))
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    least = heads.agg(F.min(F.struct("ord", "construct"))).first()[0]
    begin = F.when((F.col("ord") == F.lit(least.ord if least else None)) & (F.col("construct") == F.lit(least.construct if least else None)), F.lit("  ")).otherwise(F.lit("  ,"))
    rest = F.map_entries(F.coalesce("extra", F.create_map().cast("map<string,string>")))
    extra = F.array_join(F.transform(rest, lambda e: F.concat(quoted(e["key"]), F.lit(": "), e["value"], F.lit(", "))), "")
    definition = F.when(F.col("definition").isNotNull(), F.concat(F.lit('"definition": '), quoted("definition"), F.lit(", "))).otherwise(F.lit(""))
    frame = {0: F.concat(begin, quoted("construct"), F.lit(": {"), definition, extra, F.lit('"examples": [')), 2: F.lit('   ], "counter_examples": ['), 4: F.lit("   ]}")}
    none = F.lit(None).cast(quotes.schema["at"].dataType)
    lines = quotes
    for section, value in frame.items():
        lines = lines.unionByName(heads.select("ord", "construct", F.lit(section).alias("section"), none.alias("at"), value.alias("value")))
    ends = [(-1, "", -1, '{"metadata": ' + _about(meta) + ', "codebook": {'), (2**31 - 1, "", 9, "}}")]
    outer = heads.sparkSession.createDataFrame(ends, "ord int, construct string, section int, value string")
    return lines.unionByName(outer.select("ord", "construct", "section", none.alias("at"), "value"))


def write_entries(heads: DataFrame, entries: DataFrame, meta: Meta, path: str) -> str:
    """Write a codebook of any size as one JSON file, which ``read_codebook`` reads.

    Tasks write the lines in parts by ranges of their order, and the parts are copied one after the other, some
    bytes at a time.
    """
    spark = heads.sparkSession
    order = ["ord", "construct", "section", "at"]
    lines = codebook_lines(heads, entries, meta)
    parts = f"{folder(spark)}/codebook-{uuid.uuid4().hex}"
    lines.repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.text(parts)
    hadoop, conf = spark._jvm.org.apache.hadoop, spark.sparkContext._jsc.hadoopConfiguration()
    target, source = hadoop.fs.Path(path), hadoop.fs.Path(parts)
    fs = source.getFileSystem(conf)
    out = target.getFileSystem(conf).create(target, False)
    try:
        for name in sorted(f.getPath().getName() for f in fs.listStatus(source) if f.getPath().getName().startswith("part-")):
            into = fs.open(hadoop.fs.Path(source, name))
            try:
                hadoop.io.IOUtils.copyBytes(into, out, conf, False)
            finally:
                into.close()
    finally:
        out.close()
    fs.delete(source, True)
    return path
