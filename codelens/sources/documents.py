"""Documents from text files, CSV transcripts and tables."""

from __future__ import annotations

import csv
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.spans import strip
from ..scratch import materialise

#: Column names that hold text, that hold speakers, and words that mark other columns.
TEXT_NAMES = ["text", "content", "transcript", "response", "answer"]
SPEAKER_NAMES = ["speaker", "participant", "interviewer", "name"]
OTHER_WORDS = ["speaker", "interviewer", "participant", "id", "name"]


def _file_name():
    return F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))


def text_columns(columns: list[str]) -> list[str]:
    """Columns of a transcript that hold text: known names in their priority, else all that no word excludes."""
    by_name = {c.lower(): c for c in columns}
    known = [by_name[n] for n in TEXT_NAMES if n in by_name]
    return known or [c for c in columns if not any(w in c.lower() for w in OTHER_WORDS)]


def speaker_column(columns: list[str]) -> str | None:
    by_name = {c.lower(): c for c in columns}
    return next((by_name[n] for n in SPEAKER_NAMES if n in by_name), None)


def transcript_line(columns: list[str], within: str | None = None):
    """A row as ``speaker: text ...``; null if it holds nothing.  The columns may be fields ``within`` one."""
    field = lambda c: F.col(within).getField(c) if within else F.col(f"`{c}`")
    value = lambda c: F.nullif(strip(F.coalesce(field(c).cast("string"), F.lit(""))), F.lit(""))
    who = speaker_column(columns)
    parts = ([F.concat(value(who), F.lit(":"))] if who else []) + [value(c) for c in text_columns(columns)]
    return F.nullif(F.concat_ws(" ", *parts), F.lit(""))


def join_turns(rows: DataFrame, keys: list[str], order: str, line: str = "line") -> DataFrame:
    """Lines of a document joined in order; rows without a line are left out."""
    kept = rows.where(F.col(line).isNotNull()).groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(line).alias("l")))).alias("_a"))
    return kept.select(*keys, F.array_join(F.transform("_a", lambda x: x["l"]), "\n").alias("text"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """One document a ``.txt`` file, its id the file's stem; line ends become newlines."""
    rows = spark.read.text(path, wholetext=True, pathGlobFilter="*.[tT][xX][tT]").withColumn("path", _file_name())
    return rows.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("doc_id"), F.regexp_replace("value", r"\r\n?", "\n").alias("text"), "path")


def csv_records(spark: SparkSession, path: str | list[str], quote: str = '"') -> DataFrame:
    """``(path, place, record)``: the records of CSV files in their order, from splits of the files.

    A large file is read by many tasks.  A line's place is the byte at which its split begins and its number in there.
    Whether a split begins inside quotes follows from the quotes of those before it, so a
    record may hold line ends and may lie in several splits.  Quotes inside quotes are doubled.  Blank records are left out.
    """
    lines = spark.read.text(path, pathGlobFilter="*.[cC][sS][vV]")
    marks = F.length("value") - F.length(F.replace("value", F.lit(quote), F.lit("")))
    lines = lines.select(_file_name().alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), "value", (marks % 2).alias("odd"))
    # Written, since rows are numbered as they are read.
    lines = materialise(lines, "lines")
    before = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    inside = Window.partitionBy("path", "split").orderBy("at")

    def prefix(rows: DataFrame, name: str) -> DataFrame:
        """Sums of a column over the splits of a file before each."""
        sums = rows.groupBy("path", "split").agg(F.sum(name).alias("_s"))
        return sums.select("path", "split", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))

    quoted = F.col("_before") + F.sum("odd").over(inside) - F.col("odd")
    begun = lines.join(prefix(lines, "odd"), ["path", "split"]).withColumn("begins", (quoted % 2 == 0).cast("int")).drop("_before")
    begun = materialise(begun, "begun")
    number = F.col("_before") + F.sum("begins").over(inside) - 1
    part = F.struct("split", "at", "value")
    records = begun.join(prefix(begun, "begins"), ["path", "split"]).withColumn("place", number).groupBy("path", "place").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    record = F.array_join(F.transform("parts", lambda x: x["value"]), "\n")
    return records.select("path", "place", F.when(F.col("place") == 0, F.regexp_replace(record, "^\ufeff", "")).otherwise(record).alias("record")).where("record <> ''")


def read_transcript(spark: SparkSession, path: str | list[str], sep: str = ",", quote: str = '"') -> DataFrame:
    """One document a ``.csv`` file of turns, a line a row in the file's order.

    Files of any columns are read in one pass; what reaches the driver is each distinct first record.
    """
    records = materialise(csv_records(spark, path, quote), "records")
    first = records.groupBy("path").agg(F.min_by("record", "place").alias("header"), F.min("place").alias("first"))
    rows = records.join(first, "path").where("place > first")
    parts = []
    for (header,) in first.select("header").distinct().orderBy("header").collect():
        columns = next(csv.reader([header], delimiter=sep, quotechar=quote))
        low = [c.lower() for c in columns]
        named = [c if c and low.index(c.lower()) == i else f"{c}_{i}" for i, c in enumerate(columns)]
        if not text_columns(named):
            raise ValueError("no text column in the transcript")
        kinds = ", ".join(f"`{c.replace('`', '``')}` string" for c in named)
        own = rows.where(F.col("header") == header).select("path", "place", F.from_csv("record", kinds, {"sep": sep, "quote": quote, "escape": quote}).alias("r"))
        parts.append(own.select("path", "place", transcript_line(named, "r").alias("line")))
    turns = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], "path string, place long, line string")
    texts = join_turns(turns, ["path"], "place")
    return texts.select(F.regexp_replace("path", r"\.[^.]*$", "").alias("doc_id"), "text", "path")


def list_documents(spark: SparkSession, folder: str) -> list[str]:
    """Supported files of a folder, not below it, by name; an error if there are none."""
    where = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(where) or not fs.getFileStatus(where).isDirectory():
        raise FileNotFoundError(f"Not a directory: {folder}")
    names = sorted(f.getPath().toString() for f in fs.listStatus(where) if f.isFile() and re.search(r"\.(txt|csv)$", f.getPath().getName(), re.I))
    if not names:
        raise FileNotFoundError(f"No .txt or .csv files in {folder}")
    return names


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """A file by its suffix, or all supported files of a folder."""
    if re.search(r"\.txt$", path, re.I):
        return read_text(spark, path)
    if re.search(r"\.csv$", path, re.I):
        return read_transcript(spark, path)
    if re.search(r"\.\w+$", path):
        raise ValueError(f"Unsupported file type: {path}")
    names = list_documents(spark, path)
    tables = [n for n in names if n.lower().endswith(".csv")]
    parts = [read_transcript(spark, tables)] if tables else []
    if len(tables) < len(names):
        parts.append(read_text(spark, path))
    return reduce(DataFrame.unionByName, parts)


def suffix_duplicates(rows: DataFrame, id_col: str = "doc_id", order: str = "pos") -> DataFrame:
    """The n-th row of an id, from the second on, gets ``_n``.

    Rows are numbered within blocks of the whole-number ``order``, and blocks by sums of those before, so an
    id may have any number of rows.
    """
    block = F.shiftright(F.col(order).cast("long"), 16).alias("_b")
    before = F.sum("_c").over(Window.partitionBy("_i").orderBy("_k").rowsBetween(Window.unboundedPreceding, -1))
    blocks = rows.groupBy(F.col(id_col).alias("_i"), block.alias("_k")).agg(F.count("*").alias("_c")).select("_i", "_k", F.coalesce(before, F.lit(0)).alias("_before"))
    own = rows.withColumn("_b", block)
    nth = F.row_number().over(Window.partitionBy(id_col, "_b").orderBy(order)) + F.col("_before")
    out = own.join(blocks, own[id_col].eqNullSafe(blocks["_i"]) & own["_b"].eqNullSafe(blocks["_k"])).withColumn("_n", nth)
    return out.withColumn(id_col, F.when(F.col("_n") > 1, F.concat(F.col(id_col), F.lit("_"), F.col("_n"))).otherwise(F.col(id_col))).select(*rows.columns)


def check_unique(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    clash = rows.groupBy(id_col).count().where("count > 1").limit(1).collect()
    if clash:
        raise ValueError(f"document id given twice after suffixing: {clash[0][0]}")
    return rows


def numbered(rows: DataFrame, name: str) -> DataFrame:
    """``rows``, written once, with their places 0 to N - 1 in the order of partitions and their rows."""
    marked = materialise(rows.withColumn(name, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(name, 33)
    before = F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = marked.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row a partition
    offsets = F.broadcast(counts.select(F.col("part").alias("_part"), F.coalesce(before, F.lit(0)).alias("_before")))
    place = F.col("_before") + F.col(name).bitwiseAND((1 << 33) - 1)
    return marked.join(offsets, part == F.col("_part")).withColumn(name, place).drop("_part", "_before")


def rows_as_documents(rows: DataFrame, text_column: str, id_column: str | None = None, order: str | None = None) -> DataFrame:
    """Each row of a table as a document: ``doc_id, text, pos``; a row without a text keeps its place.

    ``pos`` is a row's place, from 0, by the column ``order``, or without it in the order in which Spark
    reads the rows.  It is the id where no column holds one.
    """
    missing = [c for c in (text_column, id_column, order) if c and c not in rows.columns]
    if missing:
        raise ValueError(f"Missing columns: {', '.join(missing)}")
    given = strip(F.col(id_column).cast("string")) if id_column else F.lit(None).cast("string")
    out = (rows.orderBy(order) if order else rows).select(given.alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    out = numbered(out, "pos")
    if id_column is None:
        return out.withColumn("doc_id", F.col("pos").cast("string"))
    return suffix_duplicates(out)
