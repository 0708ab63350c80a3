"""Comparing saved results: one file with another, one folder with another."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matching import compare_exact, ordered
from ..scratch import materialise
from ..sources.codings import read_results
from ..sources.sinks import run_id, write_ordered

#: Takes the human's and the model's instances, returns comparison rows.
Compare = Callable[[DataFrame, DataFrame], DataFrame]


def _saved(rows: DataFrame, root: str | None, name: str) -> DataFrame:
    """The rows, also written in order as CSV if there is a ``root``; they are then made once and read back for that."""
    if not root:
        return rows
    out = materialise(rows, "comparison")
    write_ordered(ordered(out), root, "comparison", run_id(name))
    return out


def compare_documents(spark: SparkSession, human: str, llm: str, compare: Compare = compare_exact, root: str | None = None, name: str = "comparison") -> DataFrame:
    """Compare two result files of one document, under the id that the human's file gives."""
    (mine, ids), (other, _) = read_results(spark, human, named=False), read_results(spark, llm, named=False)
    doc = ids.first().doc_id
    both = [side.withColumn("doc_id", F.lit(doc)) for side in (mine, other)]
    return _saved(compare(*both), root, name)


def compare_directories(spark: SparkSession, human: str, llm: str, compare: Compare = compare_exact, root: str | None = None, name: str = "comparison") -> DataFrame:
    """Compare two folders of result files, or runs, by the names of their files; a document may be in one alone.

    With ``root``, the rows are also written as a CSV table under a name with its time.
    """
    return _saved(compare(read_results(spark, human)[0], read_results(spark, llm)[0]), root, name)


def compare_runs(human: DataFrame, results: DataFrame, runs: list[str], compare: Compare = compare_exact) -> DataFrame:
    """Comparison rows of many saved runs with their ``run_id``, each against all of the human coding.

    ``results`` has the runs' instances (``read_run_results``).  A document counts once a run, so the rows of all
    runs are compared in one go.
    """
    # The document first, as sorts compare first letters, which all rows of a run would share.
    one = lambda run, doc: F.to_json(F.array(doc, run))
    mine = human.withColumn("run_id", F.explode(F.array(*[F.lit(r) for r in runs])))
    sides = [side.withColumn("doc_id", one("run_id", "doc_id")).drop("run_id") for side in (mine, results)]
    names = F.from_json("doc_id", "array<string>")
    rows = compare(*sides)
    return rows.select(names[1].alias("run_id"), *[(names[0] if c == "doc_id" else F.col(c)).alias(c) for c in rows.columns])
