"""Codebooks that take all quotes: written by ranges of lines, equal to the arrays of small ones."""

import json

import pytest

from codelens.operators import codebook as cb
from codelens.operators import metrics
from codelens.schemas import CODEBOOK, COMPARISON
from codelens.scratch import materialise
from codelens.sources import codings, sinks

ODD = ['say "so"', "back\\slash", "two\nlines", "tab\there", "é😀", "[x]", "known"]


def comparison(spark, rows):
    kind = {"human_only": "human_quote", "llm_only": "llm_quote"}
    full = [{"doc_id": str(i % 7), "construct": c, "status": s, kind[s]: q, "tp": 0, "fp": int(s == "llm_only"), "fn": int(s == "human_only")} for i, (c, s, q) in enumerate(rows)]
    return spark.createDataFrame(full, COMPARISON)


@pytest.fixture(scope="module")
def given(spark):
    rows = [("c", "human_only", q) for q in ODD] + [("c", "human_only", f"quote {i}") for i in range(3000)] + [("c", "llm_only", f"wrong {i}") for i in range(20)]
    rows += [("e", "llm_only", "only wrong"), ("absent", "human_only", "x"), ("f", "human_only", "known too")]
    book = [("c", 0, 'a "d"', ["known", "old"], [], {"note": '"n"', "refs": '["r",{"k":1}]'}), ("e", 1, None, [], ["w"], {}), ("f", 2, "d", ["known too"], [], {})]
    return comparison(spark, rows), spark.createDataFrame(book, CODEBOOK)


@pytest.mark.parametrize("n", ["all", 25])
def test_written_entries_are_the_arrays(spark, given, tmp_path, n):
    rows, book = given
    pooled = metrics.summary_tables(rows)[1]
    want = cb.refine(rows, pooled, book, n_examples=n, n_counterexamples=n).orderBy("ord").collect()
    heads, entries = cb.refined_entries(rows, pooled, book, n_examples=n, n_counterexamples=n)
    path = sinks.write_entries(heads, entries, cb.Meta("b", 3, "cite").refined(), f"{tmp_path}/book.json")
    saved = json.loads(open(path).read())
    assert list(saved["codebook"]) == ["c", "e"] and saved["metadata"]["built_from"] == [{"name": "b", "version": 3}] and saved["metadata"]["partial"]
    got = codings.read_codebook(spark, path).orderBy("ord").collect()
    assert [(r.construct, r.definition, r.examples, r.counter_examples, r.extra) for r in got] == [(r.construct, r.definition, r.examples, r.counter_examples, r.extra) for r in want]
    assert len(got[0].examples) == (2 + 3006 if n == "all" else 27)
    assert codings.read_codebook_meta(spark, path) == cb.Meta("b", None, "cite", (("b", 3),), True)


def test_lines_are_in_many_parts(spark, given):
    rows, book = given
    lines = sinks.codebook_lines(*cb.refined_entries(rows, metrics.summary_tables(rows)[1], book), cb.Meta("b"))
    ranged = lines.repartitionByRange(4, "ord", "construct", "section", "at")
    assert sum(1 for n in ranged.rdd.mapPartitions(lambda it: [sum(1 for _ in it)]).collect() if n > 500) == 4


def test_nothing_gained(spark, given, tmp_path):
    rows, book = given
    some = rows.where("construct = 'f'")
    heads, entries = cb.refined_entries(some, metrics.summary_tables(some)[1], book)
    assert heads.count() == 0 and entries.count() == 0
    assert json.loads(open(sinks.write_entries(heads, entries, cb.Meta("b"), f"{tmp_path}/none.json")).read())["codebook"] == {}


def test_sample_is_the_first_by_digest(spark, given):
    """Ranking in parts first gives what one ranking gives."""
    rows, book = given
    none = book.limit(0).selectExpr("construct", "'' AS quote")
    every = sorted((r.digest, r.quote) for r in cb.fresh_quotes(rows, none, "human_only", "human_quote", "all", 1).where("construct = 'c'").collect())
    for n in (1, 40, 5000):
        assert sorted((r.digest, r.quote) for r in cb.fresh_quotes(rows, none, "human_only", "human_quote", n, 1).where("construct = 'c'").collect()) == every[:n]


def test_quotes_are_not_dealt_by_construct(spark, given):
    """Quotes of a construct are told apart in parts: no join lands a construct in one task."""
    rows, book = given
    rows, pooled = materialise(rows, "comparison"), materialise(metrics.summary_tables(rows)[1], "pooled")
    heads, entries = cb.refined_entries(rows, pooled, book, n_examples=25, n_counterexamples=25)
    for out in (cb.refine(rows, pooled, book), entries):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "LeftSemi" not in "".join(line for line in plan.splitlines() if "SortMergeJoin [construct" in line)
