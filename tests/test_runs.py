"""Coding runs that fail: attempts, stores of responses, killed tasks, matchers, retries of saved runs, fuzzy places."""

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from codelens.plans import queries as core
from codelens.plans.coding import MatcherError, call_coder, code_rows, code_table, compare_by_matcher, lexicon_coder, retry_run
from codelens.plans.responses import check, read_store
from codelens.schemas import CODEBOOK, INSTANCES
from codelens.sources import codings, sinks

NO_BOOK = []


def docs_of(spark, texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def counting(log, answer):
    """A coder that writes down which document it was asked about; ``answer`` gets its text and how often it was asked before."""

    def make():
        def code(prompt):
            text = prompt.partition("\nText:\n")[2].partition("\n\nAnswer with JSON")[0]
            path = os.path.join(log, text.split()[0])
            before = os.path.getsize(path) if os.path.exists(path) else 0
            with open(path, "a") as f:
                f.write("x")
            return answer(text, before)

        return code

    return make


def calls(log):
    return {p: os.path.getsize(os.path.join(log, p)) for p in sorted(os.listdir(log))}


def test_what_is_usable():
    check('{"instances": []}', "instances")
    for text in ('{"other": 1}', "[]", '{"instances": {}}', "no", '{"instances": [NaN]}', '{"instances": [], "instances": []}', '{"matches": []}'):
        with pytest.raises(ValueError):
            check(text, "instances")


def test_attempts_until_there_is_a_list(spark, tmp_path):
    """Well-formed JSON without the list is asked again, as are values that Spark's parser would reject."""
    first = {"a": '{"other": 1}', "b": "[]", "c": '{"instances": [NaN]}', "d": '{"instances": [], "instances": []}', "e": "x"}
    make = counting(str(tmp_path), lambda text, before: first[text[0]] if before == 0 else '{"instances": [{"construct": "k", "quote": "now"}]}')
    run = code_table(docs_of(spark, {k: f"{k} now" for k in first}), spark.createDataFrame(NO_BOOK, CODEBOOK), make, retries=2)
    assert run.errors.count() == 0 and calls(tmp_path) == dict.fromkeys("abcde", 2)
    assert sorted((r.doc_id, r.quote_index) for r in run.instances.collect()) == [(k, "2:5") for k in "abcde"]
    assert {r.num_retries for r in run.outcomes.collect()} == {1}
    kinds = {r.doc_id: r.error_message for r in run.responses.where("attempt = 0").collect()}
    assert kinds["a"] == "No list of instances" and kinds["b"] == "Not an object" and "NaN" in kinds["c"] and "twice" in kinds["d"]
    never = code_table(docs_of(spark, {"a": "a now"}), spark.createDataFrame(NO_BOOK, CODEBOOK), counting(str(tmp_path), lambda *_: '{"other": 1}'), retries=2)
    assert never.errors.first().error_message == "Failed after 3 attempts: No list of instances"


def test_prompts_are_asked_once(spark, tmp_path):
    """Documents with one prompt share a call, and a later run finds what an earlier one was told, but for failures."""
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()
    answer = lambda text, before: "no" if text == "bad one" and before < 2 else '{"instances": []}'
    docs = docs_of(spark, {"1": "same text", "2": "same text", "3": "other text", "4": "bad one", "5": None})
    book = spark.createDataFrame(NO_BOOK, CODEBOOK)
    run = code_table(docs, book, counting(str(log), answer), retries=1, store=store)
    assert calls(log) == {"same": 1, "other": 1, "bad": 2}
    assert {r.doc_id: r.error_message for r in run.outcomes.collect()}.keys() == set("12345") and run.errors.count() == 2
    again = code_table(docs.unionByName(docs_of(spark, {"6": "new text"})), book, counting(str(log), answer), retries=1, store=store)
    assert calls(log) == {"same": 1, "other": 1, "bad": 3, "new": 1}
    assert [r.doc_id for r in again.errors.collect()] == ["5"] and again.responses.where("doc_id = '4'").count() == 1


def test_killed_task_asks_only_its_slice_again(spark, tmp_path):
    """A worker dies in the middle; a new run asks nothing again that is in the store."""
    log, store = tmp_path / "log", str(tmp_path / "store")
    log.mkdir()

    def answer(text, before):
        if text.startswith("d17") and before == 0:
            os._exit(1)
        return '{"instances": []}'

    docs = docs_of(spark, {str(i): f"d{i} text" for i in range(40)})
    prompt = F.concat(F.lit("\nText:\n"), "text", F.lit("\n\nAnswer with JSON"))
    go = lambda: call_coder(docs, prompt, counting(str(log), answer), store=store, slice_rows=5, tasks=1)
    with pytest.raises(Exception, match="crashed|exited|EOF|failed"):
        go()
    kept = read_store(spark, store).count()
    asked = calls(log)
    assert asked["d17"] == 1 and sum(asked.values()) - kept <= 12
    got = go()
    assert got.count() == 40 and got.where("error_message IS NOT NULL").count() == 0
    assert sum(calls(log).values()) - 40 == sum(asked.values()) - kept
    before = calls(log)
    assert go().count() == 40 and calls(log) == before


def coded(spark, rows):
    return spark.createDataFrame([(d, c, i, None, q, None, 1) for i, (d, c, q) in enumerate(rows)], INSTANCES)


def matcher(bad=()):
    def make():
        def match(prompt):
            if any(f"construct {b}." in prompt for b in bad):
                return '{"pairs": []}'
            return '{"matches": [{"human_index": 0, "llm_index": 0, "paraphrase": true}, {"human_index": 0, "llm_index": 1}, {"human_index": 9, "llm_index": 1}]}'

        return match

    return make


def test_matcher_in_one_call(spark):
    human, llm = coded(spark, [("d", "x", "p"), ("d", "x", "q"), ("d", "y", "r"), ("e", "z", "alone")]), coded(spark, [("d", "x", "pp"), ("d", "x", "qq"), ("d", "y", "rr")])
    rows, failed = compare_by_matcher(human, llm, matcher())
    got = sorted((r.construct, r.status, r.human_quote or "", r.llm_quote or "", r.match_confidence or 0.0) for r in rows.collect())
    assert got == [("x", "human_only", "q", "", 0.0), ("x", "llm_only", "", "qq", 0.0), ("x", "matched", "p", "pp", 0.5), ("y", "matched", "r", "rr", 0.5), ("z", "human_only", "alone", "", 0.0)]
    assert failed.count() == 0
    with pytest.raises(MatcherError, match="1 groups, first d, y: Failed after 2 attempts: No list of matches"):
        compare_by_matcher(human, llm, matcher(["y"]), retries=1)
    rows, failed = compare_by_matcher(human, llm, matcher(["y"]), leave_out=True)
    assert [(r.doc_id, r.construct) for r in failed.collect()] == [("d", "y")] and rows.where("construct = 'y'").count() == 0 and rows.count() == 4


def test_saved_run_retried(spark, tmp_path):
    """Failures are read from the run, coded again, and stay failures only while they have no result."""
    out, book = str(tmp_path / "out"), tmp_path / "book.json"
    book.write_text(json.dumps({"calm": {"definition": "d", "examples": ["calm"]}}))
    rows = spark.createDataFrame([("a", "so calm"), ("b", "calm bad"), ("c", "worse bad"), ("d", None)], "who string, body string")

    def failing(words):
        def make():
            good = lexicon_coder([("calm", ["calm"])])()

            def code(prompt):
                if any(w in prompt for w in words):
                    raise RuntimeError("down")
                return good(prompt)

            return code

        return make

    run, name = code_rows(rows, "body", str(book), failing(["bad"]), out, "who", name="r")
    assert {r.doc_id: r.error_message for r in codings.read_errors(spark, out, name).collect()} == {"b": "Failed after 1 attempts: down", "c": "Failed after 1 attempts: down", "d": "No text"}
    saved = spark.read.parquet(sinks.run_path(out, "summary", name)).first()
    assert (saved.total, saved.successful, saved.failed) == (4, 1, 3)
    docs = rows.select(F.col("who").alias("doc_id"), F.col("body").alias("text"))
    time.sleep(0.01)
    again, left = retry_run(docs, out, name, str(book), failing(["worse"]))
    assert {r.doc_id for r in again.outcomes.collect()} == {"b", "c", "d"}
    assert sorted(r.doc_id for r in left.collect()) == ["c", "d"]
    assert sorted((r.doc_id, r.quote) for r in codings.read_run_results(spark, out, [name]).collect()) == [("a", "calm"), ("b", "calm")]
    none, left = retry_run(docs.where("doc_id <> 'd'"), out, name, str(book), failing([]))
    assert none.outcomes.count() == 1 and [r.doc_id for r in left.collect()] == ["d"]
    none, left = retry_run(docs.where("doc_id = 'a'"), out, name, str(book), failing([]))
    assert none.outcomes.count() == 0 and [r.doc_id for r in left.collect()] == ["d"]


def test_error_files(spark, tmp_path):
    (tmp_path / "x_error.json").write_text(json.dumps({"document_id": "x", "document_path": "p", "error_message": "m", "model_used": "k", "timestamp": "2026-01-02T03:04:05"}, indent=1))
    r = codings.read_error_files(spark, str(tmp_path)).first()
    assert (r.doc_id, r.document_path, r.error_message, r.model_used, r.ts.year) == ("x", "p", "m", "k", 2026)
    (tmp_path / "y_error.json").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILED_READ_FILE"):
        codings.read_error_files(spark, str(tmp_path)).collect()


def test_run_locates_altered_quotes(spark):
    """Off, an altered quote has no place; on, it has the window most like it, and exact ones keep theirs."""
    text = "The river rose in the night. Nobody in the village slept before the morning came."
    said = json.dumps({"instances": [{"construct": "k", "quote": q} for q in ("nobody in the vilage slept", "rose in the night", "nothing like it at all", "")]})
    docs, book = docs_of(spark, {"a": text, "b": "short"}), spark.createDataFrame(NO_BOOK, CODEBOOK)
    places = lambda **o: {r.quote: r.quote_index for r in code_table(docs, book, lambda: lambda _: said, **o).instances.where("doc_id = 'a'").collect()}
    assert places() == {"nobody in the vilage slept": None, "rose in the night": "10:27", "nothing like it at all": None, "": None}
    at = text.index("Nobody")
    got = places(fuzzy=0.85)
    assert got == {"nobody in the vilage slept": f"{at}:{at + 26}", "rose in the night": "10:27", "nothing like it at all": None, "": None}


def test_compared_runs_read_documents_once(spark, monkeypatch):
    """All runs and the human coding start at one written table of sentences."""
    seen, read = [], core.table
    monkeypatch.setattr(core, "table", lambda *a: seen.append(a[2]) or read(*a))
    assert core.runs_compared(spark, "/root/testdata/sf0.001").count() == 8
    assert seen == ["documents"]
