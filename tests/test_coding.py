"""Sources, parsing and coding runs on small invented cases."""

import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from codelens.functions.parsing import extract_instances, validate_responses
from codelens.functions.fuzzy import best_window
from codelens.functions.spans import find_quote, parse_range, parse_span, span_overlap
from codelens.operators import codebook as cb
from codelens.operators import matching, metrics
from codelens.operators.corpus import sentence_complexity
from codelens.operators.display import truncate
from codelens.plans.coding import Response, call_matcher, code_directory, code_rows, code_table, lexicon_coder, match_prompts, retry_failed
from codelens.plans.comparison import compare_directories, compare_documents
from codelens.plans.optimise import optimise
from codelens.schemas import CODEBOOK, COMPARISON, COMPARISON_COLUMNS, INSTANCES
from codelens.sources import codings, documents, sinks


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


def test_spans(spark):
    assert one(spark, parse_range(F.lit(" 3 - 9"))) == "3:9"
    assert one(spark, parse_range(F.lit("3-9-1"))) is None
    with pytest.raises(ValueError):
        parse_range(F.lit("1-2"), "tab")
    o = lambda a, b: one(spark, span_overlap(parse_span(F.lit(a)), parse_span(F.lit(b))))
    assert o("0:10", "5:15") == pytest.approx(5 / 15)
    assert o("3:3", "4:4") == 1.0 and o("3:3", "0:9") == 0.0 and o("9:3", "0:9") is None
    assert one(spark, find_quote(F.lit("a😀bc"), F.lit("bc"))) == "2:4"
    assert one(spark, find_quote(F.lit("abc"), F.lit(""))) is None
    assert best_window("She can't sleep at night; she said so.", "She cant sleep at night", 0.8) == "0:23"
    assert best_window("abc", "xyz", 0.8) is None and best_window("abc", "abcd", 0.1) is None
    assert one(spark, truncate(F.lit("words beyond the limit go"), 10)) == "words b..."


def test_documents(spark, tmp_path):
    (tmp_path / "b c.txt").write_bytes(b"plain\r\ntext")
    (tmp_path / "a.csv").write_text("speaker,text,id\nNurse,how is the knee,1\nMr Ito,better now,2\n,,3\n")
    (tmp_path / "c.csv").write_text("speaker,text,id\nNurse,next,1\n")
    (tmp_path / "d.CSV").write_text("content,when\nonly this,2020\n")
    (tmp_path / "note.md").write_text("no")
    got = {r.doc_id: r.text for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"b c": "plain\ntext", "a": "Nurse: how is the knee\nMr Ito: better now", "c": "Nurse: next", "d": "only this"}
    with pytest.raises(ValueError, match="Unsupported file type"):
        documents.read_documents(spark, str(tmp_path / "x.docx"))
    with pytest.raises(FileNotFoundError):
        documents.list_documents(spark, str(tmp_path / "none"))
    assert documents.text_columns(["Speaker", "video", "words"]) == ["words"]
    rows = spark.createDataFrame([("u", "x", 0), ("u", "y", 1), ("v", "z", 2)], "author string, body string, n int")
    assert sorted(r.doc_id for r in documents.rows_as_documents(rows, "body", "author", "n").collect()) == ["u", "u_2", "v"]
    with pytest.raises(ValueError, match="Missing columns"):
        documents.rows_as_documents(rows, "text")
    clash = documents.suffix_duplicates(spark.createDataFrame([("a", 0), ("a", 1), ("a_2", 2)], "doc_id string, pos int"))
    with pytest.raises(ValueError):
        documents.check_unique(clash)


def test_human_codings(spark, tmp_path):
    p = tmp_path / "h.tsv"
    p.write_text("doc\tquote\tcodes\nd1\t I feel \tstress, burden\nd2\tx\t ,\n")
    instances, docs = codings.read_human_coding(spark, str(p), doc_id_col="doc", quote_col="quote", construct_col="codes")
    assert sorted((r.construct, r.quote, r.quote_index) for r in instances.collect()) == [("burden", "I feel", None), ("stress", "I feel", None)]
    assert docs.count() == 2
    with pytest.raises(ValueError, match="missing required columns"):
        codings.human_codings(spark.createDataFrame([("a",)], "doc string"), "doc", "quote", "codes")
    with pytest.raises(ValueError, match="Unsupported file extension"):
        codings.read_human_coding(spark, "x.txt", doc_id_col="a", quote_col="b", construct_col="c")


def test_codebook_forms(spark, tmp_path):
    entry = {"definition": "d", "examples": ["e"], "note": "n", "refs": ["r", {"k": 1}]}
    for name, body in (("flat", {"z": entry, "a": entry}), ("env", {"metadata": {"name": "m", "version": 3, "citation": "c"}, "codebook": {"z": entry, "a": entry}})):
        p = tmp_path / f"{name}.json"
        p.write_text(json.dumps(body))
        rows = codings.read_codebook(spark, str(p)).orderBy("ord").collect()
        assert [(r.construct, r.definition, r.examples, r.extra) for r in rows] == [("z", "d", ["e"], {"note": '"n"', "refs": '["r",{"k":1}]'}), ("a", "d", ["e"], {"note": '"n"', "refs": '["r",{"k":1}]'})]
        meta = codings.read_codebook_meta(spark, str(p))
        assert (meta.name, meta.version, meta.citation) == (("m", 3, "c") if name == "env" else ("", 1, ""))
        again = sinks.write_codebook(codings.read_codebook(spark, str(p)), meta, f"{tmp_path}/again-{name}.json")
        saved = json.loads((tmp_path / f"again-{name}.json").read_text())
        assert list(saved["codebook"]) == ["z", "a"] and saved["codebook"]["a"] == entry and "\n" in (tmp_path / f"again-{name}.json").read_text()
        assert codings.read_codebook(spark, again).orderBy("ord").collect() == rows and codings.read_codebook_meta(spark, again) == meta
    (tmp_path / "bad.json").write_text("{not valid json")
    with pytest.raises(ValueError):
        codings.read_codebook(spark, str(tmp_path / "bad.json"))


def instances(spark, rows):
    return spark.createDataFrame([(d, c, o, None, q, s, k) for d, c, o, q, s, k in rows], INSTANCES)


def test_compare(spark):
    h = instances(spark, [("d", "stress", 0, "a b", "0:10", None), ("d", "x", 0, "only", None, None)])
    m = instances(spark, [("d", "stress", 0, "a c", "5:15", 2), ("d", "burden", 0, "q", None, 1)])
    p = spark.createDataFrame([("d", "stress", 0, 0, 0, False, 0.9)], "doc_id string, construct string, ord int, human_index int, llm_index int, paraphrase boolean, match_confidence double")
    got = matching.ordered(matching.compare(h, m, p))
    assert got.columns == COMPARISON_COLUMNS
    rows = [(r.construct, r.status, r.tp, r.fp, r.fn) for r in got.collect()]
    assert rows == [("burden", "llm_only", 0, 1, 0), ("stress", "matched", 1, 0, 0), ("x", "human_only", 0, 0, 1)]
    assert got.where("status = 'matched'").first().span_overlap == pytest.approx(5 / 15)
    empty = instances(spark, [])
    assert matching.compare_exact(empty, empty).count() == 0


@pytest.mark.parametrize("threshold", [0.3, 0.5, 0.8, 1.0])
def test_similar_quotes(spark, threshold):
    """Every pair that reaches the threshold is proposed, and no other."""
    r = random.Random(5)

    def coded():
        out = []
        for i in range(60):
            start, n = r.randrange(200), r.choice([0, 1, 2, 7, 8, 30, 64, 90])
            quote = " ".join(r.choice(["one", "two", "three", "four", "five"]) for _ in range(r.randrange(1, 7)))
            out.append(("d", r.choice("xy"), i, r.choice([quote, "", quote.upper()]), r.choice([None, f"{start}:{start + n}"]), 1))
        return out

    def jaccard(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    def overlap(a, b):
        if not a or not b:
            return 0.0
        (s, e), (t, f) = (map(int, x.split(":")) for x in (a, b))
        if s == e or t == f:
            return float(s == e and t == f)
        both = max(0, min(e, f) - max(s, t))
        return both / (e - s + f - t - both)

    human, llm = coded(), coded()
    want = {}
    for c in "xy":
        hs, ms = ([x for x in side if x[1] == c] for side in (human, llm))
        for i, h in enumerate(hs):
            for j, m in enumerate(ms):
                score = max(jaccard(set(h[3].lower().split(" ")), set(m[3].lower().split(" "))), overlap(h[4], m[4]))
                if score >= threshold:
                    want[c, i, j] = pytest.approx(score)
    got = matching.propose_similar(instances(spark, human), instances(spark, llm), threshold).collect()
    assert {(x.construct, x.human_index, x.llm_index): x.match_confidence for x in got} == want and len(got) == len(want)
    by = [x.match_confidence for x in sorted(got, key=lambda x: x.ord) if x.construct == "x"]
    assert by == sorted(by, reverse=True)


def rows_of(spark, data):
    full = [{"doc_id": d, "construct": c, "status": s, "llm_confidence": k, "tp": int(s == "matched"), "fp": int(s == "llm_only"), "fn": int(s == "human_only")} for d, c, s, k in data]
    return spark.createDataFrame(full, COMPARISON)


def test_metrics(spark):
    rows = rows_of(spark, [("a", "c", "matched", 2), ("a", "c", "matched", 0), ("a", "c", "llm_only", 1), ("b", "c", "human_only", None), ("b", "c", "human_only", None)])
    per_doc, pooled, weighted = metrics.summary_tables(rows)
    o = pooled.where("is_overall").first()
    assert (o.tp, o.fp, o.fn, o.sensitivity, o.precision, o.f1, o.pabak, o.pr_auc) == (2, 1, 2, 0.5, 0.6667, 0.5714, -0.2, 0.8333)
    assert (o.n_docs, o.p5, o.p95) == (2, 2.05, 2.95)
    assert per_doc.count() == 2 and weighted.count() == 2
    assert metrics.pr_auc(rows_of(spark, [("d", "c", "matched", 0), ("d", "c", "llm_only", 2)]), []).first().pr_auc == 0.5
    assert metrics.pr_auc(rows_of(spark, [("d", "c", "matched", 0)]), []).count() == 0
    assert [t.count() for t in metrics.summary_tables(rows_of(spark, []))] == [0, 0, 0]


def test_coding_run(spark, tmp_path):
    docs = spark.createDataFrame([("a", "I feel sad today. Life is fine."), ("b", "nothing"), ("c", None)], "doc_id string, text string")
    book = spark.createDataFrame([("mood", 0, "m", ["feel sad"], [], {})], "construct string, ord int, definition string, examples array<string>, counter_examples array<string>, extra map<string,string>")
    run = code_table(docs, book, lexicon_coder([("mood", ["feel sad"])]))
    assert [(r.doc_id, r.quote, r.quote_index) for r in run.instances.collect()] == [("a", "feel sad", "2:10")]
    assert run.outcomes.where("error_message IS NULL").count() == 2
    assert [(r.doc_id, r.error_message) for r in run.errors.collect()] == [("c", "No text")]

    def failing():
        def code(prompt):
            if "nothing" in prompt:
                raise RuntimeError("down")
            return '{"instances": []}'

        return code

    bad = code_table(docs, book, failing, retries=1)
    assert [(r.doc_id, r.error_message) for r in bad.errors.orderBy("doc_id").collect()] == [("b", "Failed after 2 attempts: down"), ("c", "No text")]
    again, left = retry_failed(docs, bad.errors, book, lexicon_coder([("mood", ["feel sad"])]))
    assert again.outcomes.count() == 2 and [r.doc_id for r in left.collect()] == ["c"]
    s = sinks.run_summary(bad.outcomes, "r", "m", "b", "i").first()
    assert (s.total, s.successful, s.failed) == (3, 1, 2)
    path = sinks.write_run(sinks.nested_results(run.instances, docs), str(tmp_path), "encodings", sinks.run_id("x"), "json")
    back, ids = codings.read_results(spark, path)
    assert ids.count() > 0 and back.where("quote = 'feel sad'").count() == 1
    assert codings.read_errors(spark, str(tmp_path / "nothing"), "x").count() == 0 and codings.read_error_files(spark, str(tmp_path / "nothing")).count() == 0
    saved = json.loads(sinks.codebook_json(book, cb.Meta("n", 2).refined()).first().value)
    assert saved["codebook"]["mood"]["examples"] == ["feel sad"]
    assert saved["metadata"] == {"name": "n", "version": None, "citation": "", "built_from": [{"name": "n", "version": 2}], "partial": True}


def test_ids_are_places(spark):
    """Without an id column, rows are numbered from 0 over all partitions, those without a text too."""
    rows = spark.createDataFrame([(f"t{i}" if i != 4 else None, -i) for i in range(11)], "text string, turned int").repartition(5, "turned").cache()
    got = documents.rows_as_documents(rows, "text").collect()
    assert {r.doc_id for r in got} == {str(i) for i in range(11)} and len(got) == 11 and all(r.doc_id == str(r.pos) for r in got)
    by = {r.text: (r.doc_id, r.pos) for r in documents.rows_as_documents(rows, "text", order="turned").collect()}
    assert by == {f"t{i}" if i != 4 else None: (str(10 - i), 10 - i) for i in range(11)}


def test_response_metadata(spark):
    """What a coder reports is kept; a failed document has the error and the coder's model."""

    def make():
        def code(prompt):
            if "slow" in prompt:
                return Response("no json", usage={"total_tokens": 3})
            return Response('{"instances": []}', "served", {"prompt_tokens": 5, "total_tokens": 7}, 1_700_000_000, "id-1", {"choices": [1]})

        return code

    docs = spark.createDataFrame([("a", "quick one", "x/a.txt"), ("b", "slow one", "x/b.txt")], "doc_id string, text string, path string")
    run = code_table(docs, spark.createDataFrame([], CODEBOOK), make, retries=2, model="asked")
    a, b = run.meta.orderBy("doc_id").collect()
    assert (a.model, a.usage, a.created, a.response_id, json.loads(a.raw_response), a.num_retries, a.error_type) == ("served", {"prompt_tokens": 5, "total_tokens": 7}, 1_700_000_000, "id-1", {"choices": [1]}, 0, None)
    assert a.latency_ms >= 0 and (b.model, b.num_retries, b.error_type, b.error_output, b.usage) == ("asked", 2, "JSONDecodeError", "no json", {"total_tokens": 3})
    assert [(r.doc_id, r.document_path, r.model_used) for r in run.errors.collect()] == [("b", "x/b.txt", "asked")]
    assert run.responses.count() == 4


def test_runs_that_write(spark, tmp_path):
    """A folder and a table coded to sinks, and compared from there."""
    source, book = tmp_path / "in", tmp_path / "book.json"
    source.mkdir()
    (source / "one.txt").write_text("the sea was calm, the sea was grey")
    (source / "two.csv").write_text("speaker,text\nA,calm again\n")
    book.write_text(json.dumps({"calm": {"definition": "d", "examples": ["calm"]}}))
    coder = lexicon_coder([("calm", ["calm"])])
    run, name = code_directory(spark, str(source), str(book), coder, str(tmp_path / "out"), "folder", "m")
    out = str(tmp_path / "out")
    encoded = lambda n: sinks.run_path(out, "encodings", n)
    assert {p.name for p in (tmp_path / "out").iterdir()} == {"encodings", "metadata", "errors", "summary"}
    assert sorted((r.doc_id, r.quote_index) for r in codings.read_results(spark, encoded(name))[0].collect()) == [("one", "12:16"), ("two", "3:7")]
    s = spark.read.parquet(sinks.run_path(out, "summary", name)).first()
    assert (s.total, s.successful, s.failed, s.model) == (2, 2, 0, "m")
    rows = spark.createDataFrame([("so calm", "u"), ("calm, calm", "u"), ("wild", "v")], "body string, author string")
    table, other = code_rows(rows, "body", str(book), coder, str(tmp_path / "out"), "author", name="rows")
    assert sorted(r.doc_id for r in table.instances.collect()) == ["u", "u_2"]
    both = compare_directories(spark, encoded(name), encoded(other), root=out)
    assert sorted((r.doc_id, r.status) for r in both.collect()) == [("one", "human_only"), ("two", "human_only"), ("u", "llm_only"), ("u_2", "llm_only")]
    (kept,) = (tmp_path / "out" / "comparison").glob("run_id=comparison_*")
    lines = [row for part in sorted(kept.glob("*.csv")) for row in list(csv.DictReader(part.open()))]
    assert [r["doc_id"] for r in lines] == ["one", "two", "u", "u_2"]
    manifest = spark.read.parquet(f"{out}/comparison_manifest").orderBy("place").collect()
    assert [r.part for r in manifest] == sorted(p.name for p in kept.glob("*.csv")) and sum(r.rows for r in manifest) == 4
    runs = codings.read_run_results(spark, out, [name])
    assert runs.select("run_id").distinct().first().run_id == name and runs.count() == 2
    assert codings.read_run_results(spark, out).select("run_id").distinct().count() == 2
    plan = runs._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run_id" in plan


def test_saved_files_compared(spark, tmp_path):
    """Result files of two coders; a document may be in one folder alone, and one file names its document itself."""
    item = lambda q: {"construct": "c", "speaker_id": None, "quote": q, "quote_index": None, "confidence": 1}
    for side, docs in (("h", {"x": ["p", "q"], "y": ["r"]}), ("m", {"x": ["p"], "z": []})):
        (tmp_path / side / "encodings").mkdir(parents=True)
        for d, quotes in docs.items():
            (tmp_path / side / "encodings" / f"{d}.json").write_text(json.dumps({"document_id": f"id-{side}", "instances": [item(q) for q in quotes]}, indent=1))
    rows = compare_directories(spark, str(tmp_path / "h"), str(tmp_path / "m" / "encodings")).collect()
    assert sorted((r.doc_id, r.human_quote, r.llm_quote) for r in rows) == [("x", "p", "p"), ("x", "q", None), ("y", "r", None)]
    one = compare_documents(spark, str(tmp_path / "h" / "encodings" / "x.json"), str(tmp_path / "m" / "encodings" / "x.json")).collect()
    assert sorted((r.doc_id, r.status) for r in one) == [("id-h", "human_only"), ("id-h", "matched")]
    (tmp_path / "m" / "encodings" / "z.json").write_text("{broken")
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILED_READ_FILE"):
        compare_directories(spark, str(tmp_path / "h"), str(tmp_path / "m")).collect()


def test_matcher(spark):
    h = instances(spark, [("d", "x", 0, "q1", None, None), ("d", "y", 0, "alone", None, None)])
    m = instances(spark, [("d", "x", 0, "q2", None, 1)])
    prompts = match_prompts(matching.align(h, m), matching.format_quotes)
    assert prompts.count() == 1
    got = call_matcher(prompts, lambda: lambda p: '{"matches": [{"human_index": 0, "llm_index": 0, "match_confidence": 2}]}')
    from codelens.functions.parsing import extract_matches

    rows = matching.compare(h, m, extract_matches(got)).where("status = 'matched'").collect()
    assert [(r.construct, r.match_confidence) for r in rows] == [("x", 1.0)]


def test_response_rules(spark):
    items = [{"construct": "a", "quote": None}, {"construct": "a", "quote": "x", "confidence": -1}, {"construct": "a", "quote": "x", "speaker_id": "s"}, [1]]
    rows = spark.createDataFrame([("d", "xyz", json.dumps({"instances": items})), ("e", "x", "[1]"), ("f", "x", None)], "doc_id string, text string, response_text string")
    v = validate_responses(rows)
    assert {r.doc_id: r.invalid for r in v.collect()} == {"d": None, "e": "Not an object", "f": "No response"}
    assert [(r.ord, r.quote_index, r.confidence) for r in extract_instances(v).collect()] == [(2, "0:1", 1)]


def test_codebook_changes(spark, tmp_path):
    schema = "construct string, ord int, definition string, examples array<string>, counter_examples array<string>, extra map<string,string>"
    base = spark.createDataFrame([("c", 0, "d", ["known"], [], {}), ("e", 1, "d", [], [], {})], schema)
    full = [{"doc_id": "1", "construct": "c", "status": "human_only", "human_quote": q, "tp": 0, "fp": 0, "fn": 1} for q in ("known", "new", "new ", "other")]
    rows = spark.createDataFrame(full, COMPARISON)
    pooled = metrics.summary_tables(rows)[1]
    part = cb.refine(rows, pooled, base, n_examples=1)
    assert [(r.construct, r.examples[0], len(r.examples)) for r in part.collect()] == [("c", "known", 2)]
    assert cb.merge(base, part).count() == 2
    for n in (0, True, "some"):
        with pytest.raises(ValueError):
            cb.sample_size(n)
    with pytest.raises(ValueError):
        cb.unknown_constructs(instances(spark, [("d", "zz", 0, "q", None, None)]), base, strict=True)
    human = instances(spark, [("1", "c", 0, "new", None, None)])
    partials = optimise(rows, base, human, lambda book: human.withColumn("confidence", F.lit(2)), matching.compare_exact)
    assert len(partials) == 1
    assert cb.not_in_codebook(pooled, base.where("construct = 'e'")).first().construct == "c"
    out = optimise(rows, base, human, lambda book: human.withColumn("confidence", F.lit(2)), matching.compare_exact, meta=cb.Meta("b", 4), root=str(tmp_path), name="b")
    (saved,) = tmp_path.glob("b_optimized_codebook_v001_*.json")
    meta = codings.read_codebook_meta(spark, str(saved))
    assert len(out) == 1 and meta == cb.Meta("b", None, "", (("b", 4),), True)
    assert cb.Meta("b", 4).merged(meta) == cb.Meta("b", 5, "", (("b", 4),)) and cb.Meta("b", 4).merged(meta, 9).version == 9
    with pytest.warns(UserWarning, match="partial"):
        cb.Meta("b", None).merged(cb.Meta("p"))


def test_tree_depth(spark):
    rows = [("d", 0, i, "X", h) for i, h in enumerate([0, 0, 1, 2])] + [("d", 1, 0, "X", 1), ("d", 1, 1, "X", 0)]
    got = sentence_complexity(spark.createDataFrame(rows, "doc_id string, sent int, i int, pos string, head int")).first()
    assert got.mean_tree_depth == 3.0 and got.dependency_distance_mean == pytest.approx((0.75 + 1) / 2)


def scanned(text, quote, threshold):
    """The plain sliding scan."""
    from difflib import SequenceMatcher

    n = len(quote)
    ratios = [SequenceMatcher(None, quote.lower(), text[i : i + n].lower()).ratio() for i in range(len(text) - n + 1)]
    best = max(ratios, default=-1.0)
    return f"{ratios.index(best)}:{ratios.index(best) + n}" if best >= threshold else None


def test_fuzzy_quotes_as_scanned():
    """Any text and threshold; long quotes, where difflib leaves out frequent letters; letters whose lower case is odd."""
    r = random.Random(3)
    letters = "aabbcde  ,.ΣİßÉ"
    for k in range(120):
        text = "".join(r.choice(letters) for _ in range(r.randrange(1, 120)))
        at = r.randrange(len(text))
        quote = list(text[at : at + r.randrange(1, 40)])
        for _ in range(r.randrange(0, 5)):
            quote[r.randrange(len(quote))] = r.choice(letters)
        quote = "".join(quote)
        for t in (0.3, 0.6, 0.85, 1.0):
            assert best_window(text, quote, t) == scanned(text, quote, t), (text, quote, t)
    long = " ".join(r.choice(["sea", "tide", "wave", "of", "the"]) for _ in range(120))
    assert best_window(long, long[31:260].replace("wave", "wavy"), 0.8) == scanned(long, long[31:260].replace("wave", "wavy"), 0.8)


def test_fuzzy_quotes_in_whole_documents(spark, tmp_path):
    from codelens.plans.queries import quote_index_fuzzy

    text = "One bird sang here. Two birds sang there, near us! One bird sang there. Nothing else was heard. One bird sang here."
    docs = [(1, text), (2, "Was it short? It was. aaaa bbbb cccc dddd. bbbb aaaa dddd cccc. abab abab abab")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    texts = {str(i): t for i, t in docs}
    got = [tuple(r) for r in quote_index_fuzzy(spark, str(tmp_path)).select("doc_id", "pos", "quote", "quote_index").collect()]
    assert len(got) == 10
    for i, _, quote, index in got:
        at = texts[i].find(quote)
        assert index == (f"{at}:{at + len(quote)}" if at >= 0 else scanned(texts[i], quote, 0.85)), quote
