"""What grows faster than its input: slices of prompts, places of quotes, spans."""

import random
import tracemalloc
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from codelens.functions import fuzzy
from codelens.functions.spans import find_quote, find_quotes, parse_span, span_overlap
from codelens.operators import matching
from codelens.plans import queries, responses

SF = "/root/testdata/sf0.001"


def test_slices_read_their_own_prompts(spark, monkeypatch):
    read, ask = [], responses.ask

    def seen(prompts, *args):
        read.append((prompts._jdf.queryExecution().sparkPlan().toString(), prompts.count()))
        return ask(prompts, *args)

    monkeypatch.setattr(responses, "ask", seen)
    docs = spark.range(100).select(F.col("id").cast("string").alias("doc_id"))
    got = responses.call_coder(docs, F.concat(F.lit("p"), F.col("doc_id").cast("int") % 90), lambda: lambda p: '{"instances": []}', slice_rows=20)
    assert got.count() == 100 and [len(read), sum(n for _, n in read)] == [5, 90]
    for k, (plan, _) in enumerate(read):
        assert "(slice#" in plan.split("PartitionFilters: ")[1] and f" = {k})" in plan.split("PartitionFilters: ")[1]
        assert "Aggregate" not in plan and "Join" not in plan and plan.count("FileScan") == 1


def test_places_of_all_quotes_of_a_text(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choices("aab é😀\n.", k=rng.randrange(40))) for _ in range(60)]
    rows = [(t, [t[i : i + rng.randrange(9)] for i in range(0, len(t), 3)] + ["ba", "", None]) for t in texts] + [(None, ["a", None]), ("a", None), ("", ["", "a"]), ("a", [])]
    df = spark.createDataFrame(rows, "text string, quotes array<string>")
    one = F.transform("quotes", lambda q: find_quote(F.col("text"), q))
    assert df.where(~find_quotes(F.col("text"), F.col("quotes")).eqNullSafe(one)).count() == 0


def test_sentences_without_their_text(spark):
    """No row a sentence holds the document's text."""
    plan = queries.codings(spark, SF)[0]._jdf.queryExecution().optimizedPlan().toString()
    generated = [line for line in plan.splitlines() if "Generate " in line]
    assert generated and all("text#" not in line.split("Generate ")[1] for line in generated)
    assert "instr(" not in plan


def test_spans_are_parsed_once(spark):
    df = spark.createDataFrame([(" 1:5", "3:9 "), ("+1: 5", "1:5"), ("1", "1:2"), ("3:1", "1:2"), ("1:x", "1:2"), ("1:2:3", "1:2"), (None, "1:2"), ("2:2", "2:2"), ("2:2", "2:3"), ("1.0:2", "1:2")], "a string, b string")
    out = df.select(span_overlap(parse_span(F.col("a")), parse_span(F.col("b"))).alias("o"))
    assert [r.o for r in out.collect()] == [0.25, 1.0, None, None, None, None, None, 1.0, 0.0, None]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("split(") == 2


def test_matching_letters_as_difflib():
    rng = random.Random(5)
    for _ in range(3000):
        some = rng.choice(["ab", "abc", "abcdefgh "])
        a, b = ("".join(rng.choices(some, k=rng.randrange(40))) for _ in range(2))
        if a and rng.random() < 0.5:
            i = rng.randrange(len(a))
            b = a[:i] + a[i + 1 :] + rng.choice(some)
        assert fuzzy.matched(a, b) == sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())


def test_altered_quotes_in_long_texts(monkeypatch):
    """What is nearly whole is found without a pass over the text's grams, and where a scan of all windows finds it."""
    rng = random.Random(6)
    words = ["".join(rng.choices("etaoinshrdlu", k=rng.randrange(1, 9))) for _ in range(60)]
    wrong = []
    for k in range(120):
        text = " ".join(rng.choices(words, k=100))
        n = rng.choice([9, 20, 60, 230])
        i = rng.randrange(len(text) - n)
        q = text[i : i + 3] + text[i + 4 : i + n] if k % 3 else text[i : i + 4].upper() + "x" + text[i + 5 : i + n]
        scan = fuzzy._best(text, q.lower(), len(q), 0.85, [(-1.0, j) for j in range(len(text) - len(q) + 1)])
        wrong += [(text, q, scan)] if fuzzy.best_window(text, q, 0.85) != scan else []
    assert wrong == []
    monkeypatch.setattr(fuzzy.Places, "seeded", None)
    text = " ".join(rng.choices(words, k=20_000))
    assert fuzzy.best_window(text, text[500:504] + text[505:560], 0.85) == "500:559"


def test_large_groups_of_similar_quotes(spark, monkeypatch):
    """Words and cells are sent without the quotes, and a group that is dealt by them loses no pair."""
    rng = random.Random(8)
    words = ["river", "stone", "a", "of", "light", "moving", "tree"]
    side = lambda n: [("d", "c", i, " ".join(rng.choices(words, k=rng.randrange(1, 7))), f"{a}:{a + rng.randrange(12)}" if (a := rng.randrange(200)) % 4 else None) for i in range(n)]
    h, m = side(60), side(40)
    sides = [spark.createDataFrame(x, "doc_id string, construct string, ord int, quote string, quote_index string").withColumn("confidence", F.lit(1)) for x in (h, m)]

    def share(x, y):
        a, b = set(x[3].split()), set(y[3].split())
        spans = [[int(v) for v in z[4].split(":")] if z[4] else None for z in (x, y)]
        score = len(a & b) / len(a | b)
        if all(spans):
            (p, q), (r, s) = spans
            both = max(0, min(q, s) - max(p, r))
            score = max(score, (1.0 if p == q and r == s else 0.0 if p == q or r == s else both / (q - p + s - r - both)))
        return score

    wanted = {(x[2], y[2]) for x in h for y in m if share(x, y) >= 0.5}
    for size in (4096, 8):
        monkeypatch.setattr(matching, "GROUP", size)
        out = matching.propose_similar(*sides, 0.5)
        assert {(r.human_index, r.llm_index) for r in out.collect()} == wanted
        generated = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Generate " in line]
        assert generated and all("_quote#" not in line for line in generated)


def test_fuzzy_windows_of_repeated_words(monkeypatch):
    """As the plain scan with ``difflib`` has it, where grams repeat and most letters of a window are popular."""
    monkeypatch.setattr(fuzzy, "HELD", 500)
    monkeypatch.setattr(fuzzy, "LONG", 200)

    def scan(text, quote, threshold):
        best, at, n = 0.0, None, len(quote)
        for i in range(len(text) - n + 1):
            ratio = SequenceMatcher(None, quote.lower(), text[i : i + n].lower()).ratio()
            best, at = (ratio, i) if ratio > best else (best, at)
        return f"{at}:{at + n}" if at is not None and best >= threshold else None

    rng, found = random.Random(6), 0
    for case in range(60):
        some = [rng.choice(["La", "Thor", "Ereaon", "bee", "zw", "x", "odd", "Queue"]) for _ in range(3)]
        runs = [" ".join([w] * rng.randint(10, 60)) for w in some]
        text = " ".join([rng.choice(["", "one quick jump", "vexing"]), *runs, rng.choice(["", "fjord by night"])])
        a = rng.randint(0, len(text) // 4)
        quote = text[a : a + rng.randint(200, max(201, len(text) - a))]
        for _ in range(rng.choice([1, 2, 9])):
            k = rng.randrange(len(quote))
            quote = quote[:k] + rng.choice(["", "q", "La"]) + quote[k + 1 :]
        for threshold in (0.6, 0.85):
            want = scan(text, quote, threshold)
            found += want is not None
            assert fuzzy.best_window(text, quote, threshold) == want, (text, quote, threshold)
    assert 10 < found < 110


def test_fuzzy_search_holds_little_memory():
    """Every gram of a long run of one word stands at thousands of places."""
    text = "a few words before. " + "Erteng " * 700 + "Ereaon " * 2500 + "and some after"
    quote = "Erteung " * 4 + "Ereaon " * 2400
    tracemalloc.start()
    fuzzy.best_window(text, quote, 0.85)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6
