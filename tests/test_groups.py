"""Large groups: greedy pairs in rounds, numbering by blocks, medians by ranges, each equal to the plain way."""

import random

import pytest
from pyspark.sql import functions as F

from codelens.operators import matching, metrics
from codelens.schemas import INSTANCES, PROPOSALS


def walked(proposals, n, m):
    """A walk in order: both quotes exist and are not taken."""
    hs, ms, out = set(), set(), set()
    for o, h, k in sorted(proposals):
        if 0 <= h < n and 0 <= k < m and h not in hs and k not in ms:
            hs.add(h)
            ms.add(k)
            out.add((h, k))
    return out


def groups_of(rng):
    """Groups with random proposals, with chains that decide one by one, with one quote that all name, and with ties."""
    for g in range(12):
        n, m = rng.randint(1, 25), rng.randint(1, 25)
        yield f"r{g}", n, m, [(o, rng.randint(-1, n), rng.randint(-1, m)) for o in range(rng.randint(0, 120))]
    yield "chain", 40, 40, [p for i in range(40) for p in ((2 * i, i, i), (2 * i + 1, i, i + 1))]
    yield "hub", 50, 50, [(i, 0, i) for i in range(50)] + [(50 + i, i, 0) for i in range(50)]
    yield "ties", 9, 9, [(o // 3, rng.randint(0, 8), rng.randint(0, 8)) for o in range(60)]
    yield "sparse", 5, 5, [(10 ** (i % 9), i % 5, (3 * i) % 5) for i in range(9)]
    yield "none", 3, 0, [(0, 0, 0)]


@pytest.mark.parametrize("bits", [1, 3, 16])
def test_rounds_equal_the_walk(spark, monkeypatch, bits):
    """Blocks of two proposals, of eight, and of more than any group has."""
    monkeypatch.setattr(matching, "WALK_BITS", bits)
    monkeypatch.setattr(matching, "BLOCK_BITS", bits)
    rng = random.Random(11)
    human, llm, proposals, want = [], [], [], set()
    for g, n, m, some in groups_of(rng):
        if g == "chain" and bits == 1:
            n, m, some = 6, 6, some[:12]
        human += [("d", g, i, None, f"h{i}", None, None) for i in range(n)]
        llm += [("d", g, i, None, f"m{i}", None, 1) for i in range(m)]
        proposals += [("d", g, o, h, k, False, 0.5) for o, h, k in some]
        want |= {(g, f"h{h}", f"m{k}") for h, k in walked(some, n, m)}
    rng.shuffle(human)
    rng.shuffle(proposals)
    rows = matching.compare(spark.createDataFrame(human, INSTANCES), spark.createDataFrame(llm, INSTANCES), spark.createDataFrame(proposals, PROPOSALS)).collect()
    got = [(r.construct, r.human_quote, r.llm_quote) for r in rows if r.status == "matched"]
    assert set(got) == want and len(got) == len(want)
    assert sorted((r.construct, r.human_quote) for r in rows if r.status != "llm_only") == sorted((h[1], h[4]) for h in human)
    assert sorted((r.construct, r.llm_quote) for r in rows if r.status != "human_only") == sorted((h[1], h[4]) for h in llm)


def test_group_of_many_quotes(spark):
    """A fifth of a million quotes of one document and construct, in four blocks and more rounds than one."""
    n = 200_000
    side = lambda c, q: spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("c").alias("construct"), F.col("id").cast("int").alias("ord"), F.lit(None).cast("string").alias("speaker_id"), F.concat(F.lit(q), "id").alias("quote"), F.lit(None).cast("string").alias("quote_index"), c.cast("int").alias("confidence"))
    proposals = spark.range(n).select(F.lit("d").alias("doc_id"), F.lit("c").alias("construct"), F.col("id").cast("int").alias("ord"), (F.col("id") - F.col("id") % 2).cast("int").alias("human_index"), F.col("id").cast("int").alias("llm_index"), F.lit(True).alias("paraphrase"), F.lit(0.9).alias("match_confidence"))
    got = matching.compare(side(F.lit(None), "h"), side(F.lit(1), "m"), proposals)
    assert {r.status: r["count"] for r in got.groupBy("status").count().collect()} == {"matched": n // 2, "human_only": n // 2, "llm_only": n // 2}
    assert got.where("status = 'matched' AND substr(human_quote, 2) <> substr(llm_quote, 2)").count() == 0


def test_numbers_of_quotes(spark, monkeypatch):
    monkeypatch.setattr(matching, "BLOCK_BITS", 2)
    rng = random.Random(2)
    rows = [(d, c, o, None, q, None, None) for d in "ab" for c in "xy" for o, q in ((rng.randint(0, 30), rng.choice("pqr")) for _ in range(40))]
    got = matching.numbered_quotes(spark.createDataFrame(rows, INSTANCES)).collect()
    for d in "ab":
        for c in "xy":
            own = sorted((r.i, r.ord, r.quote) for r in got if (r.doc_id, r.construct) == (d, c))
            assert [i for i, *_ in own] == list(range(40))
            assert [x[1:] for x in own] == sorted((r[2], r[4]) for r in rows if r[:2] == (d, c))


def median(pairs):
    total, upto = sum(w for _, w in pairs), 0
    for v, w in sorted(pairs):
        upto += w
        if 2 * upto >= total:
            return v


@pytest.mark.parametrize("most", [1, 5, 64, 100_000])
def test_medians_by_ranges(spark, most):
    """Even, crowded, heavy-ended and constant values; half reached exactly at a value; a null key."""
    rng = random.Random(4)
    made = {
        "even": [(i / 500, 1) for i in range(500)], "crowded": [(1 - i * 1e-12, rng.randint(1, 9)) for i in range(400)] + [(-1.0, 3)],
        "heavy": [(float(i), 1) for i in range(300)] + [(1000.0, 10_000)], "one": [(0.25, 7)] * 50, "exact": [(0.0, 5), (1.0, 5)],
        "random": [(rng.choice([-1.0, rng.random(), rng.randint(0, 9) / 9]), rng.randint(1, 50)) for _ in range(900)], None: [(2.0, 1), (3.0, 4)],
    }
    rows = spark.createDataFrame([(k, v, w) for k, pairs in made.items() for v, w in pairs], "k string, v double, w long")
    got = {r.k: (r["median"], r["min"], r["max"]) for r in metrics.weighted_median(rows, ["k"], "v", "w", most).collect()}
    assert got == {k: (median(p), min(p)[0], max(p)[0]) for k, p in made.items()}
    assert metrics.weighted_median(rows.limit(0), ["k"], "v", "w", most).count() == 0


def test_passages_of_any_length(spark):
    """Short passages, parts of words and repeated ones included."""
    from codelens.plans.queries import locate_passages

    docs = [(1, "one two three four five\nsix"), (2, "twofold three"), (3, None), (4, "")]
    items = ["two three four", "two", "one two", "wo", "ee four five", "five six", "five\nsix", "", None, "zebra"]
    got = locate_passages(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(list(enumerate(items)), "item_id int, quote string"), block=2)
    want = {(d, i, f"{t.find(q)}:{t.find(q) + len(q)}") for d, t in docs if t for i, q in enumerate(items) if q and q in t}
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert locate_passages(spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame([(7, "wo")], "item_id int, quote string")).count() == 2
