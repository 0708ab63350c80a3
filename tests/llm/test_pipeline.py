"""The pipeline against a version by hand, and its stages on odd and empty tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F
from test_operators import DOCS, ODD, dedup_by_hand, repeats

import corpus_pipeline
from codelens.llm import host_rules, queries, simhash

SPACE = "[ \t-\r]+"


def split(text):
    return [w for w in re.split(SPACE, text or "") if w]


def by_hand_quality(docs):
    """docs: (doc_id, text, source)."""
    base, failed = [], []
    for _, text, _ in docs:
        w = split(text)
        lines = [x for x in (text or "").split("\n") if re.search("[^ \t-\r]", x)]
        chars, symbols = sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or "")
        base.append(len(w) < 50 or 100 * repeats(w) > 50 * len(w))
        failed.append(base[-1] or 10 * symbols > chars or 10 * (len(lines) - len(set(lines))) > 3 * len(lines) or not 2 * len(w) <= chars <= 15 * len(w))
    n = Counter(d[2] for d in docs)
    k = Counter()
    for d, f in zip(docs, failed, strict=True):
        k[d[2]] += f
    mean = sum(failed) / len(docs)
    spread = sum(k[h] ** 2 / n[h] for h in n) / len(docs) - mean**2
    low, high = host_rules.PRIOR_WEIGHT
    weight = min(high, max(low, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else high
    strict = {h: (k[h] + mean * weight) / (n[h] + weight) > host_rules.STRICT_ABOVE for h in n}
    return [d for d, b, f in zip(docs, base, failed, strict=True) if not b and not (strict[d[2]] and f)]


def by_hand_near(docs):
    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = split(w)
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    marked = sorted((i, shingles(t)) for i, t, _ in docs)
    group = {i: i for i, _ in marked}
    for i, s in marked:
        for j, t in marked:
            if i < j and group[i] != group[j] and len(s & t) >= 0.8 * len(s | t):
                low, high = sorted((group[i], group[j]))
                group = {k: low if v == high else v for k, v in group.items()}
    return [d for d in docs if group[d[0]] == d[0]]


def by_hand_mix(docs):
    """(doc_id, text) for each time a document is taken."""
    size = {i: len(split(t)) for i, t, _ in docs}
    total = Counter()
    for i, _, s in docs:
        total[s] += size[i]
    weight = dict(zip(sorted(total), [5, 2, 1] * len(total), strict=False))
    target, free, left = {}, set(total), 1.5 * sum(total.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 2 * total[s]}
        target |= {s: 2 * total[s] for s in over} if over else {s: weight[s] * level for s in free}
        left -= sum(target[s] for s in over)
        free = free - over if over else set()
    out = []
    for s in total:
        epochs = math.floor(target[s] / total[s])
        rest = round(target[s] - epochs * total[s])
        keyed = []
        for i, t, source in docs:
            if source == s:
                u = (int(hashlib.md5(f"17:{i}:{hashlib.md5(t.encode()).hexdigest()}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                quality = 0.5 + 0.5 / (1 + 20 * sum(c in "#*$%&|<>" for c in t) / max(len(t), 1))
                keyed.append((-math.log(u) / quality, i, t))
        for _, i, t in sorted(k for k in keyed if size[k[1]]):
            part = min(size[i], rest)
            rest -= part
            out += [(i, t)] * (epochs + (part == size[i]))
            if 0 < part < size[i]:
                out.append((i, re.match(rf"(?:[ \t-\r]*[^ \t-\r]+){{{part}}}", t)[0]))
    return out


def test_pipeline_by_hand(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = np.random.default_rng(11)
    vocabulary = ["".join(rng.choice(list("abcdefghijk"), 5)) for _ in range(400)]
    prose = lambda n: [" ".join(rng.choice(vocabulary, 12)) for _ in range(n)]
    passage = prose(14)
    rows = []
    for i in range(90):
        lines = prose(int(rng.integers(6, 16)))
        if i % 6 == 0:
            lines[3:3] = passage
        rows.append((i, "\n".join(lines), f"host{i % 4}"))
    rows += [(200 + i, rows[i][1], "host1") for i in range(0, 20, 2)]  # copies
    rows += [(300 + i, rows[i][1].upper() + " end", "host2") for i in range(1, 15, 2)]
    rows += [(400 + i, "too short", "junk") for i in range(12)] + [(500, "## $$ " * 30 + rows[1][1], "junk"), (501, rows[5][1] + " last", "junk"), (502, "same words here again " * 40, "host0")]
    spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], DOCS).write.parquet(f"{tmp_path}/documents.parquet")

    want = by_hand_quality(rows)
    assert 0 < len(want) < len(rows)
    texts = dedup_by_hand([(i, t) for i, t, _ in want])
    assert any(texts[i] != t for i, t, _ in want)
    want = by_hand_near([(i, texts[i], s) for i, _, s in want])
    taken = by_hand_mix(want)
    assert max(Counter(i for i, _ in taken).values()) > 1

    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        if name == "near-dedup":
            assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted((i, t) for i, t, _ in want)
    assert sorted((r.doc_id, r.text) for r in now.collect()) == sorted(taken)

    t = Tokenizer.from_file(queries.tokenizer("word_bpe_49k.json"))
    tokens = Counter()
    for i, text in taken:
        tokens[i] += len(t.encode(text, add_special_tokens=False).ids) + 1
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert got.groupby("doc_id").length.sum().to_dict() == tokens
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset.to_numpy() == np.r_[0, np.cumsum(s.length)[:-1]]).all() and s.length.sum() <= 2048


def test_stages_on_odd_tables(spark):
    """Nulls, repeated rows, empty tables and more columns, whose names clash with those that operators add."""
    clash = {"extra": F.lit(1), "size": F.lit("x"), "weight": F.lit(2), "kept": F.lit("x"), "n_lines": F.lit(0), "key": F.lit("x"), "fp": F.lit("x"), "group": F.lit("x"), "taken": F.lit("x"), "source_size": F.lit("x"), "target": F.lit("x"), "signature": F.lit("x"), "host": F.lit("x")}
    clash |= {n: F.lit("x") for n in ("words", "lines", "line_count", "_words", "_host", "_owner", "_keep", "_taken", "_size", "_key", "hash", "row", "id", "h", "piece", "keep", "new", "salt", "ids", "first", "second", "digest", "size_")}
    long = [(20 + i, " ".join(f"w{i}x{k}" for k in range(60)), None, None if i % 2 else "a", None) for i in range(6)]
    for rows in (ODD + long, []):
        docs = spark.createDataFrame(rows, DOCS).withColumns(clash)
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, "")
            if name != "packing":
                assert out.columns == docs.columns, name
            n = out.count()
            assert (n > 0) == bool(rows), name


def test_near_copies_of_five_words(spark):
    """Copies with edits go, at every place of the threshold; texts that share only a passage stay."""
    rng = np.random.default_rng(3)
    passage = " ".join(f"common{i}" for i in range(60))
    docs = []
    for base in range(60):
        w = [f"w{base}x{k}" for k in rng.integers(0, 10_000, 300)]
        docs.append((10 * base, " ".join(w), "a"))
        for k, edits in enumerate((0, 1, 4, 12, 40)):
            v = list(w)
            for at in rng.choice(300, edits, replace=False):
                v[at] = f"e{base}y{k}z{at}"
            docs.append((10 * base + k + 1, " ".join(v).upper() if k == 1 else " ".join(v), "a"))
        docs.append((10 * base + 9, f"{passage} " + " ".join(f"o{base}u{k}" for k in range(30)), "b"))
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = {r.doc_id for r in simhash.first_of_each(table).select("doc_id").collect()}
    assert kept == {d[0] for d in by_hand_near(docs)}


def test_near_copies_left_in_a_bucket(spark, monkeypatch):
    """Pairs of near copies in buckets of many texts with a common passage, where neither is near a pivot."""
    monkeypatch.setattr(simhash, "LEVELS", 0)
    monkeypatch.setattr(simhash, "REST", 4, raising=False)
    rng = np.random.default_rng(5)
    passage = [f"common{i}" for i in range(400)]
    docs = []
    for base in range(120):
        w = passage + [f"o{base}u{k}" for k in range(120)]
        docs.append((2 * base, " ".join(w), "a"))
        if base % 3 == 0:
            for at in 400 + rng.choice(120, 10, replace=False):
                w[at] = f"e{base}z{at}"
            docs.append((2 * base + 1, " ".join(w), "a"))
    table = spark.createDataFrame(docs, "doc_id long, text string, source string")
    kept = {r.doc_id for r in simhash.first_of_each(table).select("doc_id").collect()}
    assert kept == {d[0] for d in by_hand_near(docs)}


def test_near_copies_of_odd_rows(spark):
    long_text = " ".join(f"a{i}" for i in range(50_000))
    rows = [(1, None, 1), (2, "", 2), (3, " \n", 3), (4, "one two", 4), (5, "ONE  two", 5), (6, long_text, 6), (7, long_text + " more", 7), (None, "alone here", 8), (None, "alone here", 9), (None, "one two", 10), (8, "rep", 11), (8, "rep", 12)]
    table = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    out = simhash.first_of_each(table)
    assert out.columns == table.columns
    kept = {r.doc_id: r.text for r in out.collect()}
    assert set(kept) == {1, 4, 6, 8, None} and kept[None] == "alone here" and out.count() == 5
    assert simhash.first_of_each(table.limit(0)).count() == 0
