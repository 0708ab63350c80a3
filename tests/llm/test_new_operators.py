"""Importance resampling, bin completion and periodic runs against brute force, and their defined results in odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_operators import BIG, DOCS, ODD

from codelens.llm import bin_completion, chat, importance, line_dedup, pii, pitman_yor, queries, runs, simhash

MORE = [*ODD, (10, "a " * 5000, "en", "b", 0), (11, "Ä" * 3000 + " x", "en", "b", 0), (12, BIG + "\n" + BIG, None, None, None)]


@pytest.fixture(scope="module")
def odd(spark):
    clash = {c: F.lit("clash") for c in ("rank", "score", "weight", "row", "place", "piece", "start", "length", "runs", "collapsed", "buckets", "may")}
    return spark.createDataFrame(MORE, DOCS).withColumns(clash)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


# ------------------------------------------------------------------ 11


def ascii_lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def resampled(docs, target, max_words, percent=10, buckets=10_000):
    """Plain Python: ``[(doc_id, n_features, weight, score)]`` and the drawn places of the rows."""

    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", ascii_lower(text))
        return [zlib.crc32(" ".join(w[i : i + k]).encode()) % buckets for k in range(1, max_words + 1) for i in range(len(w) - k + 1)], len(w)

    own = [feats(t) for _, t in docs]
    s, t = Counter(b for f, _ in own for b in f), Counter(b for x in target for b in feats(x)[0])
    sn, tn = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sn + buckets) / ((s[b] + 1) * (tn + buckets))))
    out = []
    for (i, _), (f, _) in zip(docs, own, strict=True):
        h = int(hashlib.sha256(f"2024:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(map(gain, f))
        out.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    may = [k for k, (_, n) in enumerate(own) if n >= 20]
    order = sorted(may, key=lambda k: (-out[k][3], -1 if out[k][0] is None else out[k][0], k))
    return out, order[: len(may) * percent // 100]


@pytest.mark.parametrize("max_words", [1, 3])
def test_resample(spark, odd, max_words):
    target = ["a a x y z same line", None, "", "Ä w3 w4 W5 w6"]
    docs = [(i, t) for i, t, *_ in MORE] + [(100 + i, " ".join(f"w{(i * k) % 50}" for k in range(30))) for i in range(200)]
    table = odd.select("doc_id", "text", "rank", "weight").unionByName(spark.createDataFrame(docs[len(MORE) :], "doc_id long, text string"), True)
    got = importance.resample(table, spark.createDataFrame([(t,) for t in target], "text string"), max_words).collect()
    want, drawn = resampled(docs, target, max_words)
    assert sorted(map(repr, ((r.doc_id, r.n_features, r.weight, r.score) for r in got))) == sorted(map(repr, want))
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1)) and len(drawn) == 20
    assert [r.doc_id for r in ranked] == [docs[k][0] for k in drawn]


def test_resample_prefers_the_target(spark):
    texts = [(i, " ".join(f"{'ab'[i % 2]}{(i * k) % 97}" for k in range(40))) for i in range(400)]
    target = spark.createDataFrame([(" ".join(f"a{k}" for k in range(97)),)], "text string")
    got = importance.resample(spark.createDataFrame(texts, "doc_id long, text string"), target, percent=20).where("rank IS NOT NULL")
    assert got.count() == 80 and got.where("doc_id % 2 = 0").count() >= 76


def test_resample_empty(spark, odd, none):
    assert importance.resample(none, odd).count() == 0
    got = importance.resample(odd, none)
    assert got.count() == len(MORE) and got.where("weight IS NULL OR score IS NULL").count() == 0


def test_crc_of_runs_of_words():
    """The CRC of words on end from their payloads, words of thousands of bytes included."""
    rng = random.Random(3)
    words_ = ["".join(rng.choice("abcé") for _ in range(rng.choice([1, 2, 7, 300, 5000]))) for _ in range(40)]
    flat = (" " + " ".join(words_) + " ").encode() + b"\xff "
    d = importance.Dictionary(flat)
    found, n, n_words = importance.features(d, d.scan(flat), 4, 1 << 32 - 1, importance.Shift())
    want = [zlib.crc32(" ".join(words_[i : i + k]).encode()) % (1 << 31) for k in range(1, 5) for i in range(len(words_) - k + 1)]
    assert found.tolist() == want and n.tolist() == [len(want)] and n_words.tolist() == [40]


def test_scan_meets_whole_words_only():
    flat = importance.plain(__import__("pyarrow").array(["abc ab-BC c", None, "bc,,x1 abcab"]))
    d = importance.Dictionary(flat)
    got = [int(d.crc[k]) if k >= 0 else None for k in d.scan(flat)]
    crc = lambda *w: [zlib.crc32(x.encode()) for x in w]
    assert got == [*crc("abc", "ab", "bc", "c"), None, None, *crc("bc", "x1", "abcab"), None]


# ------------------------------------------------------------------ 12


def packs(got, docs, window):
    """Each id of a document lies in one piece, and each sequence is gapless and not too long."""
    by_doc = Counter()
    for r in got:
        by_doc[r.doc_id] += r.length
        assert r.start == r.piece * window and 1 <= r.length <= window
    assert by_doc == docs
    for pieces in sequences(got).values():
        at = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= window


def sequences(got):
    out = {}
    for r in got:
        out.setdefault(r.sequence_id, []).append(r)
    return out


def test_best_fit_packing(spark, odd):
    from tokenizers import Tokenizer

    sample = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    path = queries.tokenizer("word_bpe_49k.json")
    plain = Tokenizer.from_file(path)
    for docs, window in ((odd, 2048), (sample, 2048), (sample, 300)):
        texts = [(r.doc_id, r.text or "") for r in docs.collect()]
        ids = [(i, [*plain.encode(t, add_special_tokens=False).ids, 0]) for i, t in texts]
        got = bin_completion.pack_best_fit(docs, path, window).collect()
        tokens = Counter()
        for i, x in ids:
            tokens[i] += len(x)
        packs(got, tokens, window)
        cut = lambda x: [x[a : a + window] for a in range(0, len(x), window)]
        want = Counter((i, k, len(p), zlib.crc32(np.array(p, "<u4").tobytes())) for i, x in ids for k, p in enumerate(cut(x)))
        assert Counter((r.doc_id, r.piece, r.length, r.ids_crc32) for r in got) == want
        lengths = np.bincount([r.length for r in got], minlength=window + 1)
        assert len(sequences(got)) <= bin_completion.size(bin_completion.best_fit(lengths, window))


def fewest(lengths, window):
    """The optimum, by trying all sequences for each piece."""
    lengths = sorted(lengths, reverse=True)
    best = [len(lengths)]

    def place(k, rooms):
        if len(rooms) >= best[0]:
            return
        if k == len(lengths):
            best[0] = len(rooms)
            return
        for r in sorted({r for r in rooms if r >= lengths[k]}):
            left = list(rooms)
            left.remove(r)
            place(k + 1, [*left, r - lengths[k]])
        place(k + 1, [*rooms, window - lengths[k]])

    place(0, [])
    return best[0]


def test_plans_are_the_fewest_sequences():
    rng = random.Random(5)
    for _ in range(60):
        window = rng.choice([20, 50, 100])
        lengths = [rng.randint(1, window) if rng.random() < 0.5 else rng.randint(window // 5, window // 2) for _ in range(rng.randint(0, 11))]
        counts = np.bincount(lengths, minlength=window + 1).astype(np.int64) if lengths else np.zeros(window + 1, np.int64)
        planned = bin_completion.plan(counts, window)
        assert Counter(lengths) == Counter(x for f, n in planned for x in f * n) and all(sum(f) <= window for f, _ in planned)
        want = fewest(lengths, window)
        assert bin_completion.least(counts, window) <= want
        assert bin_completion.size(planned) == want


def test_search_betters_best_fit():
    """Over random pieces, the search meets the lower bound where best fit does not."""
    rng = random.Random(1)
    gained = 0
    for _ in range(300):
        window = rng.choice([20, 30, 50])
        counts = np.bincount([rng.randint(window // 6, window // 2 + 3) for _ in range(rng.randint(8, 24))], minlength=window + 1).astype(np.int64)
        fit, planned = (bin_completion.size(f(counts, window)) for f in (bin_completion.best_fit, bin_completion.plan))
        assert bin_completion.least(counts, window) <= planned <= fit
        gained += fit - planned
    assert gained >= 10


def test_packing_empty(spark, none):
    assert bin_completion.pack_best_fit(none, queries.tokenizer("word_bpe_49k.json")).count() == 0


# ------------------------------------------------------------------ 13


def plain_runs(words_):
    """All maximal stretches of a period, by comparing words one by one."""
    found = {}
    for q in range(1, len(words_) // 4 + 1):
        i = 0
        while i + q < len(words_):
            j = i
            while j + q < len(words_) and words_[j] == words_[j + q]:
                j += 1
            if j - i + q >= max(6, 4 * q) and j > i:
                found.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((a, n, q) for (a, n), q in found.items())


def collapsed(words_, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return " ".join(w for i, w in enumerate(words_) if i not in gone)


def made_texts(rng):
    for _ in range(300):
        few = rng.choice(["ab", "abc", "a"])
        block = [rng.choice(few) for _ in range(rng.randint(1, 30))]
        inner = block * rng.randint(1, 6) + [rng.choice("cd") for _ in range(rng.randint(0, 3))]
        yield [*(rng.choice("xyz") for _ in range(rng.randint(0, 5))), *(inner * rng.randint(1, 6))[: rng.randint(1, 250)], *(rng.choice("ab") for _ in range(rng.randint(0, 40)))]
    a, b = ["a"], ["a", "b"]
    while len(b) < 400:
        a, b = b, b + a
    yield b


def test_runs_against_plain_search(spark):
    texts = [(i, " ".join(w)) for i, w in enumerate(made_texts(random.Random(7)))]
    found = 0
    for r in runs.periodic_runs(spark.createDataFrame(texts, "doc_id long, text string")).collect():
        w = texts[r.doc_id][1].split()
        want = plain_runs(w)
        assert [(x.start, x.length, x.period) for x in r.runs] == want
        assert r.collapsed == collapsed(w, want)
        found += len(want)
    assert found > 500


def test_runs_of_odd_tables(spark, odd, none):
    assert runs.periodic_runs(none).count() == 0
    got = runs.periodic_runs(odd).collect()
    want = sorted(repr((i, plain_runs((t or "").split(" ") if i == 10 else []) if i == 10 else None)) for i, t, *_ in MORE)
    assert len(got) == len(want)
    by_id = {r.doc_id: r for r in got}
    assert [tuple(x) for x in by_id[10].runs] == [(0, 5000, 1)] and by_id[10].collapsed == "a"
    assert by_id[1].runs == [] and by_id[1].collapsed == "" and by_id[2].collapsed == "" and by_id[6].collapsed == ""
    # 6000 words of period 700, twice: one run of 8.6 periods, then another.
    assert [tuple(x) for x in by_id[3].runs] == [(0, 6000, 700)] and by_id[3].collapsed == " ".join(f"w{i}" for i in range(700))
    assert [tuple(x) for x in by_id[12].runs] == [(0, 6000, 700), (6000, 6000, 700)]
    with pytest.raises(ValueError):
        runs.periodic_runs(odd, min_times=3)


def test_progressions_of_candidate_periods():
    """A block that is periodic itself: its copies form two progressions, and their ends give the run's period."""
    w = np.array(([0, 1] * 9 + [2]) * 5)
    at, length, period = runs.text_runs(np.zeros(len(w), np.int64), w)
    assert (0, 95, 19) in list(zip(at.tolist(), length.tolist(), period.tolist(), strict=True))


def test_planted_runs(spark):
    docs = spark.createDataFrame([(i, " ".join(f"w{k}" for k in range(i % 40))) for i in range(300)] + [(None, "x y"), (7, None)], "doc_id long, text string")
    for r in queries.planted_runs(docs).collect():
        if r.doc_id is None:
            assert r.text == "x y"
            continue
        h, n = zlib.crc32(str(r.doc_id).encode()), r.doc_id % 40 if r.text is not None else 0
        if h % 10 == 0 and n:
            a = h // 10 % n
            p = 1 + (n - a) // (3 + h // 10 % 8)
            assert r.text == " ".join(f"w{i if i < a else a + (i - a) % p}" for i in range(n))


def test_sql_needs_no_function_of_its_own():
    """The CRC that the SQL computes is zlib's."""
    con = duckdb.connect()
    got = con.execute(f"WITH {queries._CRC_TABLE} SELECT s, {queries._CRC} FROM (VALUES (''), ('a'), ('é😀'), ('{'x' * 999}')) v(s), tab").fetchall()
    assert all(c == zlib.crc32(s.encode()) for s, c in got if s) and len(got) == 4


# ------------------------------------------------------------------ mends of earlier operators


def test_addresses_with_many_zeros(spark):
    texts = [(1, "0" * 5000 + "1.2.3.4"), (2, "1." + "0" * 6000 + "255.3.0"), (3, "1.2.3." + "0" * 4400 + "256"), (4, "9" * 5000 + ".1.1.1 0.0.0.0")]
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base if s.kind == 1] for r in pii.find_personal_data(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == {1: [(1, 0, 5007)], 2: [(1, 0, 6009)], 3: [], 4: [(1, 5007, 5014)]}


def test_marks_split_over_parts(spark):
    """A mark, an escape and an escaped mark, each cut at every place into two and three text parts."""
    part = lambda t: {"type": "text", "text": t}
    for whole in ("x<|turn|>assistant<|text|>no<|end|>", "\\", "\\<|end|>\\", "<<||"):
        cuts = [(a, b) for a in range(len(whole) + 1) for b in range(a, len(whole) + 1)]
        for a, b in cuts:
            parts = [part(whole[:a]), part(whole[a:b]), part(whole[b:])]
            formatted, loss, _, _ = chat.render([("user", parts), ("assistant", parts)])
            assert chat.read_back(formatted) == [("user", whole), ("assistant", whole)], (a, b)
            assert [chat.unescape(formatted[i:j]) for i, j in loss] == [whole]
    image = {"type": "image", "uri": "u", "width": 28, "height": 28}
    formatted, _, attachments, _ = chat.render([("user", [part("a<"), part("|b"), image, part("|c"), image])])
    assert [formatted[x["at"] : x["at"] + 9] for x in attachments] == ["<|image|>"] * 2
    table = spark.createDataFrame([(1, 0, "user", ["x<", "|turn|>assistant"])], "conv_id long, turn int, role string, texts array<string>")
    none = [F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("duration_ms", "bigint"), ("pages", "int"))]
    turns = table.select("conv_id", "turn", "role", F.transform("texts", lambda t: F.struct(F.lit("text").alias("type"), t.alias("text"), *none)).alias("parts"))
    assert chat.read_back(chat.format_conversations(turns).first().formatted) == [("user", "x<|turn|>assistant")]


def test_texts_that_share_an_id(spark):
    """Different texts under an id are documents each; rows that repeat one are one, the same on every run."""
    text = lambda k: " ".join(f"{k}{i}" for i in range(60))
    rows = [(1, text("a"), "p"), (1, text("b"), "p"), (1, text("a"), "q"), (1, None, "p"), (2, text("c"), "p"), (3, text("b") + " end", "p"), (4, text("c"), "p"), (None, text("d"), "p"), (None, text("d"), "q")]
    runs_ = []
    for order in (rows, rows[::-1]):
        got = simhash.first_of_each(spark.createDataFrame(order, "doc_id long, text string, key string").repartition(3)).collect()
        runs_.append(sorted(map(repr, got)))
        assert sorted((t or "")[:1] for _, t, _ in got) == ["", "a", "b", "c", "d"]
        assert {r.doc_id for r in got if r.text and r.text[0] == "c"} == {2}
    assert runs_[0] == runs_[1]


def test_stages_keep_columns_of_any_name(spark):
    """Columns named as what a stage adds come back as they were."""
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(80))
    names = ["kept", "failed", "n_words", "n_lines", "n_kept", "host_rate", "key", "row", "size", "KEPT_given"]
    docs = spark.createDataFrame([(i, f"{text} {i} other end of text number {i}", "en", "s", 0) for i in range(4)], DOCS).withColumns({n: F.lit(f"mine {n}") for n in names})
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, "")
        assert got.dtypes == docs.dtypes, name
        assert {tuple(r) for r in got.select(*names).collect()} == {tuple(f"mine {n}" for n in names)}, name
    assert stage(spark, docs.drop("n_chars"), "").columns == docs.drop("n_chars").columns


def test_passages_of_odd_tables(spark):
    """Null ids and texts that share an id are documents each; columns of any name come back as given."""
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(None, f"{passage} x"), (None, f"y {passage}"), (None, f"z {passage} z"), (5, f"{passage} five"), (5, f"six {passage}"), (5, None), (7, f"{passage} five"), (7, f"{passage} five")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(f"mine {n}") for n in ("_owner", "_keep", "_units", "_gone", "units", "keep", "row", "hash", "id")})
    got = line_dedup.dedup_passages(docs)
    assert got.dtypes == docs.dtypes
    rows = got.collect()
    assert len(rows) == 8 and all(r["_units"] == "mine _units" and r["id"] == "mine id" and r["hash"] == "mine hash" for r in rows)
    holding = [r for r in rows if r.text and passage in r.text]
    assert [r.doc_id for r in holding] == [5]
    assert sum(len((r.text or "").split()) for r in rows) < 61 + 7 * 30


def sampled_scores(docs, contexts, burn_in, samples, seed):
    """Plain Gibbs sampling of the restaurants, a customer at a time, tables as lists: averaged log10 probabilities of texts."""
    rng, strength = random.Random(seed), pitman_yor.STRENGTH
    train = [(u, w) for i, pairs in contexts.items() if not pitman_yor.held_out(i) for u, w in pairs]
    base = 1 / (len({w for _, w in train}) + 1)
    leaf, root = defaultdict(list), defaultdict(list)
    own, tables = Counter(), Counter()
    total = {"customers": 0, "tables": 0}
    often = Counter(train)
    share = lambda a, b: min(0.95, max(0.1, a / (a + 2 * b) if a else 0.1))
    discount = share(*(sum(n == k for n in often.values()) for k in (1, 2)))
    top = [0.5]

    def parent(w):
        t = root[w]
        return (sum(t) - top[0] * len(t) + (strength + top[0] * total["tables"]) * base) / (strength + total["customers"])

    def sit(t, d, new):
        at = rng.random() * (sum(t) - d * len(t) + new)
        for k, n in enumerate(t):
            at -= n - d
            if at < 0:
                t[k] += 1
                return False
        t.append(1)
        return True

    def leave(t):
        at = rng.random() * sum(t)
        for k, n in enumerate(t):
            at -= n
            if at < 0:
                break
        t[k] -= 1
        if not t[k]:
            t.pop(k)
            return True
        return False

    def add(u, w):
        own[u] += 1
        if sit(leaf[u, w], discount, (strength + discount * tables[u]) * parent(w)):
            tables[u] += 1
            total["customers"] += 1
            total["tables"] += sit(root[w], top[0], (strength + top[0] * total["tables"]) * base)

    def remove(u, w):
        own[u] -= 1
        if leave(leaf[u, w]):
            tables[u] -= 1
            total["customers"] -= 1
            total["tables"] -= leave(root[w])

    for u, w in train:
        add(u, w)
    sums = defaultdict(float)
    for sweep in range(burn_in + samples):
        for u, w in train:
            remove(u, w)
            add(u, w)
        seen = Counter(sum(t) for t in root.values())
        top[0] = share(seen[1], seen[2])
        if sweep >= burn_in:
            for u, w in {x for pairs in contexts.values() for x in pairs}:
                t = leaf[u, w]
                sums[u, w] += ((sum(t) - discount * len(t)) + (strength + discount * tables[u]) * parent(w)) / (strength + own[u]) / samples
    return {i: sum(math.log10(sums[x]) for x in pairs) for i, pairs in contexts.items()}


def test_language_model_against_plain_sampling(spark):
    """Scores of each text within what two runs of the plain sampler differ by, and a little for the few sweeps."""
    rng = np.random.default_rng(8)
    words_ = [f"word{i}" for i in range(60)] + ["a", "of", "the", "in", "zu"]
    weight = 1 / np.arange(1, len(words_) + 1) ** 1.1
    docs = [(i, " ".join(rng.choice(words_, int(rng.integers(5, 120)), p=weight[rng.permutation(len(words_))] / weight.sum()))) for i in range(34)]
    contexts = {}
    for i, text in docs:
        last, pairs = pitman_yor.CONTEXTS - 1, []
        for w in pitman_yor.tokens_of(text):
            pairs.append((last, w))
            if 0 < len(w) <= 3:
                last = xxhash.xxh32_intdigest(w, 1) % (pitman_yor.CONTEXTS - 1)
        contexts[i] = pairs
    got = {r.doc_id: r.score for r in pitman_yor.score_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    plain, again = (sampled_scores(docs, contexts, 10, 20, seed) for seed in (1, 2))
    off = lambda a, b: max(abs(a[i] - b[i]) / len(contexts[i]) for i in a)
    assert sum(pitman_yor.held_out(i) for i, _ in docs) >= 2
    assert off(plain, again) < 0.02 and off(got, plain) < 0.05
    total = lambda a: sum(a.values()) / sum(map(len, contexts.values()))
    assert abs(total(got) - total(plain)) < 0.01


@pytest.mark.parametrize("part", [1 << 24, 1 << 11])
def test_language_model_of_whole_words_against_plain_sampling(spark, monkeypatch, part):
    """Each word before another is a context of its own, with one part and with several that sum their contexts."""
    monkeypatch.setattr(pitman_yor, "WHOLE_PART", part)
    monkeypatch.setattr(pitman_yor, "TOGETHER", 2)
    rng = np.random.default_rng(9)
    words_ = [f"word{i}" for i in range(12)] + ["a", "of"]
    docs, w = [], 0
    for i in range(34):
        some = []
        for _ in range(int(rng.integers(5, 120))):
            w = (3 * w + int(rng.choice([0, 1, 2], p=[0.8, 0.15, 0.05]))) % len(words_) if rng.random() < 0.9 else int(rng.integers(len(words_)))
            some.append(words_[w])
        docs.append((i, " ".join(some)))
    contexts = {i: list(zip([None, *pitman_yor.tokens_of(t)], pitman_yor.tokens_of(t), strict=False)) for i, t in docs}
    table = spark.createDataFrame(docs, "doc_id long, text string")
    got, short = ({r.doc_id: r.score for r in pitman_yor.score_documents(table, whole=x).collect()} for x in (True, False))
    plain, again = (sampled_scores(docs, contexts, 10, 20, seed) for seed in (1, 2))
    off = lambda a, b: max(abs(a[i] - b[i]) / len(contexts[i]) for i in a)
    total = lambda a: sum(a.values()) / sum(map(len, contexts.values()))
    assert off(plain, again) < 0.02 and off(got, plain) < 0.05 and abs(total(got) - total(plain)) < 0.01
    out = [i for i, _ in docs if pitman_yor.held_out(i)]
    assert len(out) >= 2 and sum(got[i] - short[i] for i in out) > 0


def test_language_model_of_whole_words_on_odd_tables(spark):
    odd = spark.createDataFrame(ODD, DOCS)
    got = pitman_yor.score_documents(odd, whole=True).collect()
    assert pitman_yor.score_documents(odd.limit(0), whole=True).count() == 0
    assert sorted(r.n_tokens for r in got) == sorted(len(pitman_yor.tokens_of(r[1])) for r in ODD) and all(-1e6 < r.score < 0 for r in got)
    assert len({r.score for r in got if r.doc_id == 4}) == 1
