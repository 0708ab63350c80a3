"""Hierarchical Pitman-Yor language model, its seating sampled by Gibbs, scoring whole documents.

Restaurants.  With ``whole`` contexts, each word before another, or the start, has a restaurant of its own, told
apart by its 64-bit hash.  Without, a word's context is the last word of at most three bytes before it, hashed to one of
``CONTEXTS - 1`` restaurants; the last restaurant serves words that no such word precedes.  All context
restaurants share one parent, whose base is even over the training vocabulary and one unknown word.

Work.  Texts are read once, in blocks.  A block keeps its tokens as numbers of (word, context) pairs, and
sends each word's pairs and counts to the part that the word hashes to; a block sends at most a row a
word and context, so no word is hot.  Parts keep the seating of their words.  In a sweep, totals of all
restaurants are held as they were before it, so parts work apart; totals are then summed anew.  Parts answer
each block's pairs in the block's order, and blocks sum their documents.  Every step starts at a written
table.  Nothing but totals of the ``CONTEXTS`` restaurants, or of all together, reaches the driver: whole contexts are
dealt to parts by their hashes, where each part's customers and tables of a context are summed and sent back.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import discard, materialise
from .tables import drawn

CONTEXTS = 128
#: Bytes of text in a block, bytes of text that a part of the vocabulary stands for, also with whole contexts, and parts
#: whose whole contexts are summed together.
BLOCK, PART, WHOLE_PART, TOGETHER = 16 << 20, 32 << 20, 8 << 20, 4
#: Sweeps before samples count, samples, strength of both levels.
BURN_IN, SAMPLES, STRENGTH = 1, 2, 5.0
#: Customers of a dish up to which each is moved on its own in a sweep; those of a larger dish are moved together, by a
#: draw of its tables from their exact distribution given all other dishes.
MOVED = 8
END = b""


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def tokens_of(text: str | None) -> list[bytes]:
    """Words with A-Z lower-cased, then the end."""
    w = (text or "").encode("utf-8", "surrogatepass").lower().split()
    w.append(END)
    return w


class Block:
    """Tokens of some documents, numbered by a vocabulary of its own."""

    def __init__(self) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.tokens: list[np.ndarray] = []
        self.ids: list = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        vocabulary = self.vocabulary
        words = tokens_of(text)
        self.tokens.append(np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words], np.int32))
        self.ids.append(doc_id)
        self.bytes += len(text or "") + 8

    def rows(self, block: int, parts: int, whole: bool) -> list[dict]:
        """The block's own row, of part -1, and a row for each part of the vocabulary."""
        words = list(self.vocabulary)
        part = np.fromiter((xxhash.xxh32_intdigest(w) % parts for w in words), np.int64, len(words))
        order = np.lexsort((np.arange(len(words)), part))
        place = np.empty(len(words), np.int64)
        place[order] = np.arange(len(words))
        class_of = np.fromiter((xxhash.xxh32_intdigest(w, 1) % (CONTEXTS - 1) if 0 < len(w) <= 3 else -1 for w in words), np.int64, len(words))
        lengths = np.array([len(t) for t in self.tokens])
        ids = np.concatenate(self.tokens)
        starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
        at = np.arange(len(ids))
        if whole:
            contexts = np.array([*(xxhash.xxh64_intdigest(w) for w in words), 0], "<u8")
            context = np.where(at > starts, np.r_[0, ids[:-1]], len(words))
        else:
            contexts = np.arange(CONTEXTS).astype("u1")
            last = np.maximum.accumulate(np.where(class_of[ids] >= 0, at, -1))
            before = np.r_[-1, last[:-1]]
            context = np.where(before >= starts, class_of[ids[before]], CONTEXTS - 1)
        train = np.repeat(~np.fromiter((held_out(i) for i in self.ids), bool, len(self.ids)), lengths)
        pairs, token = np.unique(place[ids] * len(contexts) + context, return_inverse=True)
        count = np.bincount(token, train, len(pairs)).astype(np.int64)
        word, context = pairs // len(contexts), contexts[pairs % len(contexts)]
        of_word = np.bincount(word, minlength=len(words))
        word_at, pair_at = np.searchsorted(part[order], np.arange(parts + 1)), None
        pair_at = np.r_[0, np.cumsum(of_word)][word_at]
        empty = {"block": block, "part": -1, "words": None, "pairs": None, "context": None, "count": None, "docs": None, "lengths": None, "tokens": None}
        out = [empty | {"docs": self.ids, "lengths": lengths.tolist(), "tokens": token.astype("<u4").tobytes()}]
        for p in range(parts):
            a, b, c, d = word_at[p], word_at[p + 1], pair_at[p], pair_at[p + 1]
            if b > a:
                out.append(empty | {"part": p, "words": b" ".join([words[i] for i in order[a:b]]), "pairs": of_word[a:b].astype("<u4").tobytes(), "context": context[c:d].tobytes(), "count": count[c:d].astype("<u4").tobytes()})
        return out


RAW = "block long, part int, words binary, pairs binary, context binary, count binary, docs array<long>, lengths array<long>, tokens binary"
_RAW = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary()), ("context", pa.binary()), ("count", pa.binary()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("tokens", pa.binary())])


def read_blocks(docs: DataFrame, parts: int, id_col: str, text_col: str, whole: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() << 32, Block()
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                block.add(doc.as_py(), text.as_py())
                if block.bytes >= BLOCK:
                    yield pa.RecordBatch.from_pylist(block.rows(number, parts, whole), _RAW)
                    number, block = number + 1, Block()
        if block.ids:
            yield pa.RecordBatch.from_pylist(block.rows(number, parts, whole), _RAW)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, RAW)


def _numbers(data: bytes | None, kind: str) -> np.ndarray:
    return np.frombuffer(data or b"", kind).astype(np.int64)


def _places(data: bytes) -> np.ndarray:
    """Each place as often as its number says."""
    n = _numbers(data, "<u4")
    return np.repeat(np.arange(len(n)), n)


def gather(table: pa.Table, whole: bool) -> tuple[list[tuple[int, np.ndarray, np.ndarray, np.ndarray]], int, np.ndarray]:
    """A part's blocks in order: block, its words' numbers in the part, and pairs and contexts; the part's words and contexts."""
    number: dict[bytes, int] = {}
    rows = sorted(table.select(["block", "words", "pairs", "context", "count"]).to_pylist(), key=lambda r: r["block"])
    given = [np.frombuffer(row["context"], "<u8" if whole else "u1") for row in rows]
    contexts = np.unique(np.concatenate(given)) if whole else np.arange(CONTEXTS)
    out = []
    for row, own in zip(rows, given, strict=True):
        ids = np.array([number.setdefault(w, len(number)) for w in row["words"].split(b" ")], np.int64)
        key = np.repeat(ids, _numbers(row["pairs"], "<u4")) * len(contexts) + np.searchsorted(contexts, own)
        out.append((row["block"], ids, key, _numbers(row["count"], "<u4")))
    return out, len(number), contexts


class Seating:
    """Tables of many items, an item being a dish in a restaurant; ``discount`` is the restaurants'."""

    def __init__(self, item: np.ndarray, size: np.ndarray, n: int, discount: float, rng: np.random.Generator) -> None:
        self.item, self.size, self.n, self.discount, self.rng = item, size, n, discount, rng

    @classmethod
    def start(cls, customers: np.ndarray, weight: np.ndarray, discount: float, rng: np.random.Generator) -> Seating:
        """About as many tables as customers arriving one by one would open; the first holds the rest."""
        more = weight * np.log1p(np.maximum(customers - 1, 0) / (1 + weight))
        extra = np.minimum(rng.poisson(np.minimum(more, customers)), np.maximum(customers - 1, 0))
        some = np.flatnonzero(customers > 0)
        item = np.concatenate([some, np.repeat(np.arange(len(customers)), extra)])
        size = np.concatenate([(customers - extra)[some], np.ones(extra.sum(), np.int64)])
        order = np.argsort(item, kind="stable")
        return cls(item[order], size[order], len(customers), discount, rng)

    def customers(self) -> np.ndarray:
        return np.bincount(self.item, self.size, self.n).astype(np.int64)

    def tables(self) -> np.ndarray:
        return np.bincount(self.item, minlength=self.n)

    def remove(self, items: np.ndarray) -> None:
        """One customer, drawn evenly, leaves each of the distinct items."""
        upto = np.cumsum(self.size)
        first = np.searchsorted(self.item, items)
        own = self.customers()[items]
        drawn = upto[first] - self.size[first] + np.minimum((self.rng.random(len(items)) * own).astype(np.int64), own - 1)
        at = np.searchsorted(upto, drawn, side="right")
        self.size[at] -= 1
        stay = self.size > 0
        self.item, self.size = self.item[stay], self.size[stay]

    def add(self, items: np.ndarray, weight: np.ndarray) -> None:
        """One customer joins each of the distinct items; ``weight`` is that of a new table."""
        own, tables = self.customers()[items], self.tables()[items]
        old = np.maximum(own - self.discount * tables, 0)
        new = (tables == 0) | (self.rng.random(len(items)) * (old + weight) >= old)
        joined = items[~new]
        if len(joined):
            upto = np.cumsum(self.size - self.discount)
            first = np.searchsorted(self.item, joined)
            low = upto[first] - (self.size[first] - self.discount)
            drawn = low + self.rng.random(len(joined)) * old[~new] * (1 - 1e-9)
            at = np.clip(np.searchsorted(upto, drawn, side="right"), first, first + tables[~new] - 1)
            self.size[at] += 1
        if new.any():
            where = np.searchsorted(self.item, items[new], side="right")
            self.item, self.size = np.insert(self.item, where, items[new]), np.insert(self.size, where, 1)

    def move(self, weight: np.ndarray) -> None:
        """A sweep: each customer of a dish leaves and joins anew; those of a dish of many do so together.

        Dishes go by powers of two of their customers, so that the arrays hold only those which still move.
        """
        own = self.customers()
        level = np.where(own > MOVED, 99, np.ceil(np.log2(np.maximum(own, 1))).astype(int))
        kept = [(self.item[at], self.size[at]) for at in [level[self.item] == 0]]
        for k in np.unique(level[level > 0]).tolist():
            dishes = np.flatnonzero(level == k)
            if k == 99:
                kept.append(self._seated(dishes, own[dishes], weight[dishes]))
                continue
            place = np.full(self.n, -1)
            place[dishes] = np.arange(len(dishes))
            mine = place[self.item] >= 0
            some = Seating(place[self.item[mine]], self.size[mine], len(dishes), self.discount, self.rng)
            for i in range(1 << k):
                still = np.flatnonzero(own[dishes] > i)
                some.remove(still)
                some.add(still, weight[dishes][still])
            kept.append((dishes[some.item], some.size))
        item = np.concatenate([i for i, _ in kept])
        order = np.argsort(item, kind="stable")
        self.item, self.size = item[order], np.concatenate([s for _, s in kept])[order]

    def _seated(self, dishes: np.ndarray, customers: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables of dishes by their customers alone: a large one each, and others of one customer."""
        tables = drawn(customers, weight, self.discount, self.rng)
        first = np.cumsum(tables) - tables
        size = np.ones(int(tables.sum()), np.int64)
        size[first] = customers - tables + 1
        return np.repeat(dishes, tables), size

    def fit(self, wanted: np.ndarray, weight: np.ndarray) -> None:
        """Add or remove customers until the items have as many as wanted; those that have or want many begin anew."""
        many = (self.customers() > MOVED) | (wanted > MOVED)
        stay = ~many[self.item]
        new = np.flatnonzero(many & (wanted > 0))
        item, size = self._seated(new, wanted[new], weight[new])
        item, size = np.concatenate([self.item[stay], item]), np.concatenate([self.size[stay], size])
        order = np.argsort(item, kind="stable")
        self.item, self.size = item[order], size[order]
        while True:
            differ = wanted - self.customers()
            more, less = np.flatnonzero(differ > 0), np.flatnonzero(differ < 0)
            if not len(more) and not len(less):
                return
            if len(less):
                self.remove(less)
            if len(more):
                self.add(more, weight[more])


@dataclass
class Totals:
    """What all parts share: customers and tables of the context restaurants, and of the parent."""

    train_tokens: int
    vocabulary: int
    customers: np.ndarray
    tables: np.ndarray
    leaf_tables: int
    root_tables: int
    discount: float
    root_discount: float

    def root(self, customers: np.ndarray, tables: np.ndarray) -> np.ndarray:
        """The parent's predictive probability of words."""
        base = 1 / (self.vocabulary + 1)
        return (customers - self.root_discount * tables + (STRENGTH + self.root_discount * self.root_tables) * base) / (STRENGTH + self.leaf_tables)

    def passing(self) -> np.ndarray:
        """For each context, the probability that a customer goes on to the parent."""
        return (STRENGTH + self.discount * self.tables) / (STRENGTH + self.customers)

    def leaf(self, count: np.ndarray, tables: np.ndarray, context: np.ndarray, root: np.ndarray) -> np.ndarray:
        return (count - self.discount * tables) / (STRENGTH + self.customers[context]) + self.passing()[context] * root


#: A part: the numbers of its words' pairs; the pairs' contexts and counts; numbers and sizes of its tables at both levels;
#: sums of the pairs' and each sample's parent probabilities; its contexts, if whole, and each sample's for passing on.
STATE = "part int, words long, word binary, context binary, count binary, item binary, size binary, root_item binary, root_size binary, pair_sum binary, roots binary, contexts binary, passing binary, leaf_tables long, tables array<long>, customers array<long>, root_tables long, train_tokens long, vocabulary long, once long, twice long, root_once long, root_twice long"
_STATE = pa.schema([(n.split()[0], {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}[n.split()[1]]) for n in STATE.split(", ")])


def _by_context(context: np.ndarray, n: np.ndarray) -> list[int]:
    return np.bincount(context, n, CONTEXTS).astype(np.int64).tolist()


def _row(part: int, words: int, word: np.ndarray, context: np.ndarray, count: np.ndarray, leaves: Seating, root: Seating, pair_sum: np.ndarray, roots: np.ndarray, contexts: bytes, passing: np.ndarray) -> pa.Table:
    per_word = np.bincount(word, count, words)
    parent = root.customers()
    row = {
        "part": part, "words": words, "word": np.bincount(word, minlength=words).astype("<u4").tobytes(), "context": context.astype("<u4").tobytes(), "count": count.astype("<u4").tobytes(),
        "contexts": contexts, "passing": passing.astype("<f4").tobytes(), "leaf_tables": len(leaves.item),
        "item": leaves.tables().astype("<u4").tobytes(), "size": leaves.size.astype("<u4").tobytes(), "root_item": root.tables().astype("<u4").tobytes(), "root_size": root.size.astype("<u4").tobytes(),
        "pair_sum": pair_sum.astype("<f4").tobytes(), "roots": roots.astype("<f4").tobytes(), "tables": [] if contexts else _by_context(context, leaves.tables()), "customers": [] if contexts else _by_context(context, count),
        "root_tables": len(root.item), "train_tokens": int(count.sum()), "vocabulary": int((per_word > 0).sum()),
        "once": int((count == 1).sum()), "twice": int((count == 2).sum()), "root_once": int((parent == 1).sum()), "root_twice": int((parent == 2).sum()),
    }
    return pa.Table.from_pylist([row], _STATE)


def begin(table: pa.Table, whole: bool) -> pa.Table:
    """A part's first seating, with an even parent and a discount of a half."""
    part = table.column("part")[0].as_py()
    blocks, words, contexts = gather(table, whole)
    key = np.concatenate([k for _, _, k, _ in blocks])
    n = np.concatenate([c for _, _, _, c in blocks])
    key, n = key[n > 0], n[n > 0]
    pairs, at = np.unique(key, return_inverse=True)
    count = np.bincount(at, n, len(pairs)).astype(np.int64)
    word, context = pairs // len(contexts), pairs % len(contexts)
    rng = np.random.default_rng(part)
    leaves = Seating.start(count, np.full(len(pairs), 0.5), 0.5, rng)
    customers = np.bincount(word, leaves.tables(), words).astype(np.int64)
    root = Seating.start(customers, np.full(words, 0.5), 0.5, rng)
    return _row(part, words, word, context, count, leaves, root, np.zeros(len(pairs)), np.zeros(0), contexts.tobytes() if whole else b"", np.zeros(0))


def sweep(row: dict, totals: Totals, number: int, move: bool) -> pa.Table:
    """Add the state to the samples, if it counts, and move customers of every pair and word."""
    rng = np.random.default_rng([row["part"], number])
    word, context, count = _places(row["word"]), _numbers(row["context"], "<u4"), _numbers(row["count"], "<u4")
    leaves = Seating(_places(row["item"]), _numbers(row["size"], "<u4"), len(word), totals.discount, rng)
    root = Seating(_places(row["root_item"]), _numbers(row["root_size"], "<u4"), row["words"], totals.root_discount, rng)
    parent = totals.root(root.customers(), root.tables())
    pair_sum, roots = np.frombuffer(row["pair_sum"], "<f4").astype(float), np.frombuffer(row["roots"], "<f4")
    passing = np.frombuffer(row["passing"], "<f4")
    if number > BURN_IN:
        pair_sum = pair_sum + totals.leaf(count, leaves.tables(), context, parent[word])
        roots, passing = np.concatenate([roots, parent]), np.concatenate([passing, totals.passing()])
    if move:
        leaves.move((STRENGTH + totals.discount * totals.tables)[context] * parent[word])
        base = np.full(row["words"], (STRENGTH + totals.root_discount * totals.root_tables) / (totals.vocabulary + 1))
        root.fit(np.bincount(word, leaves.tables(), row["words"]).astype(np.int64), base)
        root.move(base)
    return _row(row["part"], row["words"], word, context, count, leaves, root, pair_sum, roots, row["contexts"], passing)


SENT = "target int, part int, contexts binary, tables binary, customers binary"
_SENT = pa.schema([("target", pa.int32()), ("part", pa.int32()), ("contexts", pa.binary()), ("tables", pa.binary()), ("customers", pa.binary())])


def _dealt(contexts: np.ndarray, targets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of contexts in the order of the targets that sum them, and where each target's begin and end there."""
    to = (contexts % np.uint64(targets)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    return order, np.searchsorted(to[order], np.arange(targets + 1))


def shares(row: dict, targets: int) -> list[dict]:
    """A part's tables and customers of its whole contexts, a row for each target that sums some of them."""
    contexts, context = np.frombuffer(row["contexts"], "<u8"), _numbers(row["context"], "<u4")
    tables = np.bincount(context, _numbers(row["item"], "<u4"), len(contexts))
    customers = np.bincount(context, _numbers(row["count"], "<u4"), len(contexts))
    order, edges = _dealt(contexts, targets)
    own = [(p, order[a:b]) for p, (a, b) in enumerate(pairwise(edges.tolist())) if b > a]
    return [{"target": p, "part": row["part"], "contexts": contexts[at].tobytes(), "tables": tables[at].astype("<u8").tobytes(), "customers": customers[at].astype("<u8").tobytes()} for p, at in own]


def summed(table: pa.Table) -> pa.Table:
    """The contexts of one target: to each part, in its order, what all parts have."""
    rows = table.to_pylist()
    given = [np.frombuffer(r["contexts"], "<u8") for r in rows]
    contexts, at = np.unique(np.concatenate(given), return_inverse=True)
    edges = np.cumsum([len(g) for g in given])[:-1]
    sums = [np.bincount(at, np.concatenate([_numbers(r[c], "<u8") for r in rows]), len(contexts)).astype("<u8")[at] for c in ("tables", "customers")]
    both = zip(rows, *[np.split(x, edges) for x in sums], strict=True)
    return pa.Table.from_pylist([{"target": r["target"], "part": r["part"], "contexts": None, "tables": t.tobytes(), "customers": n.tobytes()} for r, t, n in both], _SENT)


def with_shares(totals: Totals, row: dict, replies: list[dict], targets: int) -> Totals:
    """The totals with tables and customers of the part's own contexts."""
    order, edges = _dealt(np.frombuffer(row["contexts"], "<u8"), targets)
    tables, customers = np.zeros(len(order)), np.zeros(len(order))
    for r in replies:
        at = order[edges[r["target"]] : edges[r["target"] + 1]]
        tables[at], customers[at] = _numbers(r["tables"], "<u8"), _numbers(r["customers"], "<u8")
    return replace(totals, tables=tables, customers=customers)


def _totals(state: DataFrame) -> Totals:
    names = ["leaf_tables", "root_tables", "train_tokens", "vocabulary", "once", "twice", "root_once", "root_twice"]
    one = state.agg(*[F.coalesce(F.sum(n), F.lit(0)).alias(n) for n in names]).first()
    each = state.select(F.posexplode(F.arrays_zip("tables", "customers")).alias("c", "x")).groupBy("c").agg(F.sum("x.tables").alias("t"), F.sum("x.customers").alias("n")).collect()
    tables, customers = np.zeros(CONTEXTS), np.zeros(CONTEXTS)
    for r in each:
        tables[r.c], customers[r.c] = r.t, r.n
    share = lambda a, b: min(0.95, max(0.1, a / (a + 2 * b) if a else 0.1))
    return Totals(one.train_tokens, one.vocabulary, customers, tables, one.leaf_tables, one.root_tables, share(one.once, one.twice), share(one.root_once, one.root_twice))


def answers(raw: pa.Table, state: pa.Table, whole: bool) -> Iterator[dict]:
    """For each block, its words' counts and its pairs' averaged log10 probabilities, in the block's order."""
    blocks, words, contexts = gather(raw, whole)
    row = state.to_pylist()[0]
    passing = np.frombuffer(row["passing"], "<f4").astype(float).reshape(SAMPLES, len(contexts))
    word, count = _places(row["word"]), _numbers(row["count"], "<u4")
    known = word * len(contexts) + _numbers(row["context"], "<u4")
    pair_mean = np.frombuffer(row["pair_sum"], "<f4").astype(float) / SAMPLES
    roots = np.frombuffer(row["roots"], "<f4").astype(float).reshape(SAMPLES, words)
    per_word = np.bincount(word, count, words).astype(np.int64)
    for block, ids, key, _ in blocks:
        p = (passing[:, key % len(contexts)] * roots[:, key // len(contexts)]).mean(axis=0)
        if len(known):
            at = np.minimum(np.searchsorted(known, key), len(known) - 1)
            p = np.where(known[at] == key, pair_mean[at], p)
        yield {"block": block, "part": row["part"], "known": per_word[ids].astype("<u8").tobytes(), "pairs": np.diff(np.r_[np.flatnonzero(np.r_[True, np.diff(key // len(contexts)) != 0]), len(key)]).astype("<u4").tobytes(), "score": np.log10(p).astype("<f4").tobytes()}


ANSWER = "block long, part int, known binary, pairs binary, score binary"
_ANSWER = pa.schema([("block", pa.int64()), ("part", pa.int32()), ("known", pa.binary()), ("pairs", pa.binary()), ("score", pa.binary())])
OUT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_OUT = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])


def score_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = False) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)`` for every row.

    The model learns from the rows whose crc32 of the id, as text, is not divisible by ten.  ``score`` is
    the log10 probability of the whole text under predictive probabilities averaged over the samples.  A null
    text counts as empty and has the end alone; a null id counts as an empty text and is held out; repeated
    rows are documents of their own.  An empty table gives an empty one.  ``whole``: a word's context is the word
    before it, whatever its length, in place of the last short one.
    """
    size = docs.agg(F.sum(F.octet_length(F.col(text_col).cast("string")))).first()[0] or 0
    parts = max(1, -(-size // (WHOLE_PART if whole else PART)))
    raw = materialise(read_blocks(docs, parts, id_col, text_col, whole), "blocks")
    sent = raw.where("part >= 0").select("block", "part", "words", "pairs", "context", "count")
    state = materialise(sent.groupBy("part").applyInArrow(lambda t: begin(t, whole), STATE), "seating")
    totals, targets = _totals(state), -(-parts // TOGETHER)

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist(shares(row, targets), _SENT)

    def swept(t: Totals, k: int) -> Callable[[pa.Table, pa.Table], pa.Table]:
        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            row = left.to_pylist()[0]
            return sweep(row, with_shares(t, row, right.to_pylist(), targets), k, k < BURN_IN + SAMPLES)

        return run

    for number in range(1, BURN_IN + SAMPLES + 1):

        def run(batches: Iterator[pa.RecordBatch], t: Totals = totals, k: int = number) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    yield from sweep(row, t, k, k < BURN_IN + SAMPLES).to_batches()

        if whole:
            sent_back = state.select("part", "context", "count", "item", "contexts").mapInArrow(share, SENT).groupBy("target").applyInArrow(summed, SENT)
            new = state.groupBy("part").cogroup(sent_back.groupBy("part")).applyInArrow(swept(totals, number), STATE)
        else:
            new = state.mapInArrow(run, STATE)
        new = materialise(new, "seating")
        discard(state)
        state = new
        totals = _totals(state) if number < BURN_IN + SAMPLES else totals
    n, v = totals.train_tokens, totals.vocabulary

    def answer(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.Table.from_pylist(list(answers(left, right, whole)) if left.num_rows and right.num_rows else [], _ANSWER)

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        parts = sorted(right.to_pylist(), key=lambda r: r["part"])
        known = np.concatenate([_numbers(r["known"], "<u8") for r in parts])
        pairs = np.concatenate([_numbers(r["pairs"], "<u4") for r in parts])
        scores = np.concatenate([np.frombuffer(r["score"], "<f4").astype(float) for r in parts])
        base = np.log10((np.repeat(known, pairs) + 0.1) / (n + 0.1 * (v + 1)))
        seen = np.repeat(known > 0, pairs)
        for row in left.to_pylist():
            token = _numbers(row["tokens"], "<u4")
            lengths = np.array(row["lengths"])
            doc = np.repeat(np.arange(len(lengths)), lengths)
            sums = [np.bincount(doc, x[token], len(lengths)) for x in (seen, base, scores)]
            out += [{"doc_id": i, "held_out": held_out(i), "n_tokens": int(m), "n_known": int(k), "train_tokens": n, "base_score": float(b), "score": float(s)} for i, m, k, b, s in zip(row["docs"], lengths, *sums, strict=True)]
        return pa.Table.from_pylist(out, _OUT)

    replies = sent.groupBy("part").cogroup(state.select("part", "word", "context", "count", "pair_sum", "roots", "passing").groupBy("part")).applyInArrow(answer, ANSWER)
    own = raw.where("part = -1").select("block", "docs", "lengths", "tokens")
    scored = own.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(finish, OUT)
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))


