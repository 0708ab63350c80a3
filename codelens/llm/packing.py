"""Lexical retrieval packing: seeds and their BM25 neighbours fill windows of tokens."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

WINDOW = 2048
END = 1
#: Tokens of a shard of the index, which is built, used and dropped in one go.
SHARD_TOKENS = 1 << 20
#: Tokens that a task gets about.
TASK_TOKENS = 1 << 23
#: BM25's constants, and the weightiest terms of a seed that its first query holds.
K1, B, QUERY_TERMS = 1.2, 0.75, 32
#: Entries of each of two generations of the cache from parts of words to ids.
CACHE = 300_000
#: Bytes of text that are encoded at a time.
SLICE = 8 << 20

#: Words whose parts the tokenizer's pattern finds whatever stands around them.
_PLAIN = "^[!-~À-ÖØ-öø-ÿ]+$"


def _byte_letters() -> dict[int, str]:
    """Letters that byte-level vocabularies write bytes as: visible ones as they are, others from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _for_plain(pattern: str) -> re.Pattern:
    """The pattern with blanks as parts of their own, for plain words in lower case."""
    for name, few in ((r"\p{L}", "a-zß-öø-ÿ"), (r"\p{N}", "0-9")):
        pattern = pattern.replace(name, few)
    return (regex if r"\p" in pattern else re).compile(f"{pattern}| ")


def _strings(words: pa.Array, between: str) -> str:
    """The strings as one, which is faster than a Python object each."""
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), between)[0].as_py()


def _pick(flat: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Stretches of ``flat``, those numbered by ``which``, one after the other."""
    n = length[which]
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat((start[which] - (ends - n)).astype(np.int32), n) + np.arange(total, dtype=np.int32)]


def _starts(length: np.ndarray) -> np.ndarray:
    return np.cumsum(length) - length


class Encoder:
    """Ids of texts by a tokenizer file, a distinct word at a time where its rules allow that.

    A tokenizer that lower-cases, drops white space and splits by a pattern gives the same ids for a text as
    for its words, so each distinct word of a slice of texts is encoded once, from parts that are cached.
    Words with unusual characters, and other tokenizers, go to it whole.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            rules = json.load(f)
        steps = (rules.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        split = steps[0].get("type") == "Split" and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
        lower = "Lowercase" in json.dumps(rules.get("normalizer"))
        by_words = split and lower and not rules.get("post_processor")
        self.pattern = _for_plain(steps[0]["pattern"]["Regex"]) if by_words else None
        last = steps[-1]
        direct = by_words and len(steps) == 2 and last.get("type") == "ByteLevel" and not last.get("add_prefix_space") and not last.get("use_regex")
        self.letters = _byte_letters() if direct else None
        self.kind = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.size = self.tokenizer.get_vocab_size()
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()

    def part(self, part: str) -> bytes:
        """Ids of a part of a word; parts that were not asked for lately are forgotten."""
        ids = self.new.get(part)
        if ids is None:
            ids = self.old.get(part)
            if ids is None:
                if part == " ":
                    ids = b""
                elif self.letters is None:
                    ids = self.whole(part)
                else:
                    spelled = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
                    ids = np.array([t.id for t in self.tokenizer.model.tokenize(spelled)], self.kind).tobytes()
            if len(self.new) >= CACHE:
                self.old, self.new = self.new, {}
            self.new[part] = ids
        return ids

    def _joined(self, found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer(b"".join(found), self.kind), np.fromiter(map(len, found), np.int64, len(found)) // self.kind.itemsize

    def words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all the words, and where those of each start and how many they are."""
        plain = pc.and_not(pc.match_substring_regex(words, _PLAIN), pc.match_substring(words, "<|")).to_numpy(zero_copy_only=False)
        found = self.pattern.findall(_strings(pc.filter(words, pa.array(plain)), " ").lower())
        parts = pa.array(found, pa.string()).dictionary_encode()
        distinct, which = parts.dictionary, parts.indices.to_numpy()
        blank = pc.index(distinct, " ").as_py()
        flat, length = self._joined([self.part(p) for p in _strings(distinct, "\n").split("\n") if len(distinct)])
        of_word = np.bincount(np.cumsum(which == blank), length[which], plain.sum()).astype(np.int64)
        ids = _pick(flat, _starts(length), length, which)
        odd, odd_length = self._joined([self.whole(w) for w in pc.filter(words, pa.array(~plain)).to_pylist()])
        n = np.zeros(len(words), np.int64)
        n[plain], n[~plain] = of_word, odd_length
        start = np.zeros(len(words), np.int64)
        start[plain], start[~plain] = _starts(of_word), len(ids) + _starts(odd_length)
        return np.concatenate([ids, odd]), start, n

    def encode(self, texts: pa.Array, end: int = END) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all the texts, each followed by the end's, and how many each text has."""
        texts = texts.fill_null("")
        if self.pattern is None:
            last = np.array([end], self.kind).tobytes()
            return self._joined([self.whole(t) + last for t in texts.to_pylist()])
        split = pc.ascii_split_whitespace(texts)
        places = split.flatten().dictionary_encode()
        flat, start, n = self.words(places.dictionary)
        flat, start, n = np.r_[flat, np.array([end], self.kind)], np.r_[start, len(flat)], np.r_[n, 1]
        counts = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
        which = np.insert(places.indices.to_numpy(), np.cumsum(counts), len(n) - 1)
        upto = np.r_[0, np.cumsum(n[which])][np.r_[0, np.cumsum(counts + 1)]]
        return _pick(flat, start, n, which), np.diff(upto)


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder a process and file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``SLICE`` bytes of text, or a row."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + SLICE, side="right")))
        yield a, b
        a = b


def binary_column(flat: np.ndarray, n: np.ndarray) -> pa.Array:
    offsets = (np.r_[0, np.cumsum(n)] * flat.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])


def _numbers(column: pa.Array, kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """All ids of a binary column, and how many each row has."""
    n = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // kind.itemsize
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].view(kind) if data is not None else np.empty(0, kind)), n


class Terms:
    """The distinct (document, term) pairs of some documents, in that order, with counts."""

    def __init__(self, ids: np.ndarray, n: np.ndarray) -> None:
        doc = np.repeat(np.arange(len(n), dtype=np.uint64), n)
        wide = len(n) > 1 << 16 or ids.dtype.itemsize > 2
        key = (doc << np.uint64(32)) | ids if wide else (doc.astype(np.uint32) << np.uint32(16)) | ids
        key = np.sort(key)
        at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
        self.tf = np.diff(np.r_[at, len(key)])
        key = key[at].astype(np.uint64)
        bits = np.uint64(32 if wide else 16)
        self.doc, self.term = (key >> bits).astype(np.int64), (key & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


class Statistics:
    """What BM25 knows of all documents: their number, mean length, and how many hold each term."""

    def __init__(self, documents: int, tokens: int, df: np.ndarray) -> None:
        self.documents, self.df = documents, df
        self.mean = tokens / max(1, documents)
        self.idf = np.log1p((documents - df + 0.5) / (df + 0.5))

    def weights(self, t: Terms, n: np.ndarray) -> np.ndarray:
        """The part of a score that a term of a document adds."""
        norm = K1 * (1 - B + B * n / self.mean)
        return self.idf[t.term] * t.tf * (K1 + 1) / (t.tf + norm[t.doc])


class Packer:
    """Fills windows one after the other; a document that crosses a window's end goes on in the next."""

    def __init__(self, first: int, window: int) -> None:
        self.sequence, self.window, self.room = first, window, window
        self.pieces: list[tuple] = []

    def place(self, doc: object, ids: np.ndarray) -> bool:
        """True if a window got full."""
        start, n, before = 0, len(ids), self.sequence
        while start < n:
            take = min(self.room, n - start)
            crc = zlib.crc32(ids[start : start + take].astype("<u4").tobytes())
            self.pieces.append((doc, start, take, crc, n, self.sequence, self.window - self.room))
            start += take
            self.room -= take
            if not self.room:
                self.sequence, self.room = self.sequence + 1, self.window
        return self.sequence != before


class Index:
    """BM25 postings of one shard, by token id, weighed by what is known of all documents."""

    def __init__(self, docs: list[np.ndarray], known: Statistics) -> None:
        n = np.array([len(d) for d in docs])
        t = Terms(np.concatenate(docs), n)
        weight = known.weights(t, n)
        order = np.argsort(t.term, kind="stable")
        self.doc, self.weight, term = t.doc[order], weight[order], t.term[order]
        self.first = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
        self.last = np.r_[self.first[1:], len(term)]
        slot = np.empty(len(order), np.int64)
        slot[order] = np.repeat(np.arange(len(self.first)), self.last - self.first)
        cuts = np.cumsum(np.bincount(t.doc, minlength=len(docs)))[:-1]
        self.terms_of, self.weights_of = np.split(slot, cuts), np.split(weight, cuts)
        self.n = len(docs)

    def _best(self, terms: np.ndarray, unused: np.ndarray) -> Iterator[int]:
        span = [slice(a, b) for a, b in zip(self.first[terms], self.last[terms], strict=True)]
        score = np.bincount(np.concatenate([self.doc[s] for s in span]), np.concatenate([self.weight[s] for s in span]), self.n)
        score[~unused] = 0
        some = np.flatnonzero(score)
        few = some[np.argpartition(-score[some], 16)[:16]] if len(some) > 16 else some
        few = few[np.lexsort((few, -score[few]))]
        yield from few.tolist()
        if len(some) > 16:
            rest = np.setdiff1d(some, few, assume_unique=True)
            yield from rest[np.lexsort((rest, -score[rest]))].tolist()

    def neighbours(self, seed: int, unused: np.ndarray) -> Iterator[int]:
        """The unused documents that share a term with the seed, best first.

        The first query holds the seed's weightiest terms; when nobody is left who has any, the rest follow.
        """
        terms, weights = self.terms_of[seed], self.weights_of[seed]
        shared = self.last[terms] - self.first[terms] > 1
        terms = terms[shared][np.argsort(-weights[shared], kind="stable")]
        for some in (terms[:QUERY_TERMS], terms[QUERY_TERMS:]):
            if len(some):
                yield from (i for i in self._best(some, unused) if unused[i])


def pack_shard(packer: Packer, keys: list, docs: list[np.ndarray], known: Statistics) -> None:
    """Place all documents of a shard: a seed, its unused neighbours until the window is full, and so on.

    The neighbour that crosses the window's end is the next seed; a seed without neighbours left is
    followed by the first unused document.
    """
    index = Index(docs, known)
    unused = np.ones(len(docs), bool)
    after = 0
    seed = None
    while True:
        if seed is None:
            while after < len(docs) and not unused[after]:
                after += 1
            if after == len(docs):
                return
            seed = after
            unused[seed] = False
            packer.place(keys[seed], docs[seed])
        following = None
        for i in index.neighbours(seed, unused):
            unused[i] = False
            if packer.place(keys[i], docs[i]):
                following = i
                break
        seed = following


def encode_documents(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, ids, n, salt)``: ids of the whole text and the end, as bytes, and a number of the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat, n = e.encode(batch.column(1).slice(a, b - a))
                # Rows in an order that tells nothing, so that copies spread.
                salt = np.arange(row, row + b - a, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                row += b - a
                yield pa.record_batch([batch.column(0).slice(a, b - a), binary_column(flat, n), pa.array(n), pa.array(salt.view(np.int64))], ["doc_id", "ids", "n", "salt"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, n long, salt long")


def statistics(coded: DataFrame, tokenizer: str) -> Statistics:
    """BM25's statistics over all documents; a row a term of the vocabulary reaches the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer)
        df = np.zeros(e.size, np.int64)
        for batch in batches:
            t = Terms(*_numbers(batch.column(0), e.kind))
            df += np.bincount(t.term, minlength=e.size)
        term = np.flatnonzero(df)
        yield pa.record_batch([pa.array(term), pa.array(df[term])], ["term", "df"])

    size = encoder(tokenizer).size
    rows = coded.select("ids").mapInArrow(count, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    df = np.zeros(size, np.int64)
    df[rows.column("term").to_numpy()] = rows.column("df").to_numpy()
    one = coded.agg(F.count("*").alias("n"), F.coalesce(F.sum("n"), F.lit(0)).alias("tokens")).first()
    return Statistics(one.n, one.tokens, df)


def routed(coded: DataFrame, tokenizer: str, known: Statistics) -> DataFrame:
    """``coded`` with the two weightiest terms of each document, by which it is dealt to a shard."""
    shared = coded.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, s = encoder(tokenizer), shared.value
        for batch in batches:
            ids, n = _numbers(batch.column(1), e.kind)
            t = Terms(ids, n)
            weight = np.where(s.df[t.term] > 1, s.weights(t, n), 0.0)
            order = np.lexsort((t.term, -weight, t.doc))
            first = _starts(np.bincount(t.doc, minlength=len(n)))
            one, two = t.term[order[first]], t.term[order[np.minimum(first + 1, len(order) - 1)]]
            yield pa.record_batch([*batch.columns, pa.array(one), pa.array(two)], [*batch.schema.names, "first", "second"])

    return coded.mapInArrow(run, "doc_id long, ids binary, n long, salt long, first long, second long")


def pack(docs: DataFrame, tokenizer: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in sequences of at most ``window`` tokens.

    Columns: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``.  Documents are encoded
    once; how many hold each term, and their mean length, are counted over all of them.  The index is
    sharded by the documents' weightiest terms, so that those which share them meet, with a number of the
    row behind, so that any number of copies spreads over tasks.  A task indexes a shard of about a million
    tokens at a time.  Only the last sequence of a task has padding.  A null text counts as empty, its one
    token being the end; repeated rows are documents of their own; a null id is kept; an empty table gives
    no piece.  Other columns take no part.
    """
    coded = materialise(encode_documents(docs, tokenizer, id_col, text_col), "ids")
    known = statistics(coded, tokenizer)
    tasks = max(1, -(-int(known.mean * known.documents) // TASK_TOKENS))
    placed = routed(coded, tokenizer, known)
    dealt = placed.repartitionByRange(tasks, "first", "second", "salt").sortWithinPartitions("first", "second", "salt").select("doc_id", "ids")
    shared = coded.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = encoder(tokenizer).kind
        packer = Packer(TaskContext.get().partitionId() << 40, window)
        keys: list = []
        held: list[np.ndarray] = []
        size = 0

        def flush() -> pa.RecordBatch:
            if held:
                pack_shard(packer, keys, held, shared.value)
            keys.clear()
            held.clear()
            out, packer.pieces = packer.pieces, []
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names)

        for batch in batches:
            flat, n = _numbers(batch.column(1), kind)
            for doc, ids in zip(batch.column(0).to_pylist(), np.split(flat, np.cumsum(n)[:-1]), strict=True):
                keys.append(doc)
                held.append(ids)
                size += len(ids)
                if size >= SHARD_TOKENS:
                    yield flush()
                    size = 0
        yield flush()

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    return dealt.mapInArrow(run, ", ".join(f"{n} long" for n in names))
