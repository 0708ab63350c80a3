"""Target-distribution importance resampling: documents whose hashed words are like a target's are drawn more often."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from ..sources.documents import numbered
from .packing import binary_column, slices

BUCKETS, MAX_WORDS, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Stands behind each text; no UTF-8 text holds this byte.
_BREAK = b"\xff"


def _plain_bytes() -> np.ndarray:
    """What each byte of a text becomes: letters are small, all but words' bytes are blanks."""
    out = np.full(256, 0x20, np.uint8)
    for low, high in ((0x30, 0x3A), (0x61, 0x7B), (0x80, 0x100)):
        out[low:high] = np.arange(low, high)
    out[0x41:0x5B] = np.arange(0x61, 0x7B)
    return out


_PLAIN = _plain_bytes()


def plain(texts: pa.Array) -> bytes:
    """All texts as words between single or more blanks, each text followed by a break."""
    whole = pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts.fill_null("").cast(pa.large_binary()))
    joined = pc.binary_join(whole, pa.scalar(b" " + _BREAK + b" ", pa.large_binary()))[0].as_buffer() if len(texts) else b""
    return b" " + _PLAIN[np.frombuffer(joined, np.uint8)].tobytes() + b" " + _BREAK + b" "


class Dictionary:
    """Aho-Corasick automaton of the distinct words of some texts.

    A word is a pattern with the blanks around it, so a scan meets each word of a text once, whole, whatever
    words are parts of others.  Its payload is the word's number, which gives its CRC and its length.
    """

    def __init__(self, flat: bytes) -> None:
        parts = pc.split_pattern(pa.array([flat], pa.large_binary()), b" ").flatten()
        words = [w for w in pc.unique(parts).to_pylist() if w and w != _BREAK]
        self.crc = np.array([zlib.crc32(w) for w in words], np.uint32)
        self.length = np.array([len(w) for w in words], np.int64)
        self.automaton = ahocorasick.Automaton()
        # Bytes as letters of their own, so that a text's bytes are scanned as they are.
        self.automaton.add_word(_BREAK.decode("latin-1"), -1)
        for i, w in enumerate(words):
            self.automaton.add_word(f" {w.decode('latin-1')} ", i)
        self.automaton.make_automaton()

    def scan(self, flat: bytes) -> np.ndarray:
        """The payloads in the order of the text, -1 where a text ends."""
        return np.fromiter(map(itemgetter(1), self.automaton.iter(flat.decode("latin-1"))), np.int64)


class Shift:
    """What appending zero bytes does to a CRC-32: a linear map over its bits, for each number of bytes."""

    def __init__(self) -> None:
        bits = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
        one = bits.copy()
        for _ in range(8):
            one = np.where(one & 1, (one >> np.uint32(1)) ^ np.uint32(0xEDB88320), one >> np.uint32(1)).astype(np.uint32)
        #: Maps of 1, 2, 4, ... bytes, as the images of single bits.
        self.powers = [one]
        self.tables: dict[int, np.ndarray] = {}

    @staticmethod
    def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The map ``a`` applied to each number of ``x``."""
        out = np.zeros(len(x), np.uint32)
        for k in range(32):
            out ^= np.where((x >> np.uint32(k)) & np.uint32(1), a[k], np.uint32(0))
        return out

    def _table(self, n: int) -> np.ndarray:
        """Images of the four bytes' values for ``n`` zero bytes."""
        if n not in self.tables:
            images = np.left_shift(np.uint32(1), np.arange(32, dtype=np.uint32))
            k = 0
            while n >> k:
                if k == len(self.powers):
                    self.powers.append(self._times(self.powers[-1], self.powers[-1]))
                if n >> k & 1:
                    images = self._times(self.powers[k], images)
                k += 1
            values = np.arange(256, dtype=np.uint32)
            self.tables[n] = np.stack([self._times(images, values << np.uint32(8 * b)) for b in range(4)])
        return self.tables[n]

    def __call__(self, crc: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Each CRC after so many zero bytes more."""
        out = np.empty(len(crc), np.uint32)
        for one in np.unique(n):
            at, t = n == one, self._table(int(one))
            c = crc[at]
            out[at] = t[0][c & np.uint32(255)] ^ t[1][c >> np.uint32(8) & np.uint32(255)] ^ t[2][c >> np.uint32(16) & np.uint32(255)] ^ t[3][c >> np.uint32(24)]
        return out


def features(words: Dictionary, payload: np.ndarray, max_words: int, buckets: int, shift: Shift) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all runs of 1 to ``max_words`` words, text by text, and how many features and words each text has.

    The CRC of a run comes from those of its words: one is moved on by the next one's length and a blank, and added.
    """
    ends = np.flatnonzero(payload < 0)
    n_words = np.diff(np.r_[-1, ends]) - 1
    text = np.repeat(np.arange(len(ends)), n_words)
    own = payload[payload >= 0]
    left = np.repeat(np.cumsum(n_words), n_words) - np.arange(len(own))
    crc = word = words.crc[own]
    found, of = [word % np.uint32(buckets)], [text]
    if max_words > 1:
        length = words.length[own]
        blank = np.full(len(own), zlib.crc32(b" "), np.uint32)
        spaced = shift(blank, length) ^ word
    for k in range(1, max_words):
        at = np.flatnonzero(left > k)
        crc = crc[at] if k == 1 else crc[np.isin(before, at, assume_unique=True)]
        crc = shift(crc, length[at + k] + 1) ^ spaced[at + k]
        before = at
        found.append(crc % np.uint32(buckets))
        of.append(text[at])
    if max_words > 1:
        of_all = np.concatenate(of)
        order = np.argsort(of_all, kind="stable")
        return np.concatenate(found)[order], np.bincount(of_all, minlength=len(ends)), n_words
    return found[0], n_words, n_words


def hashed(docs: DataFrame, max_words: int, buckets: int, id_col: str | None, text_col: str) -> DataFrame:
    """``(doc_id, row, n_words, n_features, buckets)``: the buckets of a text's features as bytes, and a number of the row.

    A task takes its texts some megabytes at a time: their distinct words make an automaton, which scans them
    and is dropped, so memory does not follow the corpus's vocabulary.
    """
    kind = np.dtype("<u2" if buckets <= 1 << 16 else "<u4")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row, shift = TaskContext.get().partitionId() << 40, Shift()
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat = plain(batch.column(1).slice(a, b - a))
                words = Dictionary(flat)
                found, n, n_words = features(words, words.scan(flat), max_words, buckets, shift)
                rows = pa.array(np.arange(row, row + b - a, dtype=np.int64))
                row += b - a
                yield pa.record_batch([batch.column(0).slice(a, b - a), rows, pa.array(n_words), pa.array(n), binary_column(found.astype(kind), n)], ["doc_id", "row", "n_words", "n_features", "buckets"])

    key = F.col(id_col).cast("long") if id_col else F.lit(None).cast("long")
    given = docs.select(key.alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return given.mapInArrow(run, "doc_id long, row long, n_words long, n_features long, buckets binary")


def counts(coded: DataFrame, buckets: int) -> np.ndarray:
    """How many features of all texts each bucket holds; a row a bucket reaches the driver."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for batch in batches:
            for held in batch.column(0):
                n += np.bincount(np.frombuffer(held.as_py(), kind), minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.record_batch([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    rows = coded.select("buckets").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """What a feature of each bucket adds to a document's weight: a thousand times the log ratio, smoothed by one."""
    n, s, t = len(source), int(source.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((b + 1) * (s + n) / ((a + 1) * (t + n)))) for a, b in zip(source.tolist(), target.tolist(), strict=True)], np.int64)


def weighed(coded: DataFrame, gain: np.ndarray) -> DataFrame:
    """``coded`` with the sum of its features' gains in place of their buckets."""
    shared = coded.sparkSession.sparkContext.broadcast(gain)
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(shared.value[np.frombuffer(held.as_py(), kind)].sum()) for held in batch.column(4)]
            yield pa.record_batch([*batch.columns[:4], pa.array(sums, pa.int64())], [*batch.schema.names[:4], "weight"])

    return coded.mapInArrow(run, "doc_id long, row long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int) -> Column:
    """Gumbel noise in thousandths, fixed by seed and id; a null id counts as the word ``null``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    unit = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    return F.floor(-1000 * F.log(-F.log(unit))).cast("long")


def resample(docs: DataFrame, target: DataFrame, max_words: int = MAX_WORDS, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ``doc_id, n_features, weight, score`` and, if it is drawn, its ``rank`` from 1.

    Of the documents with at least ``min_words`` words, ``percent`` in a hundred (rounded down) with the
    highest scores are drawn, which is a draw without replacement by weights.  Equal scores go by id, and
    rows that repeat an id by their place in the table, each being a document of its own; a null id comes
    first.  Texts are scanned once: buckets are written, counted and weighed from there.  Ranks come from a
    sort by ranges and the sizes of the ranges before, so no task has all rows.  A null text has no words;
    an empty target or table is smoothed as any other; other columns take no part.
    """
    coded = materialise(hashed(docs, max_words, buckets, id_col, text_col), "buckets")
    gain = gains(counts(coded, buckets), counts(hashed(target, max_words, buckets, None, text_col), buckets))
    may = F.col("n_words") >= min_words
    n = coded.agg(F.count_if(may)).first()[0]
    scored = weighed(coded, gain).select("doc_id", "row", "n_features", "weight", (F.col("weight") + noise(F.col("doc_id"), seed)).alias("score"), may.alias("may"))
    order = [F.desc("may"), F.desc("score"), F.asc_nulls_first("doc_id"), F.asc("row")]
    placed = numbered(scored.repartitionByRange(*order).sortWithinPartitions(*order), "place")
    drawn = F.when(F.col("place") < n * percent // 100, F.col("place") + 1)
    return placed.select("doc_id", "n_features", "weight", "score", drawn.alias("rank"))
