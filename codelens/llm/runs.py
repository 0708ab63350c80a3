"""Periodic runs of words, found by internal pattern matching over a suffix array, and texts without their repetitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .packing import slices

MIN_LENGTH, MIN_TIMES = 6, 4
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"


def _group_starts(new: np.ndarray) -> np.ndarray:
    """For sorted rows, the place where each one's group begins; ``new`` marks a group's first."""
    return np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))


class Suffixes:
    """Suffix array of the words of some stretches, and the ranks by blocks of 1, 2, 4, ... words.

    Ranks are places in the array, so positions whose blocks are equal are one interval of it.  A block that
    crosses the end of its stretch is equal to no other, and no two stretches share a block.
    """

    def __init__(self, stretch: np.ndarray, word: np.ndarray) -> None:
        n = len(word)
        new = np.r_[True, stretch[1:] != stretch[:-1]]
        self.first = _group_starts(new)
        length = np.diff(np.r_[np.flatnonzero(new), n])
        self.end = self.first + np.repeat(length, length)
        self.array = np.lexsort((word, stretch))
        w, s = word[self.array], stretch[self.array]
        self.ranks = [self._ranked(_group_starts(np.r_[True, (w[1:] != w[:-1]) | (s[1:] != s[:-1])]))]
        while self._refine():
            pass

    def _ranked(self, starts: np.ndarray) -> np.ndarray:
        rank = np.empty(len(starts), np.int64)
        rank[self.array] = starts
        return rank

    def _refine(self) -> bool:
        """Order by blocks twice as long; only positions that equal others are moved."""
        rank, half = self.ranks[-1], 1 << (len(self.ranks) - 1)
        starts = rank[self.array]
        many = np.flatnonzero(np.bincount(starts, minlength=len(starts))[starts] > 1)
        if not len(many):
            return False
        at = self.array[many]
        on = at + half
        following = np.where(on < self.end[at], rank[np.minimum(on, len(rank) - 1)], -1 - at)
        order = np.lexsort((following, starts[many]))
        at, following, own = at[order], following[order], starts[many]
        self.array[many] = at
        new = np.r_[True, (own[1:] != own[:-1]) | (following[1:] != following[:-1])]
        starts[many] = many[_group_starts(new)]
        self.ranks.append(self._ranked(starts))
        return True

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words from ``i`` on equal those from ``j`` on; ``i < j``, in one stretch."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            inside = b + (1 << k) <= self.end[i]
            at = np.where(inside, b, 0)
            same = inside & (self.ranks[k][a] == self.ranks[k][at])
            a, b = a + (same << k), b + (same << k)
        return b - j

    def behind(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many words before ``i`` equal those before ``j``."""
        a, b = i.copy(), j.copy()
        for k in range(len(self.ranks) - 1, -1, -1):
            inside = a - (1 << k) >= self.first[i]
            at = np.where(inside, a - (1 << k), 0)
            same = inside & (self.ranks[k][at] == self.ranks[k][np.where(inside, b - (1 << k), 0)])
            a, b = a - (same << k), b - (same << k)
        return i - a


class WaveletTree:
    """Values below their number by their binary digits, for range successors."""

    def __init__(self, values: np.ndarray) -> None:
        self.bits = max(1, int(len(values)).bit_length())
        self.zeros: list[np.ndarray] = []
        for k in range(self.bits - 1, -1, -1):
            one = (values >> k & 1).astype(bool)
            self.zeros.append(np.r_[0, np.cumsum(~one)].astype(np.int32))
            values = np.concatenate([values[~one], values[one]])

    def below(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """How many of the values from place ``low`` up to ``high`` are smaller than ``bound``."""
        out = np.zeros(len(low), np.int64)
        for k, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            one = (bound >> k & 1).astype(bool)
            out += np.where(one, b - a, 0)
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out

    def smallest(self, low: np.ndarray, high: np.ndarray, nth: np.ndarray) -> np.ndarray:
        """The value with ``nth`` smaller ones from place ``low`` up to ``high``."""
        out = np.zeros(len(low), np.int64)
        for k, zeros in zip(range(self.bits - 1, -1, -1), self.zeros, strict=True):
            a, b = zeros[low], zeros[high]
            one = nth >= b - a
            nth = nth - np.where(one, b - a, 0)
            out += one.astype(np.int64) << k
            low, high = np.where(one, zeros[-1] + low - a, a), np.where(one, zeros[-1] + high - b, b)
        return out

    def successor(self, low: np.ndarray, high: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """The smallest value from ``bound`` on among those from place ``low`` up to ``high``; -1 if there is none."""
        nth = self.below(low, high, bound)
        there = nth < high - low
        out = np.full(len(low), -1, np.int64)
        out[there] = self.smallest(low[there], high[there], nth[there])
        return out


def _candidates(s: Suffixes, tree: WaveletTree, half: int, level: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and periods, from ``half`` words to under twice as many, that runs around aligned blocks may have.

    A run of a period that a block of ``half`` words fits in holds an aligned block and its copy a period on,
    which starts less than two blocks behind it.  Copies that overlap form progressions: one that begins
    with the block itself gives its difference, another one the distance by which the stretches of its
    difference end apart.
    """
    rank = s.ranks[level]
    number = np.bincount(rank, minlength=len(rank))
    x = np.flatnonzero((np.arange(len(rank)) - s.first) % half == 0)
    x = x[(x + half <= s.end[x]) & (number[rank[x]] > 2)]
    low, high = rank[x], rank[x] + number[rank[x]]
    y, places, periods = x, [], []
    while len(x):
        z = tree.successor(low, high, y + 1)
        near = (z >= 0) & (z < x + 2 * half)
        x, y, z, low, high = x[near], y[near], z[near], low[near], high[near]
        if not len(x):
            break
        places.append(x)
        periods.append(z - x)
        step = z - y
        ends = z + s.ahead(y, z)
        inside = (x + step < s.end[x]) & (y > x)
        own = x[inside]
        on = own + step[inside]
        places.append(own)
        periods.append(ends[inside] - on - s.ahead(own, on))
        y = y + step * np.maximum(1, (ends - half - y) // step)
    if not places:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    x, q = np.concatenate(places), np.concatenate(periods)
    return x, q


def stretch_runs(stretch: np.ndarray, word: np.ndarray, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and smallest period of all maximal runs within stretches, in order."""
    s = Suffixes(stretch, word)
    tree = WaveletTree(s.array)
    found = []
    for level in range(1, len(s.ranks)):
        x, q = _candidates(s, tree, 1 << level, level)
        good = (q > 0) & (x + q < s.end[x])
        x, q = np.unique(np.stack([x[good], q[good]]), axis=1)
        start = x - s.behind(x, x + q)
        length = x + q + s.ahead(x, x + q) - start
        long = (length >= min_length) & (length >= min_times * q)
        found.append(np.stack([start[long], length[long], q[long]]))
    if not found:
        return (np.empty(0, np.int64),) * 3
    start, length, q = np.unique(np.concatenate(found, axis=1), axis=1)
    # A stretch that has a period has its multiples too; the smallest comes first.
    new = np.r_[True, (start[1:] != start[:-1]) | (length[1:] != length[:-1])][: len(start)]
    start, length, q = start[new], length[new], q[new]
    order = np.lexsort((q, start))
    return start[order], length[order], q[order]


def _stretches(text: np.ndarray, word: np.ndarray, min_length: int, min_times: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that may lie in a run, and the stretch each lies in.

    Each word of a run stands in it ``min_times`` times at least.  So words that are rarer in their text,
    and then in what is left around them, end stretches.
    """
    at, stretch = np.arange(len(word)), text
    while len(at):
        key = stretch * (int(word.max()) + 1) + word[at]
        _, own, number = np.unique(key, return_inverse=True, return_counts=True)
        often = number[own] >= min_times
        before = len(at)
        at, stretch = at[often], stretch[often]
        stretch = np.cumsum(np.r_[True, (np.diff(at) != 1) | (np.diff(stretch) != 0)][: len(at)]) - 1
        enough = np.bincount(stretch, minlength=1)[stretch] >= min_length
        at, stretch = at[enough], stretch[enough]
        if len(at) > 0.9 * before:
            break
    return at, stretch


def text_runs(text: np.ndarray, word: np.ndarray, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of the words of texts that stand one after the other, by their places in all of them."""
    at, stretch = _stretches(text, word, min_length, min_times)
    if not len(at):
        return (np.empty(0, np.int64),) * 3
    start, length, period = stretch_runs(stretch, word[at], min_length, min_times)
    return at[start], length, period


def _split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words, and how many each text has."""
    lists = pc.ascii_split_whitespace(texts.fill_null(""))
    words, n = lists.flatten(), pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    there = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    kept = np.bincount(np.repeat(np.arange(len(n)), n)[there], minlength=len(n)) if len(n) else n
    return words.filter(pa.array(there)), kept


def _lists(values: pa.Array, n: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), values)


def _found(texts: pa.Array, min_length: int, min_times: int) -> tuple[pa.Array, pa.Array]:
    """Runs of each text, and its words without repetitions, joined by blanks."""
    words, n = _split(texts)
    text = np.repeat(np.arange(len(n)), n)
    code = words.dictionary_encode().indices.to_numpy().astype(np.int64)
    start, length, period = text_runs(text, code, min_length, min_times)
    of, first = text[start], np.cumsum(n) - n
    fields = [pa.array(start - first[of]), pa.array(length), pa.array(period)]
    runs = _lists(pa.StructArray.from_arrays(fields, ["start", "length", "period"]), np.bincount(of, minlength=len(n)))
    # What lies in a run behind its first period: where more such parts have begun than ended.
    edge = np.bincount(start + period, minlength=len(code) + 1) - np.bincount(start + length, minlength=len(code) + 1)
    kept = np.cumsum(edge)[: len(code)] == 0
    left = words.filter(pa.array(kept))
    return runs, pc.binary_join(_lists(left, np.bincount(text[kept], minlength=len(n))), " ")


def periodic_runs(docs: DataFrame, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's runs of words and the text without what they repeat: ``doc_id, runs, collapsed``.

    A run is a maximal stretch of words with smallest period q, at least ``min_length`` words and
    ``min_times`` periods long; ``min_times`` is 4 or more, which the search for blocks relies on.  ``runs`` has
    start, length and period, counted in words, by start and then period.  ``collapsed`` has the words that
    no run holds after its first period, joined by single blanks.  Texts stay where they are; a task takes
    some megabytes of whole texts at a time.  A null or empty text has no runs and collapses to nothing; repeated
    rows and null ids are rows of their own; an empty table gives none; other columns take no part.
    """
    if min_times < 4:
        raise ValueError("min_times must be 4 or more")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column(1)):
                runs, collapsed = _found(batch.column(1).slice(a, b - a), min_length, min_times)
                yield pa.record_batch([batch.column(0).slice(a, b - a), runs, collapsed], ["doc_id", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, runs {RUNS}, collapsed string")
