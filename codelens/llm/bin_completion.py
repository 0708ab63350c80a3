"""Best-fit packing by bin completion: a branch-and-bound search over lengths plans the sequences that hold all documents."""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from ..sources.documents import numbered
from .packing import encoder, slices

WINDOW = 2048
END = 0
#: Fillings that the search tries at most before it keeps the best plan so far.
NODES = 6000

#: A filling, its lengths from the largest, and how many sequences have it.
Plan = list[tuple[tuple[int, ...], int]]


def size(plan: Plan) -> int:
    return sum(n for _, n in plan)


def best_fit(counts: np.ndarray, window: int) -> Plan:
    """Best-fit decreasing: the largest pieces first, each into the fullest sequence that has room.

    Pieces of a length, and sequences alike, are placed together.
    """
    open_by: dict[int, list[tuple[tuple[int, ...], int]]] = {window: []}
    for length in range(window, 0, -1):
        n = int(counts[length])
        while n:
            room = next((r for r in range(length, window) if open_by.get(r)), window)
            held, m = open_by[room].pop() if room < window else ((), n)
            # A sequence that takes one has even less room, so it takes the next ones too.
            each = min(room // length, n)
            m_used = min(m, n // each)
            if m > m_used and room < window:
                open_by[room].append((held, m - m_used))
            open_by.setdefault(room - each * length, []).append((held + (length,) * each, m_used))
            n -= each * m_used
    return [x for same in open_by.values() for x in same]


def least(counts: np.ndarray, window: int) -> int:
    """Sequences that any plan needs: Martello and Toth's bound, over all ways to set small pieces aside."""
    lengths = np.arange(window + 1)
    upto, tokens = np.cumsum(counts), np.cumsum(counts * lengths)
    best = -(-int(tokens[-1]) // window)
    half = window // 2
    big = int(upto[-1] - upto[half])
    for k in range(half + 1):
        # Above window - k alone; above half each in one of its own; from k to half where those have room.
        alone = int(upto[-1] - upto[window - k])
        middle = big - alone
        room = middle * window - int(tokens[window - k] - tokens[half])
        small = int(tokens[half] - (tokens[k - 1] if k else 0))
        best = max(best, alone + middle + max(0, -(-(small - room) // window)))
    return best


class Pieces:
    """How many pieces there are of each length."""

    def __init__(self, counts: np.ndarray) -> None:
        self.n = counts.astype(np.int64)
        self.there = self.n > 0

    def take(self, filling: tuple[int, ...], times: int) -> None:
        for x, k in Counter(filling).items():
            self.n[x] -= k * times
            self.there[x] = self.n[x] > 0

    def largest(self, upto: int) -> int:
        """The largest length up to that; 0 if there is none."""
        some = np.flatnonzero(self.there[: upto + 1])
        return int(some[-1]) if len(some) else 0

    def spare(self) -> np.ndarray:
        """For each length, how much longer the next one is of which any filling leaves some."""
        lengths = np.where(self.n > 3, np.arange(len(self.n)), 1 << 30)
        following = np.minimum.accumulate(lengths[::-1])[::-1]
        return np.r_[following[1:], 1 << 30] - np.arange(len(self.n))

    def pairs(self, total: int, most: int, there: np.ndarray) -> Iterator[tuple[int, int]]:
        """Two lengths of that sum that are ``there``, the larger first and at most ``most``, from the most uneven."""
        low, high = -(-total // 2), min(total - 1, most)
        if high < low:
            return
        both = there[low : high + 1] & there[total - high : total - low + 1][::-1]
        for x in (np.flatnonzero(both)[::-1] + low).tolist():
            if 2 * x > total or self.n[x] > 1:
                yield x, total - x

    def sums(self) -> np.ndarray:
        """Whether a number is the sum of two lengths."""
        out = np.zeros(2 * len(self.n), bool)
        some = np.flatnonzero(self.there)
        for x in some.tolist():
            out[x + some] = True
        return out

    def triples(self, total: int, sums: np.ndarray, there: np.ndarray) -> Iterator[tuple[int, int, int]]:
        some = np.flatnonzero(there[: max(0, total - 1)])[::-1]
        for x in some[sums[total - some]].tolist():
            if 3 * x < total:
                break
            for y, z in self.pairs(total - x, x, there):
                if y < x or self.n[x] >= 2 + (z == x):
                    yield x, y, z

    def dominated(self, filling: tuple[int, ...], waste: int) -> bool:
        """Whether another piece could stand for some of the filling's, as it is no shorter and fits the waste."""
        sums = {(0, 0)}
        for x in filling:
            sums |= {(s + x, k + 1) for s, k in sums}
        near = {s + (k == 1) + i for s, k in sums if k for i in np.flatnonzero(self.there[s + (k == 1) : s + waste + 1]).tolist()}
        return any(self.n[z] > filling.count(z) for z in near)


def fillings(pieces: Pieces, room: int, slack: int) -> Iterator[tuple[int, ...]]:
    """Undominated ways to fill ``room``, those that waste least first, none that wastes over ``slack``.

    One piece that fills the room dominates all else.  Otherwise two or three pieces are sought, by their
    sum; where more are needed, the largest go in first.
    """
    first: tuple[int, ...] = ()
    gone = Pieces(pieces.n)
    while (x := gone.largest(room)) and 3 * x < room:
        first += (x,)
        gone.take((x,), 1)
        room -= x
    single, sums, spare = gone.largest(room), None, gone.spare()
    for waste in range(min(slack, room - single) + 1):
        total = room - waste
        if total == single:
            yield first + ((single,) if single else ())
            return
        there = gone.there & (spare > waste)
        for pair in gone.pairs(total, total, there):
            if not gone.dominated(pair, waste):
                yield first + pair
        if total >= 3:
            sums = gone.sums() if sums is None else sums
            for triple in gone.triples(total, sums, there):
                if not gone.dominated(triple, waste):
                    yield first + triple


def plan(counts: np.ndarray, window: int = WINDOW, nodes: int = NODES) -> Plan:
    """Fillings, and how often each occurs, that hold ``counts[n]`` pieces of each length ``n`` in few sequences.

    Depth first: the largest piece left gets each undominated filling in turn, as often as there are pieces
    for it.  The best plan so far, at first that of best fit, bounds the waste that a branch may add up to;
    the search ends where a plan has as few sequences as any can, or after ``nodes`` fillings.  Its work follows the
    number of distinct lengths, not of pieces.
    """
    best, floor_ = best_fit(counts, window), least(counts, window)
    total = int((counts * np.arange(window + 1)).sum())
    most, pieces, path, waste = size(best), Pieces(counts), [], 0
    stack: list[tuple[int, Iterator[tuple[int, ...]]]] = []

    def slack() -> int:
        """Waste that a plan with a sequence less than the best may still add."""
        return (most - 1) * window - total - waste

    def branch() -> None:
        largest = pieces.largest(window)
        pieces.take((largest,), 1)
        options = fillings(Pieces(pieces.n), window - largest, slack())
        pieces.take((largest,), -1)
        stack.append((largest, options))

    if most > floor_:
        branch()
    while stack and nodes:
        largest, options = stack[-1]
        if len(path) == len(stack):
            filling, times = path.pop()
            pieces.take(filling, -times)
            waste -= times * (window - sum(filling))
        rest = next(options, None)
        nodes -= 1
        if rest is None:
            stack.pop()
            continue
        filling = (largest, *rest)
        wasted = window - sum(filling)
        times = min(int(pieces.n[x]) // k for x, k in Counter(filling).items())
        times = min(times, slack() // wasted) if wasted else times
        if times < 1:
            stack.pop()
            continue
        path.append((filling, times))
        pieces.take(filling, times)
        waste += times * wasted
        if not pieces.there.any():
            best, most = list(path), size(path)
            if most <= floor_:
                break
        else:
            branch()
    return best


def cut_documents(docs: DataFrame, tokenizer: str, window: int, end: int, id_col: str, text_col: str) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, row)``: whole documents with their end, longer ones cut in pieces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e, row = encoder(tokenizer), TaskContext.get().partitionId() << 40
        for batch in batches:
            for a, b in slices(batch.column(1)):
                flat, n = e.encode(batch.column(1).slice(a, b - a), end)
                ids = memoryview(flat.astype("<u4").tobytes())
                pieces = -(-n // window)
                of = np.repeat(np.arange(len(n)), pieces)
                piece = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = piece * window
                length = np.minimum(n[of] - start, window)
                at = 4 * ((np.cumsum(n) - n)[of] + start)
                crc = [zlib.crc32(ids[i:j]) for i, j in zip(at.tolist(), (at + 4 * length).tolist(), strict=True)]
                rows = np.arange(row, row + len(of))
                row += len(of)
                yield pa.record_batch([batch.column(0).slice(a, b - a).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(rows)], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, row long")


def slots(planned: Plan) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places for pieces that are numbered from the longest: where a stretch of numbers begins, its first sequence, its offset.

    Pieces of a stretch go to sequences one after the other.
    """
    found, base = [], 0
    for filling, times in planned:
        for length, offset in zip(filling, accumulate(filling, initial=0), strict=False):
            found.append((-length, base, offset, times))
        base += times
    found.sort()
    table = np.array(found, np.int64).reshape(-1, 4)
    return np.cumsum(table[:, 3]) - table[:, 3], table[:, 1], table[:, 2]


def pack_best_fit(docs: DataFrame, tokenizer: str, window: int = WINDOW, end: int = END, nodes: int = NODES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents in as few sequences of at most ``window`` tokens as a search finds.

    Columns: ``doc_id, piece, start, length, ids_crc32, sequence_id, offset``.  Which sequence holds what
    depends on lengths alone, so the driver plans with the number of pieces of each of the ``window`` lengths,
    and pieces, numbered by length over all tasks, take the plan's places; pieces of one length spread over
    tasks by a number of the row.  A null text counts as empty, its one token being the end; repeated rows are documents
    of their own; a null id is kept; an empty table gives no piece.  Other columns take no part.
    """
    order = [F.desc("length"), F.asc("row")]
    # Written first, since dealing by ranges looks at its rows twice.
    cut = materialise(cut_documents(docs, tokenizer, window, end, id_col, text_col), "pieces")
    placed = numbered(cut.repartitionByRange(*order).sortWithinPartitions(*order), "place")
    counts = np.zeros(window + 1, np.int64)
    for r in placed.groupBy("length").agg(F.count("*").alias("n")).collect():
        counts[r.length] = r.n
    shared = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, window, nodes)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, sequence, offset = shared.value
        for batch in batches:
            place = batch.column(5).to_numpy()
            at = np.searchsorted(first, place, side="right") - 1
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence[at] + place - first[at]), pa.array(offset[at])], names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    columns = placed.select("doc_id", "piece", "start", "length", "ids_crc32", "place")
    return columns.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
