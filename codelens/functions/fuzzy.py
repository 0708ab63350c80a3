"""Fuzzy places of a quote in one text: seeds by the pigeonhole rule, then bounds on letters and on common subsequences."""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable
from difflib import SequenceMatcher
from functools import partial
from itertools import pairwise

import numpy as np


#: Letters from which quotes are sought by their thirds; of so many letters, one more is left over in the first search.
SHORT, FEW = 9, 50
#: Places of grams that are held at once.
HELD = 1 << 18
#: Letters of a window from which ``difflib`` leaves out popular ones.
POPULAR = 200
#: Letters of a quote from which the longest common subsequence takes longer than the blocks of ``difflib``.
LONG = 2000


def _plain(text: str) -> str:
    """Lower case, with one letter for both small sigmas, since a window may end where no word does."""
    return text.lower().replace("ς", "σ")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)


def _grams(codes: np.ndarray, size: int) -> np.ndarray:
    """A number for the letters from each place on; code points have 21 bits, so up to three of them fit."""
    out = codes[: max(0, len(codes) - size + 1)]
    for i in range(1, size):
        out = (out << np.uint64(21)) | codes[i : len(codes) - size + 1 + i]
    return out


class Places:
    """A text without case, its grams in order with their places, and where each letter stands."""

    def __init__(self, text: str) -> None:
        self.text, low = text, _plain(text)
        #: In lower case as its windows are; None if a window may have other letters.
        self.low = low if len(low) == len(text) and not set("Σς") & set(text) else None
        #: None where lower case has other places than the text; every window is a candidate there.
        self.codes = _codes(low) if len(low) == len(text) else None
        self._sorted: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self._upto: dict[int, np.ndarray] = {}

    def sorted(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        if size not in self._sorted:
            grams = _grams(self.codes, size)
            order = np.argsort(grams, kind="stable")
            self._sorted[size] = grams[order], order
        return self._sorted[size]

    def upto(self, code: int) -> np.ndarray:
        """How often a letter stands before each place."""
        if code not in self._upto:
            self._upto[code] = np.r_[0, np.cumsum(self.codes == code, dtype=np.int32)].astype(np.int32)
        return self._upto[code]

    def seeded(self, quote: np.ndarray, size: int, slip: int, needed: int) -> np.ndarray:
        """Windows that hold ``needed`` grams of the quote, none moved from its place by more than ``slip``.

        The most frequent grams are left out, and not counted on: at least half as many as are needed, and more
        where few may be missing.  Only what is found is counted, so a long text costs no more than a search in it;
        where grams repeat so often that this is too much to hold, it is counted by place, some of it at a time.
        """
        grams, order = self.sorted(size)
        own = _grams(quote, size)
        low, high = np.searchsorted(grams, own, "left"), np.searchsorted(grams, own, "right")
        wanted = min(needed - needed // 2, max(3, (len(own) - needed) // 2))
        place = np.argsort(high - low, kind="stable")[: len(own) - needed + wanted]
        low, n = low[place], (high - low)[place]
        ends, last_at = np.cumsum(n), len(self.codes) - len(quote)
        if ends[-1] > HELD:
            return self._counted(order, low, n, ends, place, slip, wanted, last_at)
        start = np.sort(order[np.repeat(low - (ends - n), n) + np.arange(ends[-1])] - np.repeat(place, n))
        first, last = start[: max(0, len(start) - wanted + 1)], start[wanted - 1 :]
        near = np.flatnonzero(last - first <= 2 * slip)
        begin, end = np.maximum(last[near] - slip, 0), np.minimum(first[near] + slip, last_at) + 1
        begin = np.maximum(begin, np.r_[0, end[:-1]])  # both go up, so nothing is there twice
        some = np.maximum(end - begin, 0)
        upto = np.cumsum(some)
        return np.repeat(begin - (upto - some), some) + np.arange(upto[-1] if len(upto) else 0)

    def _counted(self, order: np.ndarray, low: np.ndarray, n: np.ndarray, ends: np.ndarray, place: np.ndarray, slip: int, wanted: int, last_at: int) -> np.ndarray:
        """The same windows, from numbers of grams by where the quote would begin."""
        most = int(place.max())
        found = np.zeros(most + len(self.codes) + 1, np.int64)
        for k in range(0, int(ends[-1]), HELD):
            some = np.arange(k, min(k + HELD, int(ends[-1])))
            of = np.searchsorted(ends, some, side="right")
            start = order[low[of] + some - (ends - n)[of]] - place[of] + most
            least = int(start.min())
            counts = np.bincount(start - least)
            found[least : least + len(counts)] += counts
        upto = np.r_[0, np.cumsum(found)]
        at = np.arange(max(0, last_at + 1))
        # Of starts from at - slip to at + slip.
        inside = upto[np.minimum(at + most + slip + 1, len(found))] - upto[np.maximum(at + most - slip, 0)]
        return at[inside >= wanted]

    def letters(self, quote: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How many letters, with their numbers, the quote and each window have in common."""
        out = np.zeros(len(at), np.int64)
        for code, n in zip(*np.unique(quote, return_counts=True), strict=True):
            upto = self.upto(int(code))
            out += np.minimum(upto[at + len(quote)] - upto[at], n)
        return out

    def rare(self, letter: str, at: np.ndarray, n: int) -> np.ndarray:
        """Whether each window of n letters has the letter, and not so often that ``difflib`` leaves it out."""
        upto = self.upto(ord(letter))
        own = upto[at + n] - upto[at]
        return (own > 0) & (own <= n // 100 + 1)

    def joined(self, wanted: str, at: np.ndarray, level: int) -> np.ndarray:
        """The windows that ``difflib`` can match in ``level`` letters, as far as popular letters tell.

        In a window of so many letters, a block holds a letter that is not popular there, unless it is what both
        begin with.
        """
        n = len(wanted)
        if n < POPULAR or self.low is None or not len(at):
            return at
        held = np.zeros(len(at), bool)
        for c in set(wanted):
            held |= self.rare(c, at, n)
        start = wanted[:level]
        at = np.array([i for i, h in zip(at.tolist(), held.tolist(), strict=True) if h or self.low.startswith(start, i)], np.int64)
        return at

    def matched(self, wanted: str, i: int, least: float) -> int:
        """Letters in the blocks that ``difflib`` finds in a long window, or 0 once their share cannot reach ``least``."""
        n, window = len(wanted), self.low[i : i + len(wanted)]
        letters = {c: np.flatnonzero(self.codes[i : i + n] == ord(c)).tolist() for c in set(wanted) if self.rare(c, np.array([i]), n)[0]}
        every = sorted(j for places in letters.values() for j in places)
        if any(y - x == 1 for x, y in pairwise(every)):
            longest = SequenceMatcher(None, wanted, window).find_longest_match
        else:
            longest = partial(_first_block, wanted, window, letters)
        total, most, parts = 0, n, [(0, n, 0, n)]
        while parts and 2.0 * (total + most) / (2 * n) >= least:
            alo, ahi, blo, bhi = parts.pop()
            x, y, k = longest(alo, ahi, blo, bhi)
            most -= min(ahi - alo, bhi - blo)
            total += k
            for part in ((alo, x, blo, y), (x + k, ahi, y + k, bhi)) if k else ():
                if part[0] < part[1] and part[2] < part[3]:
                    parts.append(part)
                    most += min(part[1] - part[0], part[3] - part[2])
        return 0 if parts else total


def _first_block(a: str, b: str, letters: dict[str, list[int]], alo: int, ahi: int, blo: int, bhi: int) -> tuple[int, int, int]:
    """What ``find_longest_match`` gives where no two of the letters that are not popular stand side by side in ``b``."""
    x, y, k = alo, blo, 0
    for c, places in letters.items():
        at = bisect_left(places, blo)
        if at < len(places) and places[at] < bhi and (i := a.find(c, alo, ahi if not k else x)) >= 0:
            x, y, k = i, places[at], 1
    back = _same(a[alo:x][::-1], b[blo:y][::-1]) if k else 0
    return x - back, y - back, back + k + _same(a[x + k : ahi], b[y + k : bhi])


class _Subsequence:
    """Length of the longest subsequence that texts have in common with one, a letter a step, all of it in one number's bits."""

    def __init__(self, text: str) -> None:
        self.full = (1 << len(text)) - 1
        self.where: dict[str, int] = {}
        for i, c in enumerate(text):
            self.where[c] = self.where.get(c, 0) | 1 << i

    def __call__(self, other: str) -> int:
        free, where, full = self.full, self.where, self.full
        for c in other:
            if (m := where.get(c)) is not None:
                both = free & m
                free = ((free + both) | (free - both)) & full
        return full.bit_count() - free.bit_count()


def _all_windows(text: str, wanted: str, n: int, threshold: float) -> Iterable[tuple[float, int]]:
    letters = Counter(wanted)
    for i in range(len(text) - n + 1):
        window = text[i : i + n].lower()
        bound = 2.0 * sum((letters & Counter(window)).values()) / (len(wanted) + len(window))
        if bound >= threshold:
            yield -bound, i


def matched(a: str, b: str) -> int:
    """Letters in the matching blocks of ``difflib``, for a second text of under 200 letters, where none counts as popular."""
    total, parts = 0, [(a, b)]
    while parts:
        a, b = parts.pop()
        at = size = 0
        for i in range(len(a)):
            if i + size >= len(a):
                break
            while i + size < len(a) and a[i : i + size + 1] in b:
                at, size = i, size + 1
        if size:
            j = b.index(a[at : at + size])
            total += size
            parts += [(a[:at], b[:j]), (a[at + size :], b[j + size :])]
    return total


def _same(a: str, b: str) -> int:
    """Letters that both begin with."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def _all_but_one(a: str, b: str) -> bool:
    """Whether texts of one length have all letters but one in common, in order."""
    k = _same(a, b)
    if a[k + 1 :] == b[k + 1 :]:
        return True
    for x, y in ((a, b), (b, a)):  # a letter that only x has, then one that only y has
        m = _same(x[k + 1 :], y[k:])
        if x[k + 1 + m :] == y[k + m + 1 :]:
            return True
    return False


def _nearly_whole(low: str, wanted: str) -> tuple[int, int] | None:
    """Letters that match, all or all but one, and the earliest window in which the most do; None if there is no such window.

    One letter that is left over on either side breaks the quote at two places at most, so one of its thirds
    stands in the text, moved by one at most.
    """
    n = len(wanted)
    blocks = matched if n < 200 else lambda a, b: sum(m.size for m in SequenceMatcher(None, a, b).get_matching_blocks())
    if (at := low.find(wanted)) >= 0:
        return n, at
    found, last = set(), len(low) - n
    for begin, end in ((0, n // 3), (n // 3, 2 * n // 3), (2 * n // 3, n)):
        part = wanted[begin:end]
        at = low.find(part)
        while at >= 0:
            found.update((at - begin - 1, at - begin, at - begin + 1))
            at = low.find(part, at + 1)
    for i in sorted(found):
        if 0 <= i <= last:
            window = low[i : i + n]
            if _all_but_one(wanted, window) and blocks(wanted, window) == n - 1:
                return n - 1, i
    return None


def best_window(text: str, quote: str, threshold: float, places: Places | None = None) -> str | None:
    """Earliest window of the quote's length with the highest ratio to the quote, if that reaches the threshold.

    The ratio is that of ``difflib``, quote first, in lower case; a text shorter than the quote has no window.
    If M of n letters match, at most n - M are left over on either side, so they match in at most 2(n - M) + 1
    blocks, none moved by more than n - M.  So a window has at least M - (2(n - M) + 1)(q - 1) of the quote's
    grams of q letters near their places, and only windows with as many as the threshold asks for are
    candidates.  They are compared in the order of the letters they share, and in full only if these, and
    then the longest common subsequence, allow a higher ratio, or the same one earlier.  Windows in which all
    letters but one match are sought first, then those with few left over: nothing else is better than what is
    found there.  ``places`` may be those of the text.
    """
    n = len(quote)
    if not n or len(text) < n:
        return None
    places, wanted, own = places or Places(text), quote.lower(), _plain(quote)
    least = math.ceil(threshold * n - 1e-9)
    if places.low is not None and len(wanted) == n and SHORT <= n and (n - 1) / n >= threshold:
        if (whole := _nearly_whole(places.low, wanted)) is not None:
            return f"{whole[1]}:{whole[1] + n}"
    for level in sorted({max(least, n - 1 - n // FEW), least}, reverse=True):
        slip = n - level
        needed = {q: level - (2 * slip + 1) * (q - 1) for q in (3, 2, 1)}
        size = next((q for q, k in needed.items() if k > 0 and n >= q), None)
        if places.codes is None or size is None or len(wanted) != n:
            return _best(text, wanted, n, threshold, sorted(_all_windows(text, wanted, n, threshold)))
        codes = _codes(own)
        some = places.seeded(codes, size, slip, needed[size])
        some = places.joined(wanted, some[places.letters(codes, some) >= level], level)
        shared = places.letters(codes, some)
        order = np.lexsort((some, -shared))
        found = _best(text, wanted, n, max(threshold, level / n), list(zip((-shared[order] / n).tolist(), some[order].tolist(), strict=True)), places)
        if found:
            return found
    return None


def _best(text: str, wanted: str, n: int, threshold: float, bounded: list[tuple[float, int]], places: Places | None = None) -> str | None:
    """The best of windows that come with their bounds, highest first."""
    long = len(wanted) == n >= LONG and places is not None and places.low is not None
    common = None if long else _Subsequence(wanted)
    best, at = 0.0, -1
    for bound, i in bounded:
        if -bound < best:
            break
        if -bound == best and i > at:
            continue
        if long:
            ratio = 2.0 * places.matched(wanted, i, max(threshold, best)) / (2 * n)
            if ratio > best or (ratio == best and i < at):
                best, at = ratio, i
            continue
        window = text[i : i + n].lower()
        most = 2.0 * common(window) / (n + len(window) if len(wanted) == n else len(wanted) + len(window))
        if most < threshold or most < best or (most == best and i > at):
            continue
        ratio = SequenceMatcher(None, wanted, window).ratio()
        if ratio > best or (ratio == best and i < at):
            best, at = ratio, i
    return f"{at}:{at + n}" if at >= 0 and best >= threshold else None
