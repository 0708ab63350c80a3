"""Secret scans by grammar inference: probabilistic automata learnt from labelled credentials."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

KINDS = ("assign", "access", "hex")
#: Labelled credentials of a kind that an automaton is learnt from.
SAMPLE = 600
#: Hoeffding bound's confidence for merging two states.
ALPHA = 0.05
#: Log-likelihood ratio, automaton against background, from which a candidate is added: a character and in all.
ACCEPT, ACCEPT_ALL = 0.7, 12.0
#: Labelled credentials of more characters are left out of that sample, which bounds the prefix tree.
LONGEST = 256

_assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_access = re.compile(r"AKIA[A-Z0-9]+")
_hex = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
_token = re.compile(r"(?<![A-Za-z0-9+/_.=-])[A-Za-z0-9+/_.=-]{8,}")
#: Runs that cannot be told from words: letters in usual case, perhaps with marks between or after them.
_words = re.compile(r"(?:[A-Z]?[a-z]++|[A-Z]++)?(?:[+/_.=-]++(?:[A-Z]?[a-z]++|[A-Z]++)?)*+")
_keys = ("passw", "secret", "token", "apikey", "api_key")

#: Classes of characters: digits, a-f, g-z, A-F, G-Z, others.
_CLASSES = {ord(c): k for k, letters in (("d", "0123456789"), ("x", "abcdef"), ("l", "ghijklmnopqrstuvwxyz"), ("X", "ABCDEF"), ("U", "GHIJKLMNOPQRSTUVWXYZ"), ("s", "+/_.=-")) for c in letters}


def shape(value: str) -> str:
    return value.translate(_CLASSES)


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """``(kind, start, end, value)`` in code points, by start, then kind."""
    out = []
    low = text.lower()
    if any(k in low for k in _keys):
        out += [(0, *m.span(), m[2]) for m in _assign.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        out += [(1, *m.span(), m[0]) for m in _access.finditer(text) if len(m[0]) >= 16]
    out += [(2, *m.span(), m[0]) for m in _hex.finditer(text)]
    return sorted(out, key=lambda s: (s[1], s[0]))


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """``(start, end, value)`` of runs of eight or more characters of credentials outside the base spans.

    Runs of letters in usual case, with or without marks, are words and no candidates; all others are.  Dots
    and dashes at the end belong to the sentence.
    """
    out, i = [], 0
    for m in _token.finditer(text):
        value = m[0].rstrip(".-")
        end = m.start() + len(value)
        if len(value) < 8 or _words.fullmatch(value):
            continue
        while i < len(base) and base[i][2] <= m.start():
            i += 1
        if not any(a < end and m.start() < b for _, a, b, _ in base[i : i + 8]):
            out.append((m.start(), end, value))
    return out


class Automaton:
    """Probabilistic automaton over character classes, learnt by merging states of a prefix tree.

    States are compared in the order of their first strings.  Two are merged if their frequencies of ending
    and of each class, and those of the states that follow, differ by less than Hoeffding's bound.
    """

    def __init__(self, strings: list[str], alpha: float = ALPHA) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.flow: list[dict[str, int]] = [{}]
        self.ends = [0]
        for s in strings:
            q = 0
            for c in s:
                if c not in self.next[q]:
                    self.next[q][c] = len(self.next)
                    self.next.append({})
                    self.flow.append({})
                    self.ends.append(0)
                self.flow[q][c] = self.flow[q].get(c, 0) + 1
                q = self.next[q][c]
            self.ends[q] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_all()

    def _total(self, q: int) -> int:
        return self.ends[q] + sum(self.flow[q].values())

    def _differ(self, f: int, n: int, g: int, m: int) -> bool:
        return abs(f / n - g / m) > self.bound * (n**-0.5 + m**-0.5)

    def _alike(self, a: int, b: int) -> bool:
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            n, m = self._total(a), self._total(b)
            if not n or not m:
                continue
            if self._differ(self.ends[a], n, self.ends[b], m):
                return False
            for c in {*self.flow[a], *self.flow[b]}:
                if self._differ(self.flow[a].get(c, 0), n, self.flow[b].get(c, 0), m):
                    return False
                if c in self.next[a] and c in self.next[b]:
                    stack.append((self.next[a][c], self.next[b][c]))
        return True

    def _fold(self, a: int, b: int) -> None:
        """Add the tree below ``b`` to the states from ``a`` on."""
        stack = [(a, b)]
        while stack:
            a, b = stack.pop()
            self.ends[a] += self.ends[b]
            for c, n in self.flow[b].items():
                self.flow[a][c] = self.flow[a].get(c, 0) + n
                if c in self.next[a]:
                    stack.append((self.next[a][c], self.next[b][c]))
                else:
                    self.next[a][c] = self.next[b][c]

    def _merge_all(self) -> None:
        red = [0]
        while True:
            blue = [(q, c, t) for q in red for c, t in sorted(self.next[q].items()) if t not in red]
            if not blue:
                break
            q, c, t = min(blue, key=lambda x: x[2])
            match = next((r for r in red if self._alike(r, t)), None)
            if match is None:
                red.append(t)
            else:
                self.next[q][c] = match
                self._fold(match, t)
        self.states = red
        self.steps = {q: self._chances(q) for q in red}

    def _chances(self, q: int) -> tuple[dict[str, float], float, float]:
        """Logarithms of the state's chances: of each class it has seen, of any other, of ending."""
        n = self._total(q)
        log = lambda k: math.log((k + 0.01) / (n + 0.07))
        return {c: log(k) for c, k in self.flow[q].items()}, log(0), log(self.ends[q])

    def log_likelihood(self, s: str) -> float:
        """Natural logarithm of the string's probability; unseen steps have a small one and end it."""
        total, q = 0.0, 0
        for i, c in enumerate(s):
            seen, other, _ = self.steps[q]
            total += seen.get(c, other)
            if c not in self.next[q]:
                return total + (len(s) - i) * math.log(1e-3)
            q = self.next[q][c]
        return total + self.steps[q][2]


class Background:
    """Markov chain of character classes over candidates that no rule labels."""

    def __init__(self, pairs: dict[tuple[str, str], int]) -> None:
        self.pairs = pairs
        self.rows: dict[str, int] = {}
        for (a, _), n in pairs.items():
            self.rows[a] = self.rows.get(a, 0) + n
        self.logs = {(a, b): math.log((pairs.get((a, b), 0) + 1.0) / (self.rows.get(a, 0) + 7.0)) for a in "^dxlXUs" for b in "dxlXUs$"}

    def log_likelihood(self, s: str) -> float:
        return sum(map(self.logs.__getitem__, zip("^" + s, s + "$", strict=True)))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base)`` and ``loose`` for every row: spans with the shapes of their values."""
    strict = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("shape", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                found = base_spans(text)
                base.append([{"kind": k, "start": a, "end": b, "shape": shape(v)} for k, a, b, v in found])
                loose.append([{"kind": -1, "start": a, "end": b, "shape": shape(v)} for a, b, v in candidates(text, found)])
            yield pa.record_batch([batch.column(0), pa.array(base, pa.list_(strict)), pa.array(loose, pa.list_(strict))], ["doc_id", "base", "loose"])

    span = "struct<kind:int,start:int,end:int,shape:string>"
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base array<{span}>, loose array<{span}>")


def learn(spans: DataFrame) -> tuple[list[Automaton | None], Background]:
    """An automaton a kind from a sample of its labelled shapes, and the background of all other candidates.

    The sample of a kind is the ``SAMPLE`` credentials of smallest hash, of those up to ``LONGEST`` characters;
    the background's counts cover all candidates whole, added up within a batch before they are shuffled.
    """
    labelled = spans.select("doc_id", F.explode("base").alias("s")).select("doc_id", "s.kind", "s.start", "s.shape")
    automata: list[Automaton | None] = []
    for kind in range(len(KINDS)):
        some = labelled.where((F.col("kind") == kind) & (F.length("shape") <= LONGEST)).orderBy(F.xxhash64("doc_id", "start"), "doc_id", "start").limit(SAMPLE)
        strings = [r.shape for r in some.select("shape").collect()]
        automata.append(Automaton(strings) if strings else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: Counter = Counter()
            for row in batch.column(0):
                for span in row.as_py():
                    seen.update(zip("^" + span["shape"], span["shape"] + "$", strict=True))
            yield pa.record_batch([pa.array(["".join(p) for p in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["p", "n"])

    counts = spans.select("loose").mapInArrow(count, "p string, n long").groupBy("p").agg(F.sum("n").alias("n")).collect()  # a row a pair of classes
    return automata, Background({(r["p"][0], r["p"][1]): r["n"] for r in counts})


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, added)`` for every row, arrays of ``(kind, start, end)`` in code points.

    Patterns give the base spans, which stay and label the credentials that the automata are learnt from.
    Every other run of eight or more of their characters that is no word is scored by each automaton against
    the background, and added under the kind that explains it best, if that is by ``ACCEPT`` a character and
    ``ACCEPT_ALL`` in all.  A null text
    counts as empty; repeated rows stay; a null id is kept; without labelled credentials nothing is added.
    """
    spans = materialise(scan(docs, id_col, text_col), "secrets")
    automata, background = learn(spans)
    model = spans.sparkSession.sparkContext.broadcast((automata, background))

    def verdict(value: str) -> int:
        grammars, rest = model.value
        plain = rest.log_likelihood(value)
        gain, k = max(((a.log_likelihood(value) - plain, -k) for k, a in enumerate(grammars) if a), default=(-1.0, 0))
        return -k if gain >= max(ACCEPT_ALL, ACCEPT * (len(value) + 1)) else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())])
        for batch in batches:
            base = [[{k: s[k] for k in ("kind", "start", "end")} for s in row.as_py()] for row in batch.column(1)]
            added = [[{"kind": v, "start": s["start"], "end": s["end"]} for s in row.as_py() if (v := verdict(s["shape"])) >= 0] for row in batch.column(2)]
            yield pa.record_batch([batch.column(0), pa.array(base, pa.list_(place)), pa.array(added, pa.list_(place))], ["doc_id", "base", "added"])

    span = "struct<kind:int,start:int,end:int>"
    return spans.mapInArrow(run, f"doc_id long, base array<{span}>, added array<{span}>")
