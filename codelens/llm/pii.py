"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides."""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise

KINDS = ("email", "ip", "card", "phone")
#: A span of which the classifier is surer than this is added.
ACCEPT = 0.9
#: Characters before and after a candidate that the gazetteer reads.
NEAR = 48

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_digit = re.compile("[0-9]")
_email = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_ip = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_card = re.compile(r"[0-9](?:[ -]?[0-9])+")
_phone = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# Looser forms, whose matches are candidates only.
_masked = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?[(\[{] ?at ?[)\]}] ?[A-Za-z0-9-]{1,63}(?: ?(?:[(\[{] ?dot ?[)\]}]|\.) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_loose_phone = re.compile(r"(?<![0-9+.-])(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9]|[.-][0-9])")
_loose_card = re.compile(r"(?<![0-9.])[0-9]{4}([./_])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9])")
_ip6 = re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])")
_word = re.compile(r"[^\W\d_]+")

#: Words near a span that speak for its kind, in several languages, and words that speak for a plain number.
GAZETTEER = {
    "email": frozenset("email mail mailto contact contacto kontakt courriel correo write reach address".split()),
    "ip": frozenset("ip host server address addr client login network router".split()),
    "card": frozenset("card visa mastercard amex credit debit payment karte carte tarjeta pan".split()),
    "phone": frozenset("phone tel telephone telefon teléfono téléphone call mobile cell fax handy móvil".split()),
}
AGAINST = frozenset("version release build isbn issn order invoice serial model section chapter page id ref total date".split())


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the address pattern, found from each @ so that long words cost no retries."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        m = _email.match(text, start) if start < at else None
        if m:
            found.append(m.span())
            end = m.end()
        at = text.find("@", max(at + 1, end))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(kind, start, end)`` in code points, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)]
    if _digit.search(text):
        out += [(1, *m.span()) for m in _ip.finditer(text) if all(len(p := part.lstrip("0")) <= 3 and int(p or 0) <= 255 for part in m[0].split("."))]
        for m in _card.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append((2, *m.span()))
        if "+" in text:
            out += [(3, *m.span()) for m in _phone.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def loose_spans(text: str) -> list[tuple[int, int, int]]:
    """Further candidates; each pattern's matches from the left."""
    out = []
    if any(x in text for x in ("at)", "at]", "at}", "AT)", "AT]", "AT}", "at )", "at ]")):
        out += [(0, *m.span()) for m in _masked.finditer(text)]
    if _digit.search(text):
        out += [(3, *m.span()) for m in _loose_phone.finditer(text)] + [(2, *m.span()) for m in _loose_card.finditer(text)]
    if ":" in text:
        out += [(1, *m.span()) for m in _ip6.finditer(text)]
    return out


def outside(spans: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that touch none of those taken."""
    starts: list[int] = []
    ends: list[int] = []
    for _, a, b in sorted(taken, key=lambda s: s[1]):
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[1]]


def votes(text: str, kind: int, start: int, end: int, strict: bool) -> tuple[int, ...]:
    """Of each labeler: 2 for personal data, 0 against, 1 if it abstains."""
    body = text[start:end]
    digits = "".join(c for c in body if "0" <= c <= "9")
    regex = 2 if strict else 1
    if kind == 0:
        form = 2 if re.search(r"[.)\]} ][A-Za-z]{2,}$", body) else 0
    elif kind == 1:
        form = 0 if body.split(".")[0] in ("0", "127", "255") or body in ("1.2.3.4", "0.0.0.0") else 2
    elif kind == 2:
        form = 2 if 13 <= len(digits) <= 19 and luhn(digits) and len(set(digits)) > 2 else 0
    else:
        form = 2 if 9 <= len(digits) <= 15 and len(set(digits)) > 2 else 0
    near = {w.lower() for w in _word.findall(text[max(0, start - NEAR) : start]) + _word.findall(text[end : end + NEAR])}
    gazetteer = 2 if near & GAZETTEER[KINDS[kind]] else 0 if near & AGAINST else 1
    before, after = text[start - 1 : start], text[end : end + 1]
    glued = before.isalnum() or after.isalnum() or before in ("=", "/", "_", "$", "€") and before != "" or after in ("/", "%", "_") and after != ""
    return regex, form, gazetteer, 0 if glued else 2


LABELERS = 4
#: Candidates that the classifier is fitted on, those of smallest hash.
SAMPLE = 5000
#: What the classifier sees of a span: its kind, its kind and length, the shape of its characters, the words
#: before and after, and the characters that touch it; numbers of each, words and shapes by hash.
PARTS = (len(KINDS), len(KINDS) * 16, 128, 128, 128, 8, 8)
_STARTS = tuple(sum(PARTS[:i]) for i in range(len(PARTS)))
_last_word, _first_word = re.compile(r"[^\W\d_]+(?=[\W\d_]*$)"), re.compile(r"^[\W\d_]*([^\W\d_]+)")


def _hashed(text: str, n: int) -> int:
    return zlib.crc32(text.lower().encode("utf-8", "surrogatepass")) % n


def _touching(c: str) -> int:
    return 0 if not c else 1 if c.isspace() else 2 if c.isalpha() else 3 if c.isdigit() else 4 + min(3, ":.-".find(c) + 1)


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Numbers of the features that a span has, one of each part."""
    body = text[start:end]
    shape = re.sub(r"(.)\1+", r"\1", re.sub("[0-9]", "0", re.sub(r"[^\W\d_]", "a", body)))
    before, after = _last_word.search(text[max(0, start - NEAR) : start]), _first_word.search(text[end : end + NEAR])
    found = (
        kind, kind * 16 + min(15, len(body) // 3), _hashed(shape, PARTS[2]), _hashed(before[0] if before else "", PARTS[3]),
        _hashed(after[1] if after else "", PARTS[4]), _touching(text[start - 1 : start]), _touching(text[end : end + 1]),
    )
    return [a + b for a, b in zip(_STARTS, found, strict=True)]


def pattern_of(kind: int, given: tuple[int, ...]) -> int:
    out = kind
    for v in given:
        out = out * 3 + v
    return out


def read_pattern(pattern: int) -> tuple[int, tuple[int, ...]]:
    out, given = pattern, []
    for _ in range(LABELERS):
        given.append(out % 3)
        out //= 3
    return out, tuple(reversed(given))


def reliabilities(given: np.ndarray, count: np.ndarray, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """EM over vote patterns of one kind: the probability of personal data for each, and P(vote | class).

    Starts from the votes' mean; a pseudo-count that favours votes for the truth keeps the classes' meaning.
    """
    p = np.clip(given.mean(axis=1) / 2, 0.05, 0.95)
    favour = np.array([[[4.0, 2.0, 1.0], [1.0, 2.0, 4.0]]] * given.shape[1])  # labeler x class x vote
    for _ in range(rounds):
        table = favour.copy()
        for j in range(given.shape[1]):
            np.add.at(table[j, 1], given[:, j], count * p)
            np.add.at(table[j, 0], given[:, j], count * (1 - p))
        table /= table.sum(axis=2, keepdims=True)
        prior = (count @ p + 1) / (count.sum() + 2)
        log = np.log([1 - prior, prior])[None] + sum(np.log(table[j][:, given[:, j]]).T for j in range(given.shape[1]))
        p = 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -50, 50)))
    return p, table


def label(patterns: dict[int, int]) -> dict[int, float]:
    """Probability of personal data for each pattern of votes, by EM within each kind."""
    keys = sorted(patterns)
    read = [read_pattern(k) for k in keys]
    out: dict[int, float] = {}
    for kind in {r[0] for r in read}:
        at = [i for i, r in enumerate(read) if r[0] == kind]
        p, _ = reliabilities(np.array([read[i][1] for i in at]), np.array([patterns[keys[i]] for i in at], float))
        out |= dict(zip([keys[i] for i in at], p.tolist(), strict=True))
    return out


def train(spans: list[list[int]], labels: np.ndarray) -> np.ndarray:
    """Weights of a logistic classifier of spans, by their features, fitted to EM's probabilities."""
    x = np.zeros((len(spans), sum(PARTS)))
    x[np.arange(len(spans))[:, None], np.array(spans, int).reshape(len(spans), len(PARTS))] = 1
    w = np.zeros(x.shape[1])
    for _ in range(20):  # Newton's steps with a ridge
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (labels - p) - 0.3 * w
        hess = (x * np.maximum(p * (1 - p), 1e-6)[:, None]).T @ x + 0.3 * np.eye(len(w))
        w += np.linalg.solve(hess, grad)
    return w


SPAN = "struct<kind:int,start:int,end:int,pattern:int,features:array<int>>"


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, loose)`` for every row: arrays of spans with their vote patterns and features."""
    span = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("pattern", pa.int32()), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, loose = [], []
            for t in batch.column(1):
                text = t.as_py() or ""
                strict = base_spans(text)
                free = outside(loose_spans(text), strict)
                for out, spans, flag in ((base, strict, True), (loose, free, False)):
                    out.append([{"kind": k, "start": a, "end": b, "pattern": pattern_of(k, votes(text, k, a, b, flag)), "features": features(text, k, a, b)} for k, a, b in spans])
            yield pa.record_batch([batch.column(0), pa.array(base, pa.list_(span)), pa.array(loose, pa.list_(span))], ["doc_id", "base", "loose"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, base array<{SPAN}>, loose array<{SPAN}>")


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, base, added)`` for every row, arrays of ``(kind, start, end)`` in code points.

    Strict patterns give the base spans, which stay.  They and looser candidates get votes from a pattern, a
    form, a gazetteer and a context labeler.  Counts of vote patterns over all rows, at most a few hundred
    rows, go to EM, which gives each pattern a probability.  With these as labels of ``SAMPLE`` candidates a
    classifier is fitted that sees no votes, but the span and what stands around it; it adds the looser
    candidates of which it is surer than ``ACCEPT``.  A null text counts as empty; repeated rows stay; a null
    id is kept; without candidates nothing is added.  Other columns take no part.
    """
    spans = materialise(candidates(docs, id_col, text_col), "spans")
    each = spans.select("doc_id", F.explode(F.concat("base", "loose")).alias("s"))
    known = label({r["pattern"]: r["count"] for r in each.groupBy("s.pattern").count().collect()})
    some = each.select(F.xxhash64("doc_id", "s.start", "s.end").alias("h"), "s.pattern", "s.features").orderBy("h", "pattern", "features").limit(SAMPLE).collect()
    weights = train([r.features for r in some], np.array([known[r.pattern] for r in some]))
    least = math.log(ACCEPT / (1 - ACCEPT))
    scores = F.array(*[F.lit(float(w)) for w in weights])
    score = lambda s: F.aggregate(s["features"], F.lit(0.0), lambda a, f: a + F.get(scores, f))
    place = lambda a: F.transform(a, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return spans.select("doc_id", place(F.col("base")).alias("base"), place(F.filter("loose", lambda s: score(s) > least)).alias("added"))


def shown(spans, names: tuple[str, ...]):
    """``kind:start:end`` joined by commas, in the array's order."""
    table = F.array(*[F.lit(n) for n in names])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(table, s["kind"]), s["start"], s["end"])), ",")
