"""SimHash near-duplicates: meet-in-the-middle ball hashing."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import materialise
from .graph import connected_components
from .text import unused

BITS = 64
#: Shingles whose bits are counted at a time, so that a very long text needs no more memory.
SLICE = 1 << 15
#: Words of a shingle and share of common shingles that make two texts near copies.
NEAR_WORDS, NEAR_SHARE = 5, 0.8
#: Bands of least hashes and hashes a band: a pair at the share meets in one with a chance of 0.998.
BANDS, BAND_ROWS = 20, 6
#: Of two texts' least hashes, the share that agree in pairs that are checked; it is an estimate of the share of
#: common shingles with a standard deviation of 0.04 at most near ``NEAR_SHARE``, six of which are left here.
LIKELY = 0.56
#: Members of a block, all of which are checked against each other.
BLOCK = 16
#: Times that the buckets of members without a link are made finer by a further band.
LEVELS = 2
#: Members of a block of what is left of a bucket then, every two blocks of which meet.
REST = 256
_FACTORS = np.random.default_rng(7).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _hashes(w: list[bytes], shingle: int) -> np.ndarray:
    """XXH64 of a text's word shingles; fewer words are one shingle."""
    if not w:
        return np.empty(0, np.uint64)
    parts = map(b" ".join, zip(*(w[i:] for i in range(shingle)), strict=False)) if len(w) >= shingle else iter([b" ".join(w)])
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), np.uint64, max(1, len(w) - shingle + 1))


def _majority(hashes: np.ndarray) -> int:
    """Unsigned number whose bits are set where they are in over half of the hashes."""
    set_bits = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), SLICE):
        octets = hashes[i : i + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        set_bits += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles; zero if it has no word."""
    return _majority(_hashes(_words(text), shingle))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fp)`` for every row; fp is the fingerprint as a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
            yield pa.record_batch([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(score, "doc_id long, fp long")


def links(classes: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect distinct fingerprints differing in at most two bits.

    Every fingerprint emits all values within one bit of it.  Two fingerprints within two bits share such a
    value, and those sharing one are within two bits, at most 65 of them; neighbours in their order are
    linked, which connects them all without forming every pair.  The distance is checked all the same.
    """
    fp = F.col("fp")
    flips = [F.lit(v - (1 << 64) if v >> 63 else v) for v in (1 << i for i in range(BITS))]
    ball = classes.select("fp", F.explode(F.array(fp, *[fp.bitwiseXOR(v) for v in flips])).alias("variant"))
    before = F.lag("fp").over(Window.partitionBy("variant").orderBy("fp"))
    near = ball.select(fp.alias("a"), before.alias("b")).where("b IS NOT NULL")
    return near.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2).distinct()


def simhash_components(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Fingerprints link at two or fewer differing bits; ``component_id`` is the smallest doc_id of those
    reachable.  Copies meet in one fingerprint, and only distinct fingerprints emit variants.  A null text
    counts as empty and has fingerprint zero; a null doc_id is never the smallest, unless a component has
    no other; repeated rows stay, each with the same values; other columns are left aside.
    """
    marked = materialise(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    classes = materialise(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "classes")
    roots = connected_components(links(classes)).withColumnRenamed("node", "fp")
    placed = classes.join(roots, "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("root"))
    placed = materialise(placed, "placed")
    smallest = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    lookup = placed.join(smallest, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return marked.join(lookup, "fp").select("doc_id", shown, "component_id")


def _least(distinct: np.ndarray) -> np.ndarray:
    """Least hashes of a text's distinct shingles, one a hash function."""
    least = np.full(len(_FACTORS), np.uint64((1 << 64) - 1))
    step = max(1, SLICE // 8)
    for i in range(0, len(distinct), step):
        np.minimum(least, (distinct[i : i + step, None] * _FACTORS).min(axis=0), out=least)
    return least


def _bands(least: np.ndarray) -> np.ndarray:
    """A hash for each band of least hashes."""
    rows = least.reshape(BANDS, BAND_ROWS)
    return np.fromiter((xxhash.xxh64_intdigest(r.tobytes(), k) for k, r in enumerate(rows)), np.uint64, BANDS).view(np.int64)


def _sketches(rows: DataFrame) -> DataFrame:
    """``rows(key, text)`` to ``(key, same, fp, n, bands, mins)``.

    They are a digest of the words, the SimHash, the number of distinct shingles, the bands, and 16 bits of
    each least hash.
    """

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["key", "same", "fp", "n", "bands", "mins"]
        for batch in batches:
            same, fp, n, bands, mins = [], [], [], [], []
            for t in batch.column(1):
                w = _words(t.as_py())
                h = _hashes(w, NEAR_WORDS)
                distinct = np.unique(h)
                least = _least(distinct)
                same.append(xxhash.xxh3_128_digest(b" ".join(w)))
                fp.append(_majority(h))
                n.append(len(distinct))
                bands.append(_bands(least) if w else [])
                mins.append((least >> np.uint64(24)).astype("<u2").tobytes())
            signed = pa.array(np.array(fp, np.uint64).view(np.int64))
            columns = [batch.column(0), pa.array(same, pa.binary()), signed, pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(mins, pa.binary())]
            yield pa.record_batch(columns, names)

    return rows.mapInArrow(sketch, "key long, same binary, fp long, n long, bands array<long>, mins binary")


def _likely(pairs: DataFrame, kinds: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose least hashes agree often enough for texts that are near copies."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(batch.num_rows, -1) for i in (2, 3))
            yield batch.select([0, 1]).filter(pa.array((x == y).mean(axis=1) >= LIKELY))

    of = lambda n: kinds.select(F.col("node").alias(n), F.col("mins").alias(f"mins_{n}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "mins_a", "mins_b").mapInArrow(check, "a long, b long")


def _alike(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts share enough of their shingles."""

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, own = None, None
        for batch in batches:
            good = []
            for i in range(batch.num_rows):
                a = batch.column(0)[i].as_py()
                text = batch.column(2)[i].as_py()
                if (a, text) != last:
                    last, own = (a, text), np.unique(_hashes(_words(text), NEAR_WORDS))
                other = np.unique(_hashes(_words(batch.column(3)[i].as_py()), NEAR_WORDS))
                both = len(np.intersect1d(own, other, assume_unique=True))
                good.append(both >= NEAR_SHARE * (len(own) + len(other) - both))
            yield batch.select([0, 1]).filter(pa.array(good, pa.bool_()))

    of = lambda n: texts.select(F.col("key").alias(n), F.col("text").alias(f"text_{n}"))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "text_a", "text_b").mapInArrow(check, "a long, b long").distinct()


def _pivoted(members: DataFrame) -> DataFrame:
    """``members(bucket, node, n)`` with ``pivot(node, n)``, the bucket's first in a hashed order, which is left out.

    ``size`` is the number of members, the pivot included; buckets of one are left out.
    """
    turn = F.struct(F.xxhash64("node", "bucket").alias("h"), "node", "n")
    pivots = members.groupBy("bucket").agg(F.min(turn).alias("pivot"), F.count("*").alias("size")).where("size > 1")
    return members.join(pivots, "bucket").where("node <> pivot.node")


def _fitting(pivoted: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` of members and pivots whose numbers of shingles allow enough common ones."""
    fits = F.least("n", "pivot.n") >= NEAR_SHARE * F.greatest("n", "pivot.n")
    return pivoted.where(fits).select(*_ordered("node", "pivot.node"))


def _blocks(members: DataFrame) -> DataFrame:
    """Pairs ``(a, b)`` within blocks of about ``BLOCK`` of ``members(bucket, node, n, size, away)``, one of them away.

    A bucket of that size is one block; a larger one is dealt by a hash of the nodes, so that no member has
    more than a block's partners.
    """
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).alias("block")
    own = members.select("bucket", block, "node", "n", "away")
    other = own.select("bucket", "block", F.col("node").alias("other"), F.col("n").alias("m"), F.col("away").alias("too"))
    fits = F.least("n", "m") >= NEAR_SHARE * F.greatest("n", "m")
    both = own.join(other, ["bucket", "block"]).where((F.col("node") > F.col("other")) & (F.col("away") | F.col("too")) & fits)
    return both.select(*_ordered("node", "other"))


def _away(pivoted: DataFrame, good: DataFrame) -> DataFrame:
    """``pivoted`` with ``away``: whether there is no link to the pivot."""
    linked = good.withColumn("linked", F.lit(True))
    both = pivoted.select("bucket", "node", "n", "size", *_ordered("node", "pivot.node")).join(linked, ["a", "b"], "left")
    return both.select("bucket", "node", "n", "size", F.col("linked").isNull().alias("away"))


def _finer(away: DataFrame, kinds: DataFrame) -> DataFrame:
    """Members without a link in buckets of one more band, whichever of its bands a node adds."""
    others = away.select("bucket", "node", "n").join(kinds.select("node", "bands"), "node").select("bucket", "node", "n", F.explode("bands").alias("other"))
    # Sums of two hashes do not depend on their order.
    mixed = lambda c: F.shiftright(F.xxhash64(c), 2)
    return others.where("bucket <> other").select((mixed("bucket") + mixed("other")).alias("bucket"), "node", "n").distinct()


def _rest(away: DataFrame, good: DataFrame, kinds: DataFrame, done: int) -> DataFrame:
    """Pairs ``(a, b)`` of a bucket's members that no links connect, and whose least hashes agree often enough.

    These are all such pairs of the buckets of more members than ``done``; of the others all pairs are known.
    A bucket is dealt to blocks, and a task holds two of them, so memory does not follow the bucket.  Least hashes are
    compared there, and only pairs that pass are rows.
    """
    roots = connected_components(good)
    own = away.where(F.col("size") > done).join(roots, "node", "left").select("bucket", "node", "n", "size", F.coalesce("component", "node").alias("root"))
    several = own.groupBy("bucket").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least <> most").select("bucket")
    blocks = F.ceil(F.col("size") / REST)
    own = own.join(several, "bucket", "left_semi").join(kinds.select("node", "mins"), "node").withColumn("block", F.pmod(F.xxhash64("node"), blocks))
    with_ = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda o: F.struct(F.least("block", o).alias("x"), F.greatest("block", o).alias("y")))
    met = own.withColumn("both", F.explode(with_)).select("bucket", "both.*", "block", "node", "n", "root", "mins")

    def check(table: pa.Table) -> pa.Table:
        x, y = table.column("x")[0].as_py(), table.column("y")[0].as_py()
        block, node, n, root = (table.column(c).to_numpy() for c in ("block", "node", "n", "root"))
        mins = np.frombuffer(b"".join(table.column("mins").to_pylist()), "<u2").reshape(len(node), -1)
        found = [np.empty((0, 2), np.int64)]
        for i in np.flatnonzero(block == x):
            fits = np.minimum(n, n[i]) >= NEAR_SHARE * np.maximum(n, n[i])
            at = np.flatnonzero((block == y) & (root != root[i]) & fits & ((x != y) | (node < node[i])))
            at = at[(mins[at] == mins[i]).mean(axis=1) >= LIKELY]
            found.append(np.stack([np.maximum(node[at], node[i]), np.minimum(node[at], node[i])], axis=1))
        a, b = np.concatenate(found).T
        return pa.table({"a": a, "b": b})

    return met.groupBy("bucket", "x", "y").applyInArrow(check, "a long, b long").distinct()


def _ordered(x: str, y: str, *more: str) -> list:
    return [F.greatest(x, y).alias("a"), F.least(x, y).alias("b"), *more]


def _keyed(docs: DataFrame, name: str, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with a number for each id and text: the id, where it has one text.

    Of an id's different texts one, by hash, has the id; the others, and texts without an id, have numbers of
    their own, above all usual ids.
    """
    hashed, own = F.xxhash64(F.col(text_col).cast("string")), F.col(id_col).cast("long")
    high = lambda h: F.shiftrightunsigned(h, 2).bitwiseOR(1 << 62)
    ids = docs.where(own.isNotNull()).groupBy(own.alias("_of")).agg(F.min(hashed).alias("_least"), F.max(hashed).alias("_most"))
    several = materialise(ids.where("_least <> _most").select("_of", "_least"), "several")
    if several.isEmpty():
        return docs.withColumn(name, F.coalesce(own, high(hashed)))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, own.alias("_id"), hashed.alias("_hash")).join(several, F.col("_id") == F.col("_of"), "left")
    key = F.when(F.col("_id").isNull(), high(F.col("_hash"))).when(F.col("_hash") != F.col("_least"), high(F.xxhash64("_id", "_hash"))).otherwise(F.col("_id"))
    return rows.select(*[F.col("row").getField(c).alias(c) for c in docs.columns], key.alias(name))


def near_links(docs: DataFrame, key_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """Documents by the smallest key of their exact copies, ``(node)``, and links ``(a, b)`` of near copies.

    Near copies share ``NEAR_SHARE`` of their distinct shingles of ``NEAR_WORDS`` words, which is checked
    for every link.  Pairs to check come from the balls of the SimHash fingerprints, which reach texts with
    few edits, and from bands of least hashes, which reach the rest.  The members of a bucket are checked
    against one of them, the pivot, so that a bucket of any size makes one pair a member.  Those that are
    not near it, as where a bucket holds all texts with a common passage, are checked against the others of
    their block, and meet again, with pivots and blocks, in buckets of one more band, ``LEVELS`` times.  Of
    the pairs of a bucket that are left then, those which links already connect are passed over, and all others
    are checked.  Before texts are compared, their least hashes are.
    """
    rows = docs.select(F.col(key_col).cast("long").alias("key"), F.col(text_col).cast("string").alias("text"))
    found = materialise(_sketches(rows), "sketches")
    kinds = found.groupBy("same").agg(F.min("key").alias("node"), *[F.first(c).alias(c) for c in ("fp", "n", "bands", "mins")])
    kinds = materialise(kinds.drop("same"), "kinds")

    prints = materialise(kinds.groupBy("fp").agg(F.min(F.struct("node", "n")).alias("first")), "prints")
    first = lambda n: prints.select(F.col("fp").alias(n), F.col("first").alias(f"first_{n}"))
    apart = links(prints).join(first("a"), "a").join(first("b"), "b")
    apart = apart.select(F.col("first_a.node").alias("x"), F.col("first_b.node").alias("y"), F.col("first_a.n").alias("n"), F.col("first_b.n").alias("m"))
    equal = kinds.join(prints, "fp").select(F.col("node").alias("x"), F.col("first.node").alias("y"), "n", F.col("first.n").alias("m"))
    fits = (F.least("n", "m") >= NEAR_SHARE * F.greatest("n", "m")) & (F.col("x") != F.col("y"))
    more = apart.unionByName(equal).where(fits).select(*_ordered("x", "y"))

    members = kinds.select(F.explode("bands").alias("bucket"), "node", "n")

    def checked(new: DataFrame) -> DataFrame:
        nodes = new.select(F.col("a").alias("key")).unionByName(new.select(F.col("b").alias("key"))).distinct()
        return materialise(_alike(new, rows.join(nodes, "key", "left_semi")), "near")

    asked = good = whole = None
    for level in range(LEVELS + 1):
        pivoted = materialise(_pivoted(members), "buckets")
        new = more.unionByName(_fitting(pivoted)).distinct()
        if asked is not None:
            new = new.join(asked, ["a", "b"], "left_anti")
        new = materialise(_likely(new, kinds), "pairs")
        asked = new if asked is None else asked.unionByName(new)
        near = checked(new)
        good = near if good is None else good.unionByName(near)
        if whole is None or level < LEVELS:
            away = materialise(_away(pivoted, good), "away")
            whole = away if whole is None else whole
            more = _blocks(away)
            members = _finer(away.where("away"), kinds)
    rest = materialise(_rest(whole, good, kinds, BLOCK if LEVELS else 1).join(asked, ["a", "b"], "left_anti"), "pairs")
    return kinds.select("node").distinct(), good.unionByName(checked(rest))


def first_of_each(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is the smallest of their group of near copies, with their columns.

    Groups are what links of ``near_links`` connect; texts without a word are copies of each other.  Rows
    that repeat an id and its text count as one document, of which one row stays, by a hash of its other
    columns; different texts under one id are documents each.  Rows without an id, and further texts of an id, come after
    those with one.
    """
    name = unused("key", docs.columns)
    keyed = _keyed(docs, name, "doc_id", "text")
    nodes, near = near_links(keyed, name)
    later = connected_components(near).where("node <> component").select("node")
    ids = nodes.join(later, "node", "left_anti").select(F.col("node").alias("key"))
    others = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    kept = keyed.select(F.col(name).alias("key"), row, F.xxhash64(F.to_json(F.struct(*others))).alias("rest")).join(ids, "key", "left_semi")
    first = kept.groupBy("key").agg(F.min_by("row", "rest").alias("row"))
    return first.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
