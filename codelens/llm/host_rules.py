"""Host-level quality rules: documents fail rules, hosts get a shrunken failure rate, documents its verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import materialise
from .text import let, unused, words

SYMBOLS = "#*$%&|<>"
#: A host is strict if its shrunken share of failing documents is above this.
STRICT_ABOVE = 0.5
#: Bounds of the prior's weight, in documents.
PRIOR_WEIGHT = (1.0, 10_000.0)
#: Hosts up to which their verdicts are broadcast; more are joined by a shuffle.
BROADCAST_HOSTS = 100_000
ADDED = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "failed", "host_rate", "host_strict", "kept"]
_PLACES = 1 << 20


def repeated_words(w: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in the array ``w``.

    Windows are sorted by 44 bits of a hash with their place in the low bits.  Neighbours of equal hash are
    compared word by word; a text where they differ, or with more places than fit, sorts the windows themselves.
    """
    n = F.size(w)
    places = F.sequence(F.lit(0), n - 3)
    place = lambda x: x.bitwiseAND(_PLACES - 1).cast("int")
    hashed = lambda x: F.shiftright(x, 20)

    def covered(at: Column) -> Column:
        step = lambda a, p: F.struct((a["n"] + F.least(F.lit(3), p - a["last"])).cast("long").alias("n"), p.alias("last"))
        return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("last")), step)["n"]

    def by_hash(s: Column) -> Column:
        near = lambda x, i: (hashed(x) == hashed(F.get(s, i - 1))) | (hashed(x) == hashed(F.get(s, i + 1)))
        hits = F.filter(s, lambda x, i: F.coalesce(near(x, i), F.lit(False)))

        def checked(h: Column) -> Column:
            def wrong(x: Column, i: Column) -> Column:
                y = F.get(h, i + 1)
                differ = F.lit(False)
                for k in range(3):
                    differ = differ | (F.get(w, place(x) + k) != F.get(w, place(y) + k))
                return F.coalesce((hashed(x) == hashed(y)) & differ, F.lit(False))

            bad = F.size(F.filter(h, wrong)) > 0
            return F.when(F.size(h) == 0, F.lit(0).cast("long")).when(~bad, covered(F.array_sort(F.transform(h, place))))

        return let(hits, checked)

    def by_words(s: Column) -> Column:
        same = lambda x, i: (x["t"] == F.get(s, i - 1)["t"]) | (x["t"] == F.get(s, i + 1)["t"])
        return covered(F.array_sort(F.transform(F.filter(s, lambda x, i: F.coalesce(same(x, i), F.lit(False))), lambda x: x["i"])))

    key = lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).bitwiseAND(-_PLACES).bitwiseOR(i.cast("long"))
    text = lambda i: F.struct(F.concat_ws(" ", F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("t"), i.alias("i"))
    fast = F.when(n <= _PLACES, let(F.sort_array(F.transform(places, key)), by_hash))
    exact = let(F.sort_array(F.transform(places, text)), by_words)
    return F.when(n < 4, F.lit(0).cast("long")).otherwise(F.coalesce(fast, exact))


def rule_columns(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the counts that the rules need, ``base_failed`` and ``failed`` (any rule)."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    own, split, n_lines = (unused(n, docs.columns) for n in ("words", "lines", "line_count"))
    w, lines = F.col(own), F.col(split)
    df = docs.withColumns({own: words(F.col(text_col).cast("string")), split: F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))})
    df = df.withColumns({
        "n_words": F.size(w).cast("long"),
        "word_chars": F.length(F.array_join(w, "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("long"),
        "n_repeat_words": repeated_words(w),
        n_lines: F.size(lines).cast("long"),
    })
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    soft = (10 * F.col("n_symbols") > F.col("word_chars")) | (10 * F.col("n_dup_lines") > 3 * F.col(n_lines)) | (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words"))
    return df.withColumn("base_failed", base).withColumn("failed", F.col("base_failed") | soft).drop(own, split, n_lines)


def host_verdicts(scored: DataFrame, host_col: str = "source") -> DataFrame:
    """``(host, n_docs, n_failed, rate, strict)``, one row a host; null is a host of its own.

    The beta prior comes from the hosts by moments: its mean is the share of failing documents, its weight
    follows from the variance of the hosts' shares, each counted by its documents.
    """
    hosts = scored.groupBy(F.col(host_col).alias("host")).agg(F.count("*").alias("n_docs"), F.sum(F.col("failed").cast("long")).alias("n_failed"))
    hosts = materialise(hosts, "hosts")
    n, f = F.sum("n_docs"), F.sum("n_failed")
    square = F.sum(F.col("n_failed") * F.col("n_failed") / F.col("n_docs"))
    row = hosts.agg(n.alias("n"), f.alias("f"), square.alias("q")).first()
    mean = row.f / row.n if row.n else 0.0
    spread = row.q / row.n - mean * mean if row.n else 0.0
    low, high = PRIOR_WEIGHT
    weight = min(high, max(low, mean * (1 - mean) / spread - 1)) if spread > 1e-12 else high
    rate = (F.col("n_failed") + F.lit(mean * weight)) / (F.col("n_docs") + F.lit(weight))
    return hosts.withColumn("rate", rate).withColumn("strict", F.col("rate") > STRICT_ABOVE)


def judge(docs: DataFrame, host_col: str = "source", text_col: str = "text") -> DataFrame:
    """``docs`` with the rules' counts, ``base_failed``, ``failed``, ``host_rate``, ``host_strict``, ``kept``.

    A document that fails a base rule goes.  The verdict of its host decides on the rest: at a strict host
    only documents that fail no rule stay, elsewhere all do.  A null text has no words and fails; a null
    host is a host of its own; repeated rows count as documents each.  Columns of the added names are
    replaced, others kept.  Scored rows are written once, and hosts are counted from them.
    """
    scored = materialise(rule_columns(docs.drop(*ADDED), text_col), "rules")
    return _judged(scored, host_col)


def _judged(scored: DataFrame, host_col: str) -> DataFrame:
    verdicts = host_verdicts(scored, host_col)
    name = unused("host", scored.columns)
    hosts = verdicts.select(F.col("host").alias(name), F.col("rate").alias("host_rate"), F.col("strict").alias("host_strict"))
    if hosts.count() <= BROADCAST_HOSTS:
        hosts = F.broadcast(hosts)
    out = scored.join(hosts, F.col(host_col).eqNullSafe(F.col(name)), "left").drop(name)
    return out.withColumn("kept", ~F.col("base_failed") & ~(F.col("host_strict") & F.col("failed")))


def host_quality(docs: DataFrame) -> DataFrame:
    """The counts and verdicts of ``judge`` with ``doc_id`` and ``source`` alone; texts are not written."""
    scored = rule_columns(docs.select("doc_id", "source", "text")).drop("text")
    return _judged(materialise(scored, "rules"), "source")


#: The same in SQL, with the parameters of the registered query.
SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3),
y AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, w[i], w[i + 1], w[i + 2]) AS c FROM x),
z AS (SELECT doc_id, least(3, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -3)) AS n FROM y WHERE c > 1),
r AS (SELECT doc_id, sum(n)::BIGINT AS n FROM z GROUP BY doc_id),
l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
m AS (SELECT doc_id, count(*) AS n, count(DISTINCT line) AS k FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
s AS (
  SELECT d.doc_id, d.source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    (length(text) - length(translate(text, '{SYMBOLS}', '')))::BIGINT AS n_symbols, coalesce(m.n - m.k, 0)::BIGINT AS n_dup_lines,
    coalesce(r.n, 0)::BIGINT AS n_repeat_words, coalesce(m.n, 0) AS n_lines
  FROM d LEFT JOIN r USING (doc_id) LEFT JOIN m USING (doc_id)),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s),
f AS (
  SELECT *, base_failed OR 10 * n_symbols > word_chars OR 10 * n_dup_lines > 3 * n_lines OR word_chars < 2 * n_words OR word_chars > 15 * n_words AS failed FROM b),
h AS (SELECT source, count(*) AS n, sum(failed::BIGINT)::BIGINT AS k FROM f GROUP BY source),
p AS (SELECT sum(k)::DOUBLE / sum(n) AS mean, sum(k * k::DOUBLE / n) / sum(n) - (sum(k)::DOUBLE / sum(n)) ** 2 AS var FROM h),
q AS (
  SELECT mean, CASE WHEN var > 1e-12 THEN least({PRIOR_WEIGHT[1]}, greatest({PRIOR_WEIGHT[0]}, mean * (1 - mean) / var - 1)) ELSE {PRIOR_WEIGHT[1]} END AS weight FROM p),
v AS (SELECT h.source, (h.k + q.mean * q.weight) / (h.n + q.weight) > {STRICT_ABOVE} AS strict FROM h CROSS JOIN q)
SELECT f.doc_id, f.n_words, f.word_chars, f.n_symbols, f.n_dup_lines, f.n_repeat_words, f.base_failed,
  NOT f.base_failed AND NOT (v.strict AND f.failed) AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""
