"""Registered queries of the subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, bin_completion, chat, host_rules, importance, line_dedup, mixing, packing, pii, pitman_yor, runs, secrets, simhash
from .text import let, words


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    """Place of a public tokenizer's file, the same on every machine."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_ivfpq_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(_table(spark, sf_dir, "embeddings"))


def op2_pitman_yor_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitman_yor.score_documents(_table(spark, sf_dir, "documents"), whole=True)


def _spans(found: DataFrame, kinds: tuple[str, ...], by_start: bool) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of a table with ``base`` and ``added``."""
    place = lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))
    order = lambda a: F.array_sort(F.transform(a, place)) if by_start else F.array_sort(a)
    of = lambda k: F.size(F.filter("base", lambda s: s["kind"] == F.lit(k))).cast("long")
    counts = [of(k).alias(f"n_{name}") for k, name in enumerate(kinds)]
    digest = F.sha2(pii.shown(order(F.col("base")), kinds), 256).alias("base_sha256")
    return found.select("doc_id", *counts, digest, pii.shown(order(F.concat("base", "added")), kinds).alias("spans"))


def op3_pii_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(pii.find_personal_data(_table(spark, sf_dir, "documents")), pii.KINDS, by_start=False)


def personal_data_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op3, which SQL can express."""
    return op3_pii_weak_supervision(spark, sf_dir).drop("spans")


def secrets_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The base columns of op10, which SQL can express."""
    return op10_secret_grammar(spark, sf_dir).drop("spans")


def op10_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spans(secrets.find_secrets(_table(spark, sf_dir, "documents")), secrets.KINDS, by_start=True)


def op4_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = host_rules.host_quality(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], given.schema)
    part = F.struct(F.lit("text").alias("type"), F.col("text"), *[F.lit(None).cast(t).alias(n) for n, t in (("uri", "string"), ("width", "int"), ("height", "int"), ("duration_ms", "bigint"), ("pages", "int"))])
    turns = given.unionByName(more).select("conv_id", "turn", "role", F.array(part).alias("parts"))
    return chat.digests(chat.format_conversations(turns))


def op6_retrieval_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op7_line_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_line_chunks(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "text", "n_lines", "n_kept", "n_removed")


def op7_passage_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_passages(_table(spark, sf_dir, "documents").select("doc_id", "text"))


def op8_weighted_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op9_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(_table(spark, sf_dir, "documents"))


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_bin_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bin_completion.pack_best_fit(_table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def planted_runs(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)``, every tenth document by its digest being periodic from one of its words on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    g, n = F.floor(h / 10), lambda w: F.size(w)

    def repeated(w):
        a = g % n(w)
        p = 1 + F.floor((n(w) - a) / (3 + g % 8))
        of = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p)
        return F.array_join(F.transform(F.sequence(F.lit(0).cast("bigint"), n(w) - 1), lambda i: F.get(w, of(i).cast("int"))), " ")

    planted = let(words(F.col("text")), lambda w: F.when(n(w) > 0, repeated(w)).otherwise(F.lit("")))
    return docs.select("doc_id", F.when(h % 10 == 0, planted).otherwise(F.col("text")).alias("text"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.periodic_runs(planted_runs(_table(spark, sf_dir, "documents")))
    more = lambda r, best: r["length"] * best["period"] > best["length"] * r["period"]
    best = F.aggregate("runs", F.get(F.col("runs"), 0), lambda best, r: F.when(more(r, best), r).otherwise(best))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))), "")
    shown = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    exponent = F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli")
    return shown.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent, "runs_sha256", "collapsed_sha256")


QUERIES = {f.__name__: f for f in (op1_ivfpq_search, op2_pitman_yor_score, op3_pii_weak_supervision, op4_host_quality, op5_chat_format, op6_retrieval_packing, op7_line_chunk_dedup, op8_weighted_mix, op9_simhash_ball, op10_secret_grammar, op11_importance_resample, op12_bin_completion, op13_periodic_runs, op7_passage_dedup, personal_data_base, secrets_base)}
#: Reads rows by turn as the contract has it; the formatted length follows from the template.
CHAT_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(role || text, '\', '\\'), '<|', '<\|')) + length('<|turn|><|text|><|end|>') AS n FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, text) FILTER (role = 'assistant'), '')) AS loss_sha256, sum(n)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""


def _base_sql(kinds: dict[str, tuple[str, str]], order: str) -> str:
    """Counts and digest of the matches ``m`` of each kind's pattern that pass its test.

    A match starts after what splitting leaves before it and the matches before.
    """
    parts = []
    for k, (name, (pattern, test)) in enumerate(kinds.items()):
        quoted = pattern.replace("'", "''")
        parts.append(f"""SELECT doc_id, {k} AS k, '{name}' AS kind, m, i, sum(length(g) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) - length(m) AS start FROM (
    SELECT doc_id, unnest(ms) AS m, unnest(gs[1:len(ms)]) AS g, generate_subscripts(ms, 1) AS i FROM (SELECT doc_id, regexp_extract_all(t, '{quoted}') AS ms, regexp_split_to_array(t, '{quoted}') AS gs FROM d)) QUALIFY {test.replace("PATTERN", quoted)}""")
    counts = ", ".join(f"count(*) FILTER (kind = '{name}') AS n_{name}" for name in kinds)
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(parts)})
SELECT d.doc_id, {counts}, sha256(coalesce(string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY {order}), '')) AS base_sha256
FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id
"""


_DIGITS = "regexp_replace(m, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(range(1, length({_DIGITS}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(reverse({_DIGITS}), i, 1)::INT ELSE (2 * substr(reverse({_DIGITS}), i, 1)::INT) // 10 + (2 * substr(reverse({_DIGITS}), i, 1)::INT) % 10 END)) % 10 = 0"
PERSONAL_SQL = _base_sql({
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(m, '.'), lambda x: length(ltrim(x, '0')) > 3 OR ('0' || right(x, 3))::INT > 255)) = 0"),
    "card": (r"[0-9](?:[ -]?[0-9])+", f"length({_DIGITS}) BETWEEN 13 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][ ().0-9-]+[0-9]", f"length({_DIGITS}) BETWEEN 9 AND 15"),
}, "k, start")
SECRETS_SQL = _base_sql({
    "assign": (r"""(?:(?i:password|passwd|secret|token|api_?key))["']? *[:=] *["']?[A-Za-z0-9+/_.=-]+""", r"""length(regexp_extract(m, '^(?:(?i:password|passwd|secret|token|api_?key))["'']? *[:=] *["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 8"""),
    "access": (r"AKIA[A-Z0-9]+", "length(m) >= 16"),
    "hex": (r"[0-9a-f]+", "length(m) >= 32"),
}, "start, k")

_HEX_BYTES = "list_transform(range(1, length(hex(s)) + 1, 2), lambda i: 16 * (strpos('0123456789ABCDEF', substr(hex(s), i, 1)) - 1) + strpos('0123456789ABCDEF', substr(hex(s), i + 1, 1)) - 1)"
#: Tables ``tab`` of the CRC's 256 steps, one list.
_CRC_TABLE = """tab AS (SELECT list(c ORDER BY i) AS steps FROM (SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) AS c FROM range(256) r(i)))"""
_CRC = f"xor(list_reduce({_HEX_BYTES}, lambda c, b: xor(steps[xor(c & 255, b) + 1], c >> 8), 4294967295), 4294967295)"
IMPORTANCE_SQL = rf"""
WITH {_CRC_TABLE},
given AS (SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT item_id, false, text FROM benchmark),
lists AS (SELECT doc_id, own, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM given),
tokens AS (SELECT doc_id, own, unnest(ws) AS s FROM lists),
vocabulary AS (SELECT s, {_CRC} % 10000 AS bucket FROM (SELECT DISTINCT s FROM tokens), tab),
hashed AS (SELECT doc_id, own, bucket FROM tokens JOIN vocabulary USING (s)),
sums AS (SELECT count(*) FILTER (own) AS s_all, count(*) FILTER (NOT own) AS t_all FROM hashed),
gain AS (SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))))::BIGINT AS gain FROM sums,
  (SELECT bucket, count(*) FILTER (own) AS s, count(*) FILTER (NOT own) AS t FROM hashed GROUP BY bucket)),
weights AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight FROM hashed JOIN gain USING (bucket) WHERE own GROUP BY doc_id),
digests AS (SELECT doc_id, upper(substr(sha256('2024:' || doc_id), 1, 8)) AS d FROM documents),
noise AS (SELECT doc_id, floor(-1000 * ln(-ln((list_sum(list_transform(range(1, 9), lambda i: (strpos('0123456789ABCDEF', substr(d, i, 1)) - 1) * (16 ** (8 - i)))) + 0.5) / 4294967296.0)))::BIGINT AS e FROM digests),
scored AS (SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + e AS score FROM noise LEFT JOIN weights USING (doc_id)),
drawn AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM scored WHERE n_features >= 20 QUALIFY rank <= count(*) OVER () * 10 // 100)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN drawn USING (doc_id)
"""
RUNS_SQL = rf"""
WITH {_CRC_TABLE},
digests AS (SELECT doc_id, {_CRC} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM (SELECT doc_id, text, doc_id::VARCHAR AS s FROM documents), tab),
placed AS (SELECT doc_id, ws, len(ws) AS n, h % 10 = 0 AND len(ws) > 0 AS planted, h // 10 AS g, (h // 10) % greatest(len(ws), 1) AS a FROM digests),
texts AS (SELECT doc_id, n, CASE WHEN planted THEN list_transform(range(n), lambda i: ws[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE ws END AS ws FROM placed),
w AS (SELECT doc_id, n, unnest(range(n)) AS i, unnest(ws) AS s FROM texts),
pairs AS (SELECT x.doc_id, y.i - x.i AS q, x.i FROM w x JOIN w y ON x.doc_id = y.doc_id AND x.s = y.s AND y.i > x.i AND 4 * (y.i - x.i) <= x.n),
stretches AS (SELECT doc_id, q, min(i) AS start, count(*) + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS k FROM pairs) GROUP BY doc_id, q, k),
runs AS (SELECT doc_id, start, length, min(q) AS period FROM stretches WHERE length >= greatest(6, 4 * q) GROUP BY doc_id, start, length),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
shown AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id),
best AS (SELECT doc_id, start, length, period, floor(1000 * length / period)::BIGINT AS exponent_milli FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length::DOUBLE / period DESC, start, period) = 1),
kept AS (SELECT doc_id, string_agg(s, ' ' ORDER BY i) AS t FROM w ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM texts LEFT JOIN shown USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
SQL = {"op11_importance_resample": IMPORTANCE_SQL, "op13_periodic_runs": RUNS_SQL, "personal_data_base": PERSONAL_SQL, "secrets_base": SECRETS_SQL, "op5_chat_format": CHAT_SQL, "op4_host_quality": host_rules.SQL, "op7_line_chunk_dedup": line_dedup.SQL, "op8_weighted_mix": mixing.SQL}
