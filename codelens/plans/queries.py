"""Registered queries over the given tables, and the same in SQL for DuckDB.

The fixtures are derived from the tables: every sentence of ``documents`` is a possible quote, every second
one coded by the human and every third by the model; ``lineitem`` gives comparison rows without quotes.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import extract_instances, extract_matches, first_success, validate_responses
from ..functions.spans import find_quote, find_quotes, parse_range, parse_span, span_overlap
from ..functions.text import BLANKS, FIRST_PERSON, STOP_WORDS, document_metrics, sentences, tokens
from ..operators import codebook as cb
from ..operators import corpus, display, matching, metrics
from ..operators.location import locate_quotes
from ..schemas import CODEBOOK, COMPARISON, METADATA, METRICS
from ..scratch import folder, materialise
from ..sources.codings import human_codings, read_errors, read_human_coding, read_results, read_run_results, read_runs
from ..sources.documents import join_turns, rows_as_documents, suffix_duplicates, transcript_line
from ..sources.sinks import nested_results, run_path, run_summary, write_codebook, write_ordered, write_run
from .coding import code_rows, lexicon_coder, retry_run
from .coding import compare_by_matcher as match_groups
from .comparison import compare_directories, compare_runs

# ---------------------------------------------------------------- fixtures


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sentence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return docs.select("doc_id", "text", F.posexplode(sentences(F.col("text"))).alias("pos", "quote"))


def codings(spark: SparkSession, sf_dir: str, once: bool = False, places: bool = True) -> tuple[DataFrame, DataFrame]:
    """The human's and the model's quotes; ``once`` writes them, for queries that read them more than once.

    Without ``places``, for queries that show none, quotes have none.
    """
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", sentences(F.col("text")).alias("quotes"))
    found = find_quotes(F.col("text"), F.col("quotes")) if places else F.lit(None).cast("array<string>")
    rows = docs.select("doc_id", "quotes", found.alias("places")).select("doc_id", F.posexplode("quotes").alias("pos", "quote"), "places")
    n = F.length("quote")
    built = rows.select("doc_id", F.concat(F.lit("c"), n % 4).alias("construct"), F.col("pos").alias("ord"), F.lit(None).cast("string").alias("speaker_id"), "quote", F.get("places", F.col("pos")).alias("quote_index"), (n % 3).alias("confidence"))
    built = materialise(built.where("ord % 2 = 0 OR ord % 3 = 0"), "codings") if once else built
    human = built.where("ord % 2 = 0").withColumn("confidence", F.lit(None).cast("int"))
    return human, built.where("ord % 3 = 0")


S = """
 s0 AS (SELECT doc_id::VARCHAR AS doc_id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?]+(\\s+|$)'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '') AS l FROM documents),
 s AS (SELECT doc_id, text, unnest(l) AS quote, generate_subscripts(l, 1) - 1 AS pos FROM s0),
 i AS (SELECT doc_id, 'c' || (length(quote) % 4)::VARCHAR AS construct, pos AS ord, quote, (instr(text, quote) - 1)::VARCHAR || ':' || (instr(text, quote) - 1 + length(quote))::VARCHAR AS quote_index, (length(quote) % 3)::INT AS confidence FROM s),
 h AS (SELECT * REPLACE (NULL::INT AS confidence) FROM i WHERE ord % 2 = 0),
 m AS (SELECT * FROM i WHERE ord % 3 = 0)"""
X = S + """,
 hk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, construct, quote ORDER BY ord) AS k FROM h),
 mk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, construct, quote ORDER BY ord) AS k FROM m),
 c AS (SELECT coalesce(h.doc_id, m.doc_id) AS doc_id, coalesce(h.construct, m.construct) AS construct,
   CASE WHEN h.quote IS NOT NULL AND m.quote IS NOT NULL THEN 'matched' WHEN h.quote IS NOT NULL THEN 'human_only' ELSE 'llm_only' END AS status,
   h.quote AS human_quote, m.quote AS llm_quote, h.quote_index AS human_indices, m.quote_index AS llm_indices, h.confidence AS human_confidence, m.confidence AS llm_confidence,
   CASE WHEN h.quote IS NOT NULL AND m.quote IS NOT NULL THEN false END AS paraphrase, CASE WHEN h.quote IS NOT NULL AND m.quote IS NOT NULL THEN 1.0 END AS span_overlap,
   CASE WHEN h.quote IS NOT NULL AND m.quote IS NOT NULL THEN 1.0 END AS match_confidence,
   (h.quote IS NOT NULL AND m.quote IS NOT NULL)::INT AS tp, (h.quote IS NULL)::INT AS fp, (m.quote IS NULL)::INT AS fn
  FROM hk h FULL JOIN mk m ON h.doc_id = m.doc_id AND h.construct = m.construct AND h.quote = m.quote AND h.k = m.k)"""


def exact(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    return matching.compare_exact(*codings(spark, sf_dir, places=places))


def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Comparison rows without quotes, from ``lineitem``."""
    rows = table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_linenumber") % 3 == 0, F.lit("matched")).when(F.col("l_linenumber") % 3 == 1, F.lit("human_only")).otherwise(F.lit("llm_only"))
    out = rows.select((F.col("l_orderkey") % 50).cast("string").alias("doc_id"), F.col("l_returnflag").alias("construct"), status.alias("status"), (F.floor("l_quantity") % 3).cast("int").alias("c"))
    is_ = lambda s: (F.col("status") == s).cast("int")
    return out.select("doc_id", "construct", "status", F.when(F.col("status") != "human_only", F.col("c")).alias("llm_confidence"), is_("matched").alias("tp"), is_("llm_only").alias("fp"), is_("human_only").alias("fn"))


R = """
 r0 AS (SELECT (l_orderkey % 50)::VARCHAR AS doc_id, l_returnflag AS construct, CASE l_linenumber % 3 WHEN 0 THEN 'matched' WHEN 1 THEN 'human_only' ELSE 'llm_only' END AS status, (floor(l_quantity)::BIGINT % 3)::INT AS c FROM lineitem),
 r AS (SELECT doc_id, construct, status, CASE WHEN status <> 'human_only' THEN c END AS llm_confidence, (status = 'matched')::INT AS tp, (status = 'llm_only')::INT AS fp, (status = 'human_only')::INT AS fn FROM r0)"""


def _metrics_sql(source: str) -> str:
    return f"""SELECT *, CASE WHEN tp + fn > 0 THEN tp / (tp + fn)::DOUBLE END AS sensitivity, CASE WHEN tp + fp > 0 THEN tp / (tp + fp)::DOUBLE END AS precision,
      CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn)::DOUBLE END AS f1, CASE WHEN tp + fp + fn > 0 THEN 2 * (tp / (tp + fp + fn)::DOUBLE) - 1 END AS pabak, tp + fp + fn AS "union" FROM {source}"""


def _auc_sql(keys: str) -> str:
    by, part = (f"{keys}, llm_confidence", f"PARTITION BY {keys}") if keys else ("llm_confidence", "")
    lead = f"{keys}, " if keys else ""
    group = f"GROUP BY {keys}" if keys else "HAVING count(*) > 0"
    return f"""SELECT {lead}round_even(sum(t / p::DOUBLE * ct / cn), 4) AS pr_auc FROM (SELECT *, sum(t) OVER (w ORDER BY llm_confidence DESC) AS ct, sum(n) OVER (w ORDER BY llm_confidence DESC) AS cn, sum(t) OVER w AS p, sum(n) OVER w AS a
      FROM (SELECT {by}, sum((status = 'matched')::INT) AS t, count(*) AS n FROM r WHERE status <> 'human_only' AND llm_confidence IS NOT NULL GROUP BY {by}) WINDOW w AS ({part})) WHERE p > 0 AND p < a {group}"""


_SUMS = "sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn"
PER_DOC = R + f""",
 d0 AS (SELECT doc_id, construct, {_SUMS} FROM r GROUP BY ALL), d1 AS ({_metrics_sql('d0')}), da AS ({_auc_sql('doc_id, construct')}),
 d AS (SELECT d1.*, da.pr_auc FROM d1 LEFT JOIN da USING (doc_id, construct)),
 k AS (SELECT count(DISTINCT doc_id) AS docs, count(DISTINCT construct) AS cons FROM d),
 grid AS (SELECT a.doc_id, b.construct, coalesce(d."union", 0) AS u FROM (SELECT DISTINCT doc_id FROM d) a CROSS JOIN (SELECT DISTINCT construct FROM d) b LEFT JOIN d USING (doc_id, construct)),
 st AS (SELECT false AS is_overall, construct, (SELECT count(*) FROM d x WHERE x.construct = grid.construct) AS n_docs, round_even(quantile_cont(u, 0.05), 2) AS p5, round_even(quantile_cont(u, 0.95), 2) AS p95 FROM grid GROUP BY construct
   UNION ALL SELECT true, 'Overall', (SELECT docs FROM k), round_even(quantile_cont(u, 0.05), 2), round_even(quantile_cont(u, 0.95), 2) FROM grid)"""
_ROUNDED = ", ".join(f"round_even({m}, 4) AS {m}" for m in METRICS)
POOLED = PER_DOC + f""",
 p0 AS (SELECT false AS is_overall, construct, {_SUMS} FROM r GROUP BY construct UNION ALL SELECT true, 'Overall', {_SUMS} FROM r), p1 AS ({_metrics_sql('p0')}),
 pa AS (SELECT false AS is_overall, construct, pr_auc FROM ({_auc_sql('construct')}) UNION ALL SELECT true, 'Overall', pr_auc FROM ({_auc_sql('')})),
 p AS (SELECT is_overall, construct, tp, fp, fn, "union", {_ROUNDED}, n_docs, p5, p95, pr_auc FROM p1 JOIN st USING (is_overall, construct) LEFT JOIN pa USING (is_overall, construct))"""
_ALL = [*METRICS, "pr_auc"]
WEIGHTED = PER_DOC + f""",
 w0 AS (SELECT false AS is_overall, * FROM d UNION ALL SELECT true, * REPLACE ('Overall' AS construct) FROM d),
 w1 AS (SELECT is_overall, construct, "union" AS w, metric, value FROM (UNPIVOT w0 ON {', '.join(_ALL)} INTO NAME metric VALUE value) WHERE "union" > 0),
 w2 AS (SELECT *, sum(w) OVER (PARTITION BY is_overall, construct, metric ORDER BY value) AS cum, sum(w) OVER (PARTITION BY is_overall, construct, metric) AS tot FROM w1),
 w3 AS (SELECT is_overall, construct, metric, round_even(min(value) FILTER (2 * cum >= tot), 4) AS med, round_even(min(value), 4) AS mn, round_even(max(value), 4) AS mx FROM w2 GROUP BY ALL),
 w4 AS (SELECT is_overall, construct, {', '.join(f"max(med) FILTER (metric = '{m}') AS {m}_median, max(mn) FILTER (metric = '{m}') AS {m}_min, max(mx) FILTER (metric = '{m}') AS {m}_max" for m in _ALL)} FROM w3 GROUP BY ALL),
 w5 AS (SELECT is_overall, construct, {_SUMS} FROM w0 GROUP BY ALL),
 wt AS (SELECT * FROM w5 LEFT JOIN w4 USING (is_overall, construct) LEFT JOIN st USING (is_overall, construct))"""

#: Codebook of the fixtures' constructs; ``c3`` is not in it.
BOOK = "SELECT construct, ord::INT AS ord, definition, examples, counter_examples FROM (VALUES ('c0', 0, 'zero', ['first example'], []::VARCHAR[]), ('c1', 1, 'one', []::VARCHAR[], ['not this']), ('c2', 2, 'two', []::VARCHAR[], []::VARCHAR[])) b(construct, ord, definition, examples, counter_examples)"


def book(spark: SparkSession) -> DataFrame:
    rows = [("c0", 0, "zero", ["first example"], [], {}), ("c1", 1, "one", [], ["not this"], {}), ("c2", 2, "two", [], [], {})]
    return spark.createDataFrame(rows, "construct string, ord int, definition string, examples array<string>, counter_examples array<string>, extra map<string,string>")


def _mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([("c0", "zero"), ("c2", "two"), ("c9", "nine")], "old string, new string")


MAPPING = "(VALUES ('c0', 'zero'), ('c2', 'two'), ('c9', 'nine')) t(old, new)"

# ---------------------------------------------------------------- queries

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


@query(f"WITH {S} SELECT doc_id, pos, quote AS sentence FROM s")
def sentence_split(spark, sf_dir):
    return sentence_rows(spark, sf_dir).select("doc_id", "pos", F.col("quote").alias("sentence"))


@query(f"WITH {S} SELECT doc_id, construct, CASE WHEN length(quote) > 40 THEN substr(quote, 1, 37) || '...' ELSE quote END AS quote, NULL::VARCHAR AS speaker_id, quote_index, confidence FROM m")
def coding_table(spark, sf_dir):
    return display.coding_table(codings(spark, sf_dir)[1], 40)


@query(f"WITH {S} SELECT doc_id, CASE WHEN length(quote) > 13 THEN substr(quote, 1, 10) || '...' ELSE quote END AS short FROM s")
def quote_truncate(spark, sf_dir):
    return sentence_rows(spark, sf_dir).select("doc_id", display.truncate(F.col("quote"), 13).alias("short"))


@query("SELECT d.doc_id, b.item_id, (instr(d.text, b.text) - 1)::VARCHAR || ':' || (instr(d.text, b.text) - 1 + length(b.text))::VARCHAR AS quote_index FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def quote_index_exact(spark, sf_dir):
    """Where benchmark passages stand in documents."""
    return locate_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("quote")))


def locate_passages(docs: DataFrame, passages: DataFrame, block: int = 1024) -> DataFrame:
    """``(doc_id, item_id, quote_index)`` of each of ``passages(item_id, quote)`` in each document that holds it.

    Candidates share the passage's second to fourth words, or those of them that it has, since they are whole
    words of any text that holds it.  Passages of fewer than three words have none; they are sought in all
    texts, a block of them at a time.  Null and empty passages are nowhere.
    """
    docs = docs.select("doc_id", "text")
    words = passages.where("quote <> ''").withColumn("w", F.split("quote", r"[ \n]")).withColumn("n", F.least(F.lit(3), F.size("w") - 2))
    items, short = words.where("n > 0"), words.where("n <= 0").select("item_id", "quote")
    sizes = [r.n for r in items.select("n").distinct().collect()]  # of 1, 2 and 3
    key = lambda i, n: F.xxhash64(*[F.get("w", i + k) for k in range(n)])
    grams = [F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - n, F.lit(0))), lambda i: key(i, n)) for n in sizes]  # noqa: B023
    keyed = docs.select("doc_id", F.split("text", r"[ \n]").alias("w")).select("doc_id", F.explode(F.array_distinct(F.concat(F.array().cast("array<bigint>"), *grams))).alias("k"))
    wanted = items.select("item_id", "quote", F.coalesce(*[F.when(F.col("n") == n, key(F.lit(1), n)) for n in sizes], F.lit(None).cast("bigint")).alias("k"))
    pairs = keyed.join(wanted, "k").select("doc_id", "item_id", "quote").distinct()
    found = pairs.join(docs, "doc_id")
    blocks = -(-short.count() // block)
    for k in range(blocks):
        found = found.unionByName(docs.join(short.where(F.pmod(F.xxhash64("item_id", "quote"), F.lit(blocks)) == k), F.contains("text", "quote")).select(*found.columns))
    return found.withColumn("quote_index", find_quote(F.col("text"), F.col("quote"))).where("quote_index IS NOT NULL").select("doc_id", "item_id", "quote_index")


@query()
def quote_index_fuzzy(spark, sf_dir):
    """Every sentence without its fifth letter, located in its whole document."""
    docs = table(spark, sf_dir, "documents")
    wrong = F.transform(sentences(F.col("text")), lambda q: F.concat(F.substring(q, 1, 4), F.substring(q, 6, 1 << 30)))
    found = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", wrong.alias("quotes")).select("doc_id", "quotes", find_quotes(F.col("text"), F.col("quotes")).alias("places"))
    rows = found.select("doc_id", F.posexplode("quotes").alias("pos", "quote"), "places")
    return locate_quotes(rows.select("doc_id", "pos", "quote", F.get("places", F.col("pos")).alias("quote_index")), 0.85, docs).select("doc_id", "pos", "quote", "quote_index")


@query("SELECT conv_id, string_agg(coalesce(nullif(trim(role), '') || ': ', '') || trim(text, ' ' || chr(9) || chr(10) || chr(13)), chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def transcript_from_turns(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("speaker"), "text")
    return join_turns(rows.withColumn("line", transcript_line(["speaker", "text"])), ["conv_id"], "turn")


@query("SELECT doc_id, CASE WHEN n > 1 THEN source || '_' || n ELSE source END AS document FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS n FROM documents)")
def duplicate_doc_ids(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document"))
    return suffix_duplicates(rows, "document", "doc_id")


@query("SELECT (row_number() OVER (ORDER BY doc_id DESC) - 1)::VARCHAR AS doc_id, row_number() OVER (ORDER BY doc_id DESC) - 1 AS pos, text FROM documents")
def rows_without_ids(spark, sf_dir):
    """Documents from the last to the first, which have no ids but their places."""
    rows = table(spark, sf_dir, "documents").select("text", (-F.col("doc_id")).alias("turned"))
    return rows_as_documents(rows, "text", order="turned")


_EXCERPTS = "SELECT doc_id::VARCHAR AS doc_id, trim(c) AS construct, 'q' || n_chars AS quote, (n_chars % 90)::VARCHAR || ':' || (n_chars % 97)::VARCHAR AS quote_index FROM (SELECT *, unnest(string_split(source || ', ' || lang || ',, x ', ',')) AS c FROM documents WHERE n_chars % 5 <> 0) WHERE trim(c) <> ''"


def _excerpts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", F.when(F.col("n_chars") % 5 != 0, F.concat(F.lit(" q"), "n_chars", F.lit(" "))).alias("excerpt"), F.concat(F.col("n_chars") % 90, F.lit(" - "), F.col("n_chars") % 97).alias("range"), F.concat("source", F.lit(", "), "lang", F.lit(",, x ")).alias("codes"))
    return rows


@query(_EXCERPTS)
def human_codes_explode(spark, sf_dir):
    return human_codings(_excerpts(spark, sf_dir), "doc_id", "excerpt", "codes", "range")[0].select("doc_id", "construct", "quote", "quote_index")


@query(_EXCERPTS)
def human_coding_file(spark, sf_dir):
    """Coded excerpts that were written as a tab-separated table, and read from there."""
    path = f"{folder(spark)}/excerpts-{uuid.uuid4().hex}.tsv"
    _excerpts(spark, sf_dir).write.csv(path, sep="\t", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    found, _ = read_human_coding(spark, path, {"ignoreLeadingWhiteSpace": "false"}, doc_id_col="doc_id", quote_col="excerpt", construct_col="codes", range_col="range")
    return found.select("doc_id", "construct", "quote", "quote_index")


_RANGE = "CASE doc_id % 5 WHEN 0 THEN doc_id || '-' || n_chars WHEN 1 THEN ' ' || doc_id || ' - +' || n_chars WHEN 2 THEN doc_id || '-x' WHEN 3 THEN doc_id || '-1-2' ELSE '' END"


@query("SELECT doc_id, CASE WHEN doc_id % 5 < 2 THEN doc_id || ':' || n_chars END AS parsed FROM documents")
def range_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.expr(_RANGE).alias("r"))
    return rows.select("doc_id", parse_range(F.col("r")).alias("parsed"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey % 40 AS a, l_partkey % 40 + l_suppkey % 12 AS b, l_suppkey % 45 AS c, l_suppkey % 45 + l_partkey % 10 AS d FROM lineitem),
 y AS (SELECT *, greatest(0, least(b, d) - greatest(a, c)) AS o FROM x)
 SELECT l_orderkey, l_linenumber, CASE WHEN a = b AND c = d THEN 1.0 WHEN a = b OR c = d THEN 0.0 ELSE o / (b - a + d - c - o)::DOUBLE END AS overlap FROM y""")
def span_overlaps(spark, sf_dir):
    a, c = F.col("l_partkey") % 40, F.col("l_suppkey") % 45
    x = parse_span(F.concat(a, F.lit(":"), a + F.col("l_suppkey") % 12))
    y = parse_span(F.concat(c, F.lit(":"), c + F.col("l_partkey") % 10))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", span_overlap(x, y).alias("overlap"))


@query(f"WITH {S} SELECT doc_id, ord, coalesce(t.new, h.construct) AS construct FROM h LEFT JOIN {MAPPING} ON t.old = h.construct")
def construct_mapping(spark, sf_dir):
    return cb.rename_constructs(codings(spark, sf_dir, places=False)[0], _mapping(spark)).select("doc_id", "ord", "construct")


@query(f"WITH {S} SELECT DISTINCT old FROM {MAPPING} WHERE old NOT IN (SELECT construct FROM h)")
def unused_mapping_keys(spark, sf_dir):
    return cb.unused_mapping(codings(spark, sf_dir, places=False)[0], _mapping(spark))


@query(f"WITH {S}, b AS ({BOOK}) SELECT DISTINCT construct FROM h WHERE construct NOT IN (SELECT construct FROM b)")
def validate_constructs(spark, sf_dir):
    return cb.unknown_constructs(codings(spark, sf_dir, places=False)[0], book(spark))


@query(f"WITH {S}, b AS ({BOOK}) SELECT doc_id, ord, construct, quote FROM h WHERE construct IN (SELECT construct FROM b)")
def filter_constructs(spark, sf_dir):
    return cb.only_constructs(codings(spark, sf_dir, places=False)[0], book(spark)).select("doc_id", "ord", "construct", "quote")


#: Responses by ``doc_id``: two good items, no JSON, no list, items that are dropped, coerced confidences, defaults.
_RESPONSE = """CASE doc_id % 6
 WHEN 0 THEN concat('{"instances":[{"construct":"a","speaker_id":null,"quote":"', regexp_replace(substr(text, 9, 12), '[^a-zA-Z ]', ''), '","confidence":2},{"construct":"b","quote":"","confidence":0}]}')
 WHEN 1 THEN '{"instances": [' WHEN 2 THEN '{"other": 1}'
 WHEN 3 THEN '{"instances":[3,{"construct":null,"quote":"x"},{"construct":"a","quote":"x","confidence":5},{"construct":"a","quote":"x","confidence":null},{"construct":"a","speaker_id":7,"quote":"x"},{"construct":"ok","speaker_id":"s","quote":"x","confidence":1}]}'
 WHEN 4 THEN '{"instances":[{"construct":"a","quote":"x","confidence":"2"},{"construct":"b","quote":"x","confidence":2.7},{"construct":"c","quote":"x","confidence":true},{"construct":"d","quote":"x","confidence":"2.5"}]}'
 ELSE '{"instances":[{"speaker_id":"s"}]}' END"""


@query("""WITH e AS (SELECT doc_id % 6 AS k, * FROM documents), x AS (
 SELECT doc_id, 'a' AS construct, 0 AS ord, NULL AS speaker_id, regexp_replace(substr(text, 9, 12), '[^a-zA-Z ]', '', 'g') AS quote, 2 AS confidence, text FROM e WHERE k = 0 UNION ALL SELECT doc_id, 'b', 1, NULL, '', 0, text FROM e WHERE k = 0
 UNION ALL SELECT doc_id, 'ok', 5, 's', 'x', 1, text FROM e WHERE k = 3 UNION ALL SELECT doc_id, unnest(['a', 'b', 'c']), unnest([0, 1, 2]), NULL, 'x', unnest([2, 2, 1]), text FROM e WHERE k = 4
 UNION ALL SELECT doc_id, 'Unknown', 0, 's', '', 1, text FROM e WHERE k = 5)
 SELECT doc_id::VARCHAR AS doc_id, construct, ord, speaker_id, quote, CASE WHEN quote <> '' AND contains(text, quote) THEN (instr(text, quote) - 1)::VARCHAR || ':' || (instr(text, quote) - 1 + length(quote))::VARCHAR END AS quote_index, confidence FROM x""")
def response_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.expr(_RESPONSE).alias("response_text"))
    return extract_instances(validate_responses(rows))


def _attempts(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.col("doc_id").alias("n"))
    rows = docs.withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(2))))
    good = (F.col("n") + F.col("attempt")) % 4 == 3
    return validate_responses(rows.withColumn("response_text", F.when(good, F.lit('{"instances": []}')).when(F.col("attempt") == 1, F.lit("nonsense")).otherwise(F.lit("[]"))))


_TRIES = "t AS (SELECT doc_id, doc_id % 4 AS k FROM documents), o AS (SELECT doc_id::VARCHAR AS doc_id, CASE WHEN k = 0 THEN 2 ELSE 3 - k END AS num_retries, CASE WHEN k = 0 THEN 'Failed after 3 attempts: Not an object' END AS error_message FROM t)"


@query(f"WITH {_TRIES} SELECT * FROM o")
def first_success_attempt(spark, sf_dir):
    return first_success(_attempts(spark, sf_dir).drop("n")).select("doc_id", "num_retries", "error_message")


@query(f"WITH {_TRIES} SELECT o.doc_id, d.text FROM o JOIN documents d ON o.doc_id = d.doc_id::VARCHAR WHERE error_message IS NOT NULL")
def retry_set(spark, sf_dir):
    failed = first_success_attempt(spark, sf_dir).where("error_message IS NOT NULL")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return docs.join(failed, "doc_id", "left_semi")


@query(f"WITH {_TRIES} SELECT 'run' AS run_id, 'model' AS model, 'book' AS codebook, 'documents' AS input, count(*) AS total, count(*) FILTER (error_message IS NULL) AS successful, count(error_message) AS failed FROM o")
def run_outcomes(spark, sf_dir):
    return run_summary(first_success_attempt(spark, sf_dir), "run", "model", "book", "documents")


@query(f"WITH {X} SELECT * FROM c")
def compare_exact(spark, sf_dir):
    return exact(spark, sf_dir)


def _saved(spark, instances):
    """A run with the instances' results, as a coding run writes them."""
    name = f"run-{uuid.uuid4().hex}"
    write_run(nested_results(instances, instances.select("doc_id")), folder(spark), "encodings", name)
    return run_path(folder(spark), "encodings", name)


@query(f"WITH {S} SELECT doc_id, construct, row_number() OVER (PARTITION BY doc_id ORDER BY ord) - 1 AS ord, NULL::VARCHAR AS speaker_id, quote, quote_index, confidence FROM m")
def saved_results(spark, sf_dir):
    """Results that were written as a run and read again."""
    return read_results(spark, _saved(spark, codings(spark, sf_dir)[1]))[0]


@query(f"WITH {X} SELECT * FROM c")
def compare_saved_runs(spark, sf_dir):
    """Two runs that were written, compared by their folders."""
    human, llm = codings(spark, sf_dir)
    return compare_directories(spark, _saved(spark, human), _saved(spark, llm))


@query(f"WITH {X} SELECT * FROM c")
def comparison_file(spark, sf_dir):
    """Comparison rows that were written in order as CSV parts, and read from there."""
    root = f"{folder(spark)}/compared-{uuid.uuid4().hex}"
    rows = materialise(exact(spark, sf_dir), "comparison")
    path = write_ordered(matching.ordered(rows), root, "comparison", "once")
    return spark.read.schema(COMPARISON).csv(path, header=True, multiLine=True, escape='"')


#: Phrases of a codebook for the lexicon coder; some stand in many documents, one in none.
_PHRASES = {"small words": ["is the", "of a", "de la", "und die"], "none": ["no such words here"]}


@query("""WITH p AS (SELECT unnest(['is the', 'of a', 'de la', 'und die']) AS quote, unnest([0, 1, 2, 3]) AS k)
 SELECT doc_id::VARCHAR AS doc_id, 'small words' AS construct, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS ord, NULL::VARCHAR AS speaker_id, quote,
  (instr(text, quote) - 1)::VARCHAR || ':' || (instr(text, quote) - 1 + length(quote))::VARCHAR AS quote_index, 2 AS confidence FROM documents JOIN p ON contains(text, quote)""")
def coded_run(spark, sf_dir):
    """Documents coded from a codebook file by a coder that finds its example phrases, the run written and read again."""
    root = folder(spark)
    rows = [(c, i, None, phrases, None, None) for i, (c, phrases) in enumerate(_PHRASES.items())]
    path = write_codebook(spark.createDataFrame(rows, CODEBOOK), cb.Meta("small"), f"{root}/book-{uuid.uuid4().hex}.json")
    _, name = code_rows(table(spark, sf_dir, "documents"), "text", path, lexicon_coder(list(_PHRASES.items())), root, "doc_id", name=f"coded-{uuid.uuid4().hex}")
    return read_results(spark, run_path(root, "encodings", name))[0]


#: A coder that fails by what a text holds: it raises, answers without a list, or answers no JSON.
_FAULTS = {"is the": "down", "of a": "No list of instances", "de la": "Not an object"}


def _faulty(faults: list[str]):
    def make():
        good = lexicon_coder(list(_PHRASES.items()))()

        def code(prompt: str) -> str:
            text = prompt.partition("\nText:\n")[2]
            kind = next((k for k in faults if k in text), None)
            if kind == "is the":
                raise RuntimeError("down")
            return {"of a": '{"other": 1}', "de la": "[]"}[kind] if kind else good(prompt)

        return code

    return make


def _faulty_run(spark, sf_dir) -> tuple[str, str, str]:
    """Root, name and codebook of a written run of the faulty coder."""
    root = f"{folder(spark)}/faulty-{uuid.uuid4().hex}"
    rows = [(c, i, None, phrases, None, None) for i, (c, phrases) in enumerate(_PHRASES.items())]
    path = write_codebook(spark.createDataFrame(rows, CODEBOOK), cb.Meta("small"), f"{root}/book.json")
    docs = table(spark, sf_dir, "documents").withColumn("text", F.when(F.col("doc_id") % 7 != 0, F.col("text")))
    _, name = code_rows(docs, "text", path, _faulty(list(_FAULTS)), root, "doc_id", name="run", model="lexicon", retries=1)
    return root, name, path


_FAULT = "CASE WHEN doc_id % 7 = 0 THEN 'No text' " + " ".join(f"WHEN contains(text, '{k}') THEN 'Failed after 2 attempts: {e}'" for k, e in _FAULTS.items()) + " END"


@query(f"SELECT * FROM (SELECT doc_id::VARCHAR AS doc_id, {_FAULT} AS error_message, 'lexicon' AS model_used FROM documents) WHERE error_message IS NOT NULL")
def run_errors(spark, sf_dir):
    """The errors that a run wrote, after its attempts, as they are read again."""
    root, name, _ = _faulty_run(spark, sf_dir)
    return read_errors(spark, root, name).select("doc_id", "error_message", "model_used")


@query(f"""SELECT doc_id::VARCHAR AS doc_id, 'lexicon' AS model, CASE WHEN e LIKE 'Failed%' THEN 1 ELSE 0 END AS num_retries, e AS error_message,
  CASE WHEN e LIKE '%: down' THEN 'RuntimeError' WHEN e IS NOT NULL THEN 'ValueError' END AS error_type,
  CASE WHEN e LIKE '%: down' THEN 'down' WHEN e LIKE '%No list%' THEN '{{"other": 1}}' WHEN e LIKE '%Not an%' THEN '[]' ELSE e END AS error_output FROM (SELECT doc_id, {_FAULT} AS e FROM documents)""")
def run_metadata(spark, sf_dir):
    """What a run wrote of each document's last response."""
    root, name, _ = _faulty_run(spark, sf_dir)
    rows = read_runs(spark, root, "metadata", METADATA, [name])
    return rows.select("doc_id", "model", "num_retries", "error_message", "error_type", "error_output")


@query(f"""WITH f AS (SELECT doc_id::VARCHAR AS doc_id, text, {_FAULT} AS first FROM documents),
 s AS (SELECT *, CASE WHEN first = 'No text' OR contains(text, 'is the') THEN replace(first, '2 attempts', '1 attempts') END AS error_message FROM f)
 SELECT doc_id, error_message, CASE WHEN error_message IS NULL THEN (SELECT count(*) FROM (VALUES ('of a'), ('de la'), ('und die')) p(q) WHERE contains(s.text, q)) ELSE 0 END AS n FROM s""")
def retried_run(spark, sf_dir):
    """A saved run whose failures were coded again by a coder with one fault left: each document's error, or instances."""
    root, name, path = _faulty_run(spark, sf_dir)
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.when(F.col("doc_id") % 7 != 0, F.col("text")).alias("text"))
    _, left = retry_run(docs, root, name, path, _faulty(["is the"]))
    found = read_run_results(spark, root, [name]).groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.select("doc_id").join(left.select("doc_id", "error_message"), "doc_id", "left").join(found, "doc_id", "left").select("doc_id", "error_message", F.coalesce("n", F.lit(0)).alias("n"))


@query(f"""WITH {S}, hk AS (SELECT *, row_number() OVER (PARTITION BY doc_id, construct, quote ORDER BY ord) AS k FROM h),
 r AS (SELECT *, unnest(CASE WHEN ord % 3 = 0 AND ord % 5 = 0 THEN ['third', 'fifth'] WHEN ord % 3 = 0 THEN ['third'] WHEN ord % 5 = 0 THEN ['fifth'] ELSE [] END) AS run_id FROM i),
 rk AS (SELECT *, row_number() OVER (PARTITION BY run_id, doc_id, construct, quote ORDER BY ord) AS k FROM r),
 n AS (SELECT run_id, construct, count(*) AS tp FROM rk JOIN hk USING (doc_id, construct, quote, k) GROUP BY ALL),
 a AS (SELECT run_id, construct, count(*) AS m FROM rk GROUP BY ALL), b AS (SELECT construct, count(*) AS h FROM hk GROUP BY ALL),
 g AS (SELECT run_id, construct FROM (VALUES ('third'), ('fifth')) v(run_id), (SELECT construct FROM a UNION SELECT construct FROM b))
 SELECT run_id, construct, coalesce(tp, 0)::BIGINT AS tp, (coalesce(m, 0) - coalesce(tp, 0))::BIGINT AS fp, (coalesce(h, 0) - coalesce(tp, 0))::BIGINT AS fn FROM g LEFT JOIN n USING (run_id, construct) LEFT JOIN a USING (run_id, construct) LEFT JOIN b USING (construct)""")
def runs_compared(spark, sf_dir):
    """Two of three saved runs, read as partitions of one table, each against the human coding."""
    rows, root = sentence_rows(spark, sf_dir), f"{folder(spark)}/runs-{uuid.uuid4().hex}"
    n = F.length("quote")
    built = rows.select("doc_id", F.concat(F.lit("c"), n % 4).alias("construct"), F.col("pos").alias("ord"), F.lit(None).cast("string").alias("speaker_id"), "quote", F.lit(None).cast("string").alias("quote_index"), (n % 3).alias("confidence"))
    built = materialise(built.where("ord % 2 = 0 OR ord % 3 = 0 OR ord % 5 = 0"), "codings")  # read by all three runs and the human coding
    for name, step in (("third", 3), ("fifth", 5), ("other", 2)):
        some = built.where(F.col("ord") % step == 0)
        write_run(nested_results(some, some.select("doc_id")), root, "encodings", name)
    human = built.where("ord % 2 = 0").withColumn("confidence", F.lit(None).cast("int"))
    out = compare_runs(human, read_run_results(spark, root, ["third", "fifth"]), ["third", "fifth"])
    return out.groupBy("run_id", "construct").agg(*[F.sum(c).cast("long").alias(c) for c in ("tp", "fp", "fn")])


_BY_PLACE = f"""WITH {S}, hn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, construct ORDER BY ord) - 1 AS x FROM h), mn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, construct ORDER BY ord) - 1 AS x FROM m)
 SELECT coalesce(hn.doc_id, mn.doc_id) AS doc_id, coalesce(hn.construct, mn.construct) AS construct, hn.quote AS human_quote, mn.quote AS llm_quote,
  CASE WHEN mn.x IS NULL THEN 'human_only' WHEN hn.x IS NULL THEN 'llm_only' ELSE 'matched' END AS status FROM hn FULL JOIN mn ON hn.doc_id = mn.doc_id AND hn.construct = mn.construct AND hn.x = mn.x"""


@query(_BY_PLACE)
def compare_greedy(spark, sf_dir):
    """Pairs by proposals that name the k-th quotes of both sides, after one that is out of range and with repeats."""
    human, llm = codings(spark, sf_dir, once=True)
    sizes = lambda side, name: side.groupBy("doc_id", "construct").agg(F.count("*").cast("int").alias(name))
    both = sizes(human, "h").join(sizes(llm, "m"), ["doc_id", "construct"])
    good = F.transform(F.sequence(F.lit(1), F.least("h", "m")), lambda i: F.struct((2 * i).alias("ord"), (i - 1).alias("human_index"), (i - 1).alias("llm_index")))
    again = F.transform(F.sequence(F.lit(1), F.least("h", "m")), lambda i: F.struct((2 * i + 1).alias("ord"), (i - 1).alias("human_index"), i.alias("llm_index")))
    wild = F.array(F.struct(F.lit(0).alias("ord"), F.lit(-1).alias("human_index"), F.lit(0).alias("llm_index")), F.struct(F.lit(1).alias("ord"), F.col("h").alias("human_index"), F.lit(0).alias("llm_index")))
    rows = both.select("doc_id", "construct", F.inline(F.concat(wild, good, again)))
    out = matching.compare(human, llm, rows.withColumns({"paraphrase": F.lit(False), "match_confidence": F.lit(0.9)}))
    return out.select("doc_id", "construct", "human_quote", "llm_quote", "status")


def _by_place():
    """A matcher that pairs quotes of the same number."""

    def match(prompt: str) -> str:
        human, _, llm = prompt.partition("Model quotes, numbered from 0:")
        n = min(len(re.findall(r'^[0-9]+\. "', part, re.M)) for part in (human, llm))
        return json.dumps({"matches": [{"human_index": i, "llm_index": i} for i in range(n)]})

    return match


@query(_BY_PLACE)
def compare_by_matcher(spark, sf_dir):
    """Both codings put to a matcher, in one call from alignment to pairs."""
    rows, _ = match_groups(*codings(spark, sf_dir, once=True), _by_place)
    return rows.select("doc_id", "construct", "human_quote", "llm_quote", "status")


@query()
def compare_similar(spark, sf_dir):
    """Pairs by overlapping spans or shared words."""
    human, llm = codings(spark, sf_dir, once=True)
    return matching.compare(human, llm, matching.propose_similar(human, llm, 0.5))


@query(rf"""WITH {S}, hn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, construct ORDER BY ord) - 1 AS x, list_distinct(regexp_split_to_array(lower(quote), '\s+')) AS w, instr(text, quote) - 1 AS a, instr(text, quote) - 1 + length(quote) AS b FROM h JOIN (SELECT DISTINCT doc_id, text FROM s) USING (doc_id)),
 mn AS (SELECT *, row_number() OVER (PARTITION BY doc_id, construct ORDER BY ord) - 1 AS x, list_distinct(regexp_split_to_array(lower(quote), '\s+')) AS w, instr(text, quote) - 1 AS a, instr(text, quote) - 1 + length(quote) AS b FROM m JOIN (SELECT DISTINCT doc_id, text FROM s) USING (doc_id)),
 p AS (SELECT hn.doc_id, hn.construct, hn.x AS human_index, mn.x AS llm_index, hn.quote <> mn.quote AS paraphrase, len(list_intersect(hn.w, mn.w)) AS k, len(hn.w) + len(mn.w) AS n, greatest(0, least(hn.b, mn.b) - greatest(hn.a, mn.a)) AS o, hn.b - hn.a + mn.b - mn.a AS l FROM hn JOIN mn ON hn.doc_id = mn.doc_id AND hn.construct = mn.construct),
 q AS (SELECT *, greatest(k / (n - k)::DOUBLE, o / (l - o)::DOUBLE) AS match_confidence FROM p)
 SELECT doc_id, construct, row_number() OVER (PARTITION BY doc_id, construct ORDER BY match_confidence DESC, human_index, llm_index) - 1 AS ord, human_index, llm_index, paraphrase, match_confidence FROM q WHERE match_confidence >= 0.5""")
def similar_proposals(spark, sf_dir):
    """Pairs of quotes that overlap or share words, as they are proposed, best first."""
    return matching.propose_similar(*codings(spark, sf_dir, once=True), 0.5)


_MATCHES = """CASE doc_id % 4
 WHEN 0 THEN concat('{"matches":[{"human_index":', doc_id % 7, ',"llm_index":1,"paraphrase":true,"match_confidence":1.7},{"human_index":0,"llm_index":"x"}]}')
 WHEN 1 THEN '{"matches":[{"human_index":0,"llm_index":0},7,{"human_index":1,"llm_index":2,"match_confidence":-3}]}'
 WHEN 2 THEN 'no' ELSE '{"matches":[]}' END"""


@query("""WITH x AS (SELECT doc_id, 0 AS ord, doc_id % 7 AS human_index, 1 AS llm_index, true AS paraphrase, 1.0 AS match_confidence FROM documents WHERE doc_id % 4 = 0
 UNION ALL SELECT doc_id, unnest([0, 2]), unnest([0, 1]), unnest([0, 2]), false, unnest([0.5, 0.0]) FROM documents WHERE doc_id % 4 = 1)
 SELECT doc_id::VARCHAR AS doc_id, 'c' AS construct, ord, human_index, llm_index, paraphrase, match_confidence FROM x""")
def match_response_parse(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.lit("c").alias("construct"), F.expr(_MATCHES).alias("response_text"))
    return extract_matches(validate_responses(rows, "matches"))


@query(f"""WITH {S}, g AS (SELECT doc_id, construct, quote, quote_index, row_number() OVER (PARTITION BY doc_id, construct ORDER BY ord) - 1 AS x FROM m)
 SELECT doc_id, construct, string_agg(x::VARCHAR || '. "' || quote || '" (indices: ' || quote_index || ')', chr(10) ORDER BY x) AS listing FROM g GROUP BY ALL""")
def numbered_quotes(spark, sf_dir):
    grouped = matching.group_quotes(codings(spark, sf_dir)[1], "q")
    return grouped.select("doc_id", "construct", matching.format_quotes(F.col("q")).alias("listing"))


@query(f"WITH {PER_DOC} SELECT doc_id, construct, tp, fp, fn, \"union\", {_ROUNDED}, pr_auc FROM d")
def per_doc_metrics(spark, sf_dir):
    return metrics.rounded(metrics.per_document(metric_rows(spark, sf_dir)))


@query(f"WITH {POOLED} SELECT * FROM p")
def pooled_metrics(spark, sf_dir):
    return metrics.pooled_summary(metric_rows(spark, sf_dir))


@query(f"WITH {POOLED.replace(R, X + ', r AS (SELECT * FROM c)')} SELECT * FROM p")
def agreement(spark, sf_dir):
    """Sentences to pooled agreement, end to end."""
    needed = ["doc_id", "construct", "status", "llm_confidence", "tp", "fp", "fn"]
    return metrics.pooled_summary(materialise(exact(spark, sf_dir, places=False).select(*needed), "comparison"))


@query(f"WITH {PER_DOC} SELECT * FROM st")
def doc_stats(spark, sf_dir):
    return metrics.document_stats(metrics.document_counts(metric_rows(spark, sf_dir)))


@query(f"WITH {R} {_auc_sql('construct')}")
def pr_auc(spark, sf_dir):
    return metrics.pr_auc(metric_rows(spark, sf_dir), ["construct"])


@query(f"WITH {WEIGHTED} SELECT * FROM wt")
def weighted_summary(spark, sf_dir):
    return metrics.weighted_summary(metrics.per_document(metric_rows(spark, sf_dir)))


def _two(c: str) -> str:
    return f"format('{{:.2f}}', {c})"


_STATS = f"n_docs::VARCHAR || ' [' || {_two('p5')} || '-' || {_two('p95')} || ']' AS \"{display.STATS}\""


@query(f"WITH {POOLED} SELECT construct, tp, fp, fn, {', '.join(f"coalesce({_two(m)}, '-') AS {m}" for m in _ALL)}, {_STATS} FROM p")
def format_pooled(spark, sf_dir):
    return display.format_pooled(pooled_metrics(spark, sf_dir))


@query(f"WITH {WEIGHTED} SELECT construct, tp, fp, fn, {', '.join(f"coalesce({_two(m + '_median')} || ' [' || {_two(m + '_min')} || '-' || {_two(m + '_max')} || ']', '-') AS {m}" for m in _ALL)}, {_STATS} FROM wt")
def format_weighted(spark, sf_dir):
    return display.format_weighted(weighted_summary(spark, sf_dir))


def _new_sql(status: str, column: str, known: str) -> str:
    return f"""SELECT construct, list(quote ORDER BY dig, quote) AS q FROM (SELECT *, row_number() OVER (PARTITION BY construct ORDER BY dig, quote) AS n FROM (
      SELECT DISTINCT c.construct, trim({column}, ' ' || chr(9) || chr(10) || chr(13)) AS quote, md5(trim({column}, ' ' || chr(9) || chr(10) || chr(13)) || ':0') AS dig FROM c JOIN b USING (construct) WHERE status = '{status}' AND NOT list_contains(b.{known}, trim({column}, ' ' || chr(9) || chr(10) || chr(13))))) WHERE n <= 50 GROUP BY construct"""


_REFINED = X + f""", b0 AS ({BOOK}), b AS (SELECT b0.* FROM b0 JOIN (SELECT construct, round_even(2 * (sum(tp) / count(*)::DOUBLE) - 1, 4) AS pabak FROM c GROUP BY construct) USING (construct) WHERE pabak < 0.8),
 ex AS ({_new_sql('human_only', 'human_quote', 'examples')}), cx AS ({_new_sql('llm_only', 'llm_quote', 'counter_examples')}),
 part AS (SELECT b.construct, b.ord, definition, list_concat(examples, coalesce(ex.q, [])) AS examples, list_concat(counter_examples, coalesce(cx.q, [])) AS counter_examples FROM b LEFT JOIN ex USING (construct) LEFT JOIN cx USING (construct) WHERE ex.q IS NOT NULL OR cx.q IS NOT NULL)"""
_BOOK_OUT = "construct, ord, definition, array_to_string(examples, '|') AS examples, array_to_string(counter_examples, '|') AS counter_examples"


def _shown(b: DataFrame) -> DataFrame:
    return b.select("construct", "ord", "definition", F.array_join("examples", "|").alias("examples"), F.array_join("counter_examples", "|").alias("counter_examples"))


def _partial(spark, sf_dir):
    needed = ["doc_id", "construct", "status", "human_quote", "llm_quote", "llm_confidence", "tp", "fp", "fn"]
    rows = materialise(exact(spark, sf_dir, places=False).select(*needed), "comparison")
    return cb.refine(rows, materialise(metrics.pooled_summary(rows), "pooled"), book(spark))


@query(f"WITH {_REFINED} SELECT {_BOOK_OUT} FROM part")
def refine_codebook(spark, sf_dir):
    return _shown(_partial(spark, sf_dir))


@query(f"WITH {_REFINED} SELECT {_BOOK_OUT} FROM (SELECT * FROM part UNION ALL SELECT * FROM b0 WHERE construct NOT IN (SELECT construct FROM part))")
def merge_codebooks(spark, sf_dir):
    return _shown(cb.merge(book(spark), _partial(spark, sf_dir)))


def _list_sql(values: list[str]) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


_T = f"""t0 AS (SELECT doc_id, source, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> '') AS t,
  len(list_filter(list_transform(regexp_split_to_array(text, '[.!?]+(\\s+|$)'), lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(13))), lambda x: x <> '')) AS s FROM documents),
 t1 AS (SELECT doc_id, source, len(t) AS n_tokens, len(list_distinct(t)) AS n_unique_tokens, length(text) AS n_characters, s AS n_sentences,
  len(list_filter(t, lambda x: list_contains({_list_sql(STOP_WORDS)}, x))) AS n_stop_words, len(list_filter(t, lambda x: list_contains({_list_sql(FIRST_PERSON)}, x))) AS n_first_person,
  len(list_filter(t, lambda x: regexp_full_match(x, '\\p{{L}}+'))) AS n_alpha, len(regexp_extract_all(text, '\\p{{L}}')) AS l, len(regexp_extract_all(lower(text), '[aeiouy]+')) AS y,
  len(list_filter(t, lambda x: len(regexp_extract_all(x, '[aeiouy]+')) >= 3)) AS p FROM t0),
 t2 AS (SELECT *, n_unique_tokens / nullif(n_tokens, 0)::DOUBLE AS type_token_ratio, n_tokens / nullif(n_sentences, 0)::DOUBLE AS sentence_length_mean, n_stop_words / nullif(n_tokens, 0)::DOUBLE AS prop_stop_words,
  (n_tokens - n_stop_words) / nullif(n_tokens, 0)::DOUBLE AS lexical_density, n_first_person / nullif(n_tokens, 0)::DOUBLE AS prop_1st_person, n_alpha / nullif(n_tokens, 0)::DOUBLE AS alpha_ratio,
  206.835 - 1.015 * (n_tokens / nullif(n_sentences, 0)::DOUBLE) - 84.6 * (y / nullif(n_tokens, 0)::DOUBLE) AS flesch_reading_ease,
  0.39 * (n_tokens / nullif(n_sentences, 0)::DOUBLE) + 11.8 * (y / nullif(n_tokens, 0)::DOUBLE) - 15.59 AS flesch_kincaid_grade,
  0.4 * (n_tokens / nullif(n_sentences, 0)::DOUBLE + 100 * (p / nullif(n_tokens, 0)::DOUBLE)) AS gunning_fog,
  0.0588 * (100 * (l / nullif(n_tokens, 0)::DOUBLE)) - 0.296 * (100 * (n_sentences / nullif(n_tokens, 0)::DOUBLE)) - 15.8 AS coleman_liau_index,
  4.71 * (l / nullif(n_tokens, 0)::DOUBLE) + 0.5 * (n_tokens / nullif(n_sentences, 0)::DOUBLE) - 21.43 AS automated_readability_index,
  1.043 * sqrt(30.0 * p / nullif(n_sentences, 0)) + 3.1291 AS smog FROM t1)"""


def _text_metrics(spark, sf_dir):
    return document_metrics(table(spark, sf_dir, "documents"))


def _text_query(name: str, columns: list[str]) -> None:
    def run(spark, sf_dir):
        out = _text_metrics(spark, sf_dir)
        return out.select("doc_id", *[F.round(c, 9).alias(c) if t == "double" else F.col(c) for c, t in out.dtypes if c in columns])

    shown = ", ".join(c if c.startswith("n_") else f"round({c}, 9) AS {c}" for c in columns)
    QUERIES[name], SQL[name] = run, f"WITH {_T} SELECT doc_id, {shown} FROM t2"


_text_query("token_counts", ["n_tokens", "n_unique_tokens", "n_characters", "n_sentences", "type_token_ratio", "sentence_length_mean"])
_text_query("first_person", ["n_first_person", "prop_1st_person"])
_text_query("stop_words", ["n_stop_words", "prop_stop_words"])
_text_query("lexical_density", ["lexical_density"])
_text_query("alpha_ratio", ["n_alpha", "alpha_ratio"])
_text_query("readability", ["flesch_reading_ease", "flesch_kincaid_grade", "gunning_fog", "coleman_liau_index", "automated_readability_index", "smog"])


def _summary_sql() -> str:
    def part(i: int, label: str, c: str | None, form: str) -> str:
        if not c:
            return f"SELECT {i} AS position, '{label}' AS metric, count(*) AS n, NULL AS mean, NULL AS sd, NULL AS min, NULL AS max, count(*)::VARCHAR AS value FROM t2"
        k, unit = ("100 * ", "%") if form == "percent" else ("", "")
        number = lambda f: f"coalesce(format('{{:.2f}}', ({k}{f}({c}))::DOUBLE), 'nan')"
        value = f"{number('avg')} || '{unit} (' || {number('stddev_samp')} || '{unit}) [' || {number('min')} || '{unit}–' || {number('max')} || '{unit}]'"
        return f"SELECT {i} AS position, '{label}' AS metric, count({c}) AS n, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS sd, round(min({c}), 6) AS min, round(max({c}), 6) AS max, CASE WHEN count({c}) = 0 THEN 'N/A' ELSE {value} END AS value FROM t2"

    rows = [("N (documents)", None, "count"), *corpus.ROWS, *corpus.READABILITY]
    return f"WITH {_T} " + " UNION ALL ".join(part(i, *row) for i, row in enumerate(rows))


@query(_summary_sql())
def corpus_summary(spark, sf_dir):
    out = corpus.summarize(_text_metrics(spark, sf_dir), readability=True)
    return out.select("position", "metric", "n", *[F.round(c, 6).alias(c) for c in ("mean", "sd", "min", "max")], "value")


@query("""WITH e AS (SELECT label, embedding::DOUBLE[] AS v, lag(embedding::DOUBLE[]) OVER (PARTITION BY label ORDER BY vec_id) AS p FROM embeddings)
 SELECT label, round(avg(list_dot_product(v, p) / (sqrt(list_dot_product(v, v)) * sqrt(list_dot_product(p, p)))), 6) AS coherence FROM e GROUP BY label""")
def coherence(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").alias("doc_id"), F.col("vec_id").alias("sent"), "embedding")
    return corpus.coherence(rows).select(F.col("doc_id").alias("label"), F.round("coherence_sbert", 6).alias("coherence"))


def annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens with a tag by their length and half their place as head; some sentences have no root."""
    rows = sentence_rows(spark, sf_dir).select("doc_id", F.col("pos").alias("sent"), F.posexplode(tokens(F.col("quote"))).alias("i", "w"))
    tag = F.get(F.array(*[F.lit(t) for t in ("NOUN", "VERB", "ADJ", "ADV", "PRON", "X")]), F.length("w") % 6)
    head = F.when((F.col("sent") % 5 == 4) & (F.col("i") == 0), F.lit(1)).otherwise(F.floor(F.col("i") / 2))
    return rows.select("doc_id", "sent", "i", tag.alias("pos"), head.cast("int").alias("head"))


_A = S + """, a AS (SELECT doc_id, pos AS sent, unnest(t) AS w, generate_subscripts(t, 1) - 1 AS i FROM (SELECT doc_id, pos, list_filter(regexp_split_to_array(lower(quote), '[^\\p{L}\\p{N}_]+'), lambda x: x <> '') AS t FROM s)),
 an AS (SELECT doc_id, sent, i, (['NOUN', 'VERB', 'ADJ', 'ADV', 'PRON', 'X'])[(length(w) % 6 + 1)::INT] AS tag, CASE WHEN sent % 5 = 4 AND i = 0 THEN 1 ELSE i // 2 END AS head FROM a)"""


@query(f"WITH {_A} SELECT doc_id, " + ", ".join(f"count(*) FILTER (tag = '{p}') / count(*)::DOUBLE AS pos_prop_{p}" for p in ("NOUN", "VERB", "ADJ", "ADV", "PRON")) + " FROM an GROUP BY doc_id")
def pos_proportions(spark, sf_dir):
    return corpus.pos_proportions(annotations(spark, sf_dir))


@query(f"WITH {_A}, d AS (SELECT doc_id, sent, avg(abs(i - head)) AS d FROM an GROUP BY ALL) SELECT doc_id, round(avg(d), 9) AS dependency_distance_mean, round(stddev_samp(d), 9) AS dependency_distance_std FROM d GROUP BY doc_id")
def dependency_distance(spark, sf_dir):
    out = corpus.sentence_complexity(annotations(spark, sf_dir))
    return out.select("doc_id", F.round("dependency_distance_mean", 9).alias("dependency_distance_mean"), F.round("dependency_distance_std", 9).alias("dependency_distance_std"))


@query(f"WITH {_A}, n AS (SELECT doc_id, sent, count(*) AS n FROM an GROUP BY ALL), d AS (SELECT doc_id, CASE WHEN sent % 5 = 4 THEN NULL WHEN n = 1 THEN 0 ELSE 1 + floor(log2(n - 1)) END AS d FROM n) SELECT doc_id, round(avg(d), 9) AS mean_tree_depth FROM d GROUP BY doc_id")
def tree_depth(spark, sf_dir):
    out = corpus.sentence_complexity(annotations(spark, sf_dir))
    return out.select("doc_id", F.round("mean_tree_depth", 9).alias("mean_tree_depth"))
