"""Coding runs: prompts, a pluggable coder, parsing, retries."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.parsing import extract_instances, extract_matches, first_success, validate_responses
from ..operators.location import locate_quotes
from ..operators.matching import KEYS, align, compare, format_quotes
from ..scratch import materialise
from ..sources.codings import read_codebook, read_errors
from ..sources.documents import check_unique, read_documents, rows_as_documents
from ..sources.sinks import nested_results, run_id, run_summary, write_run
from .responses import Coder, Response, call_coder  # noqa: F401


TEMPLATE = """Code the text below with the codebook's constructs.

Codebook:
{codebook}

Text:
{text}

Answer with JSON alone: {{"instances": [{{"construct": ..., "speaker_id": ... or null, "quote": ..., "confidence": 0, 1 or 2}}]}}.
Quotes are copied from the text letter for letter.  Confidence 0 means absent or negated, 1 indirect, 2 clear.
Without any instance the list is empty."""

MATCH_TEMPLATE = """Two coders marked quotes of the construct {construct}.

Human quotes, numbered from 0:
{human_quotes}

Model quotes, numbered from 0:
{llm_quotes}

Pair the quotes that mean the same passage, each at most once.  Answer with JSON alone:
{{"matches": [{{"human_index": ..., "llm_index": ..., "paraphrase": true or false, "match_confidence": 0.0 to 1.0}}]}}."""


def fill(template: str, **values: Column) -> Column:
    """The template as a column, its fields replaced; doubled braces stand for single ones."""
    marks = {"{{": "\0l", "}}": "\0r"}
    for a, b in marks.items():
        template = template.replace(a, b)
    parts: list[Column] = []
    plain = lambda t: F.lit(t.replace("\0l", "{").replace("\0r", "}"))
    while template:
        at, name = min(((template.find("{" + n + "}"), n) for n in values if "{" + n + "}" in template), default=(-1, ""))
        if at < 0:
            parts.append(plain(template))
            break
        parts += [plain(template[:at]), values[name]]
        template = template[at + len(name) + 2 :]
    return F.concat(*parts)


def codebook_text(codebook: DataFrame) -> str:
    """The codebook as indented JSON for prompts; a codebook is small, and its text goes into every prompt."""
    rows = codebook.orderBy("ord").select("construct", "definition", "examples", "counter_examples").collect()
    entry = lambda r: {k: r[k] for k in ("definition", "examples", "counter_examples") if r[k]}
    return json.dumps({r.construct: entry(r) for r in rows}, indent=2, ensure_ascii=False)


@dataclass
class Coded:
    """Results of a run: instances, one outcome and metadata row a document, errors, and responses by attempt."""

    instances: DataFrame
    outcomes: DataFrame
    meta: DataFrame
    errors: DataFrame
    responses: DataFrame


def response_metadata(responses: DataFrame, outcomes: DataFrame) -> DataFrame:
    """What is known of each document's response: of its first valid attempt, or of the last one with its error."""
    attempt = F.col("num_retries").alias("attempt")
    said = ["model", "usage", "created", "response_id", "latency_ms", "raw_response"]
    known = responses.select("doc_id", "attempt", *said, "error_type", "error_output", "response_text")
    both = outcomes.select("doc_id", attempt, "num_retries", "error_message").join(known, ["doc_id", "attempt"])
    failed = F.col("error_message").isNotNull()
    kind = F.when(failed, F.coalesce("error_type", F.lit("ValueError"))).alias("error_type")
    output = F.when(failed, F.coalesce("error_output", "response_text", "error_message")).alias("error_output")
    return both.select("doc_id", *said, "num_retries", "error_message", kind, output)


def parse_run(docs: DataFrame, responses: DataFrame, model: str = "coder", fuzzy: float | None = None) -> Coded:
    """Responses to results; documents may have a ``path``, which their errors then name.

    A document without a text was never asked about; it has an error that says so.  With ``fuzzy``, quotes
    that do not stand in their text as they are get the place that is most like them, if by that share at least.
    """
    valid = validate_responses(responses)
    valid = valid.withColumn("invalid", F.when(F.col("error_message").isNotNull(), F.col("error_message")).otherwise(F.col("invalid")))
    best = first_success(valid.select("doc_id", "attempt", "response_text", "parsed", "invalid"))
    path = F.col("path") if "path" in docs.columns else F.lit(None).cast("string")
    texts = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", path.alias("document_path"))
    silent = texts.where("text IS NULL").select("doc_id", F.lit(0).alias("num_retries"), F.lit("No text").alias("error_message"))
    asked = best.select("doc_id", "num_retries", "error_message")
    outcomes = asked.unionByName(silent)
    good = best.where("error_message IS NULL").join(texts, "doc_id").select("doc_id", "text", "parsed")
    instances = extract_instances(good) if fuzzy is None else locate_quotes(extract_instances(good, keep_text=True), fuzzy, texts)
    answered = response_metadata(responses, asked)
    said = {f.name: F.lit(None).cast(f.dataType) for f in answered.schema} | {"model": F.lit(model), "error_type": F.lit("ValueError"), "error_output": F.lit("No text")}
    none = silent.select(*[F.col(c) if c in silent.columns else v.alias(c) for c, v in said.items()])
    meta = answered.unionByName(none)
    failed = meta.where("error_message IS NOT NULL").select("doc_id", "error_message", F.col("model").alias("model_used"))
    errors = failed.join(texts.select("doc_id", "document_path"), "doc_id").select("doc_id", "document_path", "error_message", "model_used", F.current_timestamp().alias("ts"))
    return Coded(instances.select("doc_id", "construct", "ord", "speaker_id", "quote", "quote_index", "confidence"), outcomes, meta, errors, responses)


def code_table(docs: DataFrame, codebook: DataFrame, make: Callable[[], Coder], retries: int = 0, pause: float = 0.0, template: str = TEMPLATE, tasks: int | None = None, model: str = "coder", fuzzy: float | None = None, store: str | None = None, slice_rows: int | None = None) -> Coded:
    """Code every document of a table (``doc_id, text``); ``tasks`` bounds how many coders work at a time.

    ``fuzzy`` is the share from which altered quotes are located.  ``store`` is a folder of responses: what it
    holds is not asked again, so a run that broke off goes on where it stopped.
    """
    prompt = fill(template, text=F.col("text"), codebook=F.lit(codebook_text(codebook)))
    sizes = {"slice_rows": slice_rows} if slice_rows else {}
    return parse_run(docs, call_coder(docs.where("text IS NOT NULL"), prompt, make, retries, pause, model, store=store, tasks=tasks, **sizes), model, fuzzy)


def write_coded(run: Coded, docs: DataFrame, root: str, name: str, model: str, codebook: str, source: str, form: str = "parquet") -> str:
    """Write encodings, metadata, errors and the summary of a run under a name with its time; returns that name."""
    coded = run.outcomes.where("error_message IS NULL").select("doc_id")
    run_name = run_id(name)
    write_run(nested_results(run.instances, coded), root, "encodings", run_name, form)
    write_run(run.meta, root, "metadata", run_name, form)
    write_run(run.errors, root, "errors", run_name, form)
    write_run(run_summary(run.outcomes, run_name, model, codebook, source), root, "summary", run_name, form)
    return run_name


def code_directory(spark: SparkSession, folder: str, codebook: str, make: Callable[[], Coder], root: str, name: str = "run", model: str = "coder", **options) -> tuple[Coded, str]:
    """Code every text file and transcript of a folder by a codebook file, and write the run."""
    docs = read_documents(spark, folder)
    run = code_table(docs, read_codebook(spark, codebook), make, model=model, **options)
    return run, write_coded(run, docs, root, name, model, codebook, folder)


def code_rows(rows: DataFrame, text_column: str, codebook: str, make: Callable[[], Coder], root: str, id_column: str | None = None, order: str | None = None, name: str = "run", model: str = "coder", source: str = "table", **options) -> tuple[Coded, str]:
    """Code every row of a table by a codebook file, and write the run."""
    docs = check_unique(materialise(rows_as_documents(rows, text_column, id_column, order), "documents"))
    run = code_table(docs, read_codebook(rows.sparkSession, codebook), make, model=model, **options)
    return run, write_coded(run, docs, root, name, model, codebook, source)


def retry_failed(docs: DataFrame, errors: DataFrame, codebook: DataFrame, make: Callable[[], Coder], **options) -> tuple[Coded, DataFrame]:
    """Code the failed documents again; returns that run and the errors that remain."""
    again = docs.join(errors.select("doc_id").distinct(), docs["doc_id"].cast("string") == errors["doc_id"], "left_semi")
    run = code_table(again, codebook, make, **options)
    done = run.outcomes.where("error_message IS NULL").select("doc_id")
    return run, errors.join(done, "doc_id", "left_anti")


def retry_run(docs: DataFrame, root: str, name: str, codebook: str, make: Callable[[], Coder], **options) -> tuple[Coded, DataFrame]:
    """Code a saved run's failed documents again, and add what is recovered to the run.

    ``docs`` are the documents that the run was given.  Results, metadata and errors of the new attempts are
    added to the run's tables; a document is failed as long as it has no result, which is how ``read_errors``
    reads the run.  Returns the new attempts and the errors that remain; without failures both are empty.
    """
    spark = docs.sparkSession
    errors = read_errors(spark, root, name)
    run, _ = retry_failed(docs, errors, read_codebook(spark, codebook), make, **options)
    recovered = run.outcomes.where("error_message IS NULL").select("doc_id")
    for table, kind in ((run.meta, "metadata"), (run.errors, "errors"), (nested_results(run.instances, recovered), "encodings")):
        write_run(table, root, kind, name, add=True)
    return run, read_errors(spark, root, name)


def lexicon_coder(codebook: list[tuple[str, list[str]]]) -> Callable[[], Coder]:
    """A coder for tests without a model: every example phrase found in the text part of the prompt."""

    def make() -> Coder:
        def code(prompt: str) -> str:
            text = prompt.partition("\nText:\n")[2].partition("\n\nAnswer with JSON")[0]
            found = [{"construct": c, "speaker_id": None, "quote": p, "confidence": 2} for c, phrases in codebook for p in phrases if p in text]
            return json.dumps({"instances": found})

        return code

    return make


def match_prompts(aligned: DataFrame, quotes: Callable[[Column], Column], template: str = MATCH_TEMPLATE) -> DataFrame:
    """Prompts for the groups that both sides have; one-sided groups never reach a matcher."""
    two = aligned.where((F.size("hs") > 0) & (F.size("ms") > 0))
    return two.select("doc_id", "construct", fill(template, construct=F.col("construct"), human_quotes=quotes(F.col("hs")), llm_quotes=quotes(F.col("ms"))).alias("prompt"))


def call_matcher(prompts: DataFrame, make: Callable[[], Coder], retries: int = 0, store: str | None = None) -> DataFrame:
    """``(doc_id, construct, response_text, parsed, error_message)`` of a matcher, written before anything reads them."""
    key = prompts.select(F.to_json(F.array("doc_id", "construct")).alias("doc_id"), "prompt")
    got = call_coder(key, F.col("prompt"), make, retries, model="matcher", items="matches", store=store)
    valid = validate_responses(got, "matches").withColumn("invalid", F.coalesce("error_message", "invalid"))
    best = first_success(valid.select("doc_id", "attempt", "response_text", "parsed", "invalid"))
    names = F.from_json("doc_id", "array<string>")
    return best.select(names[0].alias("doc_id"), names[1].alias("construct"), "response_text", "parsed", "error_message")


class MatcherError(RuntimeError):
    """A matcher gave no usable answer for some groups, after all attempts."""


def compare_by_matcher(human: DataFrame, llm: DataFrame, make: Callable[[], Coder], retries: int = 0, template: str = MATCH_TEMPLATE, store: str | None = None, leave_out: bool = False) -> tuple[DataFrame, DataFrame]:
    """Both codings' quotes aligned, groups of both sides put to a matcher, and paired as it says.

    Returns comparison rows and the groups, with their errors, for which the matcher failed.  Such groups
    raise; with ``leave_out``, their quotes are on neither side of the comparison, since they are neither agreed nor missed.
    """
    prompts = match_prompts(align(human, llm), format_quotes, template)
    said = materialise(call_matcher(prompts, make, retries, store).withColumn("parsed", F.to_json("parsed")), "matches")
    failed = said.where("error_message IS NOT NULL").select(*KEYS, "error_message")
    if not leave_out and (first := failed.orderBy(*KEYS).first()):
        raise MatcherError(f"matcher failed for {failed.count()} groups, first {first.doc_id}, {first.construct}: {first.error_message}")
    proposals = extract_matches(said.where("error_message IS NULL").withColumn("parsed", F.parse_json("parsed")))
    sides = [side.join(failed.select(*KEYS), KEYS, "left_anti") for side in (human, llm)]
    return compare(*sides, proposals), failed
