"""Calls to a coder or matcher that are made once: responses stand in a store, by the digest of their prompt.

A prompt that has a usable response in the store is not asked again, whether by a later run, by a run that
starts anew after it broke off, or for another document with the same prompt.  What is left is asked in slices; a slice's
responses are in the store when it ends, so that a task that fails asks again only for its part of one slice.
Prompts are dealt to slices once, as partitions of a table, so a slice reads no other slice's prompts.
Tasks must not be run twice on purpose: leave ``spark.speculation`` off.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESPONSES
from ..scratch import discard, folder, materialise

#: Prompts of a slice, and those whose responses are handed on at once.
SLICE, HANDED = 10_000, 256
STORE = RESPONSES.replace("doc_id string", "key string, usable boolean, call bigint")


@dataclass
class Response:
    """A coder's answer with what its service reports of it; a coder may also return the text alone."""

    text: str
    model: str | None = None
    usage: dict[str, int] | None = None
    created: int | None = None
    response_id: str | None = None
    raw: dict | None = None


#: A coder takes a prompt and returns a response; one is made for each partition.
Coder = Callable[[str], "str | Response"]


def _once(pairs: list[tuple[str, object]]) -> dict[str, object]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ValueError("a key stands twice in the JSON")
    return out


def _no_number(name: str) -> None:
    raise ValueError(f"{name} is no JSON")


def check(text: str, items: str) -> None:
    """An error unless the text is a JSON object with a list of ``items``, by the rules of the parser that reads it later."""
    got = json.loads(text, object_pairs_hook=_once, parse_constant=_no_number)
    if not isinstance(got, dict):
        raise ValueError("Not an object")
    if not isinstance(got.get(items), list):
        raise ValueError(f"No list of {items}")


def _schema() -> pa.Schema:
    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "map<string,bigint>": pa.map_(pa.string(), pa.int64())}
    return pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in STORE.split(", ")])


def ask(prompts: DataFrame, make: Callable[[], Coder], retries: int, pause: float, model: str, items: str, call: int) -> DataFrame:
    """A row an attempt for each ``(key, prompt)``: an attempt that raises, or gives no list of ``items``, is followed by another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, schema, out = make(), _schema(), []
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for attempt in range(retries + 1):
                    if attempt and pause:
                        time.sleep(pause)
                    began, row = time.time(), {"key": key, "call": call, "attempt": attempt, "model": model, "usable": True}
                    try:
                        got = coder(text)
                        if isinstance(got, Response):
                            row |= {"model": got.model or model, "usage": list((got.usage or {}).items()), "created": got.created, "response_id": got.response_id, "raw_response": json.dumps(got.raw) if got.raw is not None else None}
                            got = got.text
                        row["response_text"] = got
                        check(got, items)
                    except Exception as e:  # whatever the caller's coder raises is that document's error
                        row |= {"usable": False, "error_message": str(e), "error_type": type(e).__name__, "error_output": row.get("response_text") or str(e)}
                    row["latency_ms"] = (time.time() - began) * 1000
                    out.append(row)
                    if row["usable"]:
                        break
                if len(out) >= HANDED:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return prompts.select("key", "prompt").mapInArrow(run, STORE)


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """All responses of a store; none if it is not there yet."""
    try:
        return spark.read.schema(STORE).parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], STORE)


def answered(store: DataFrame) -> DataFrame:
    """The attempts of each key's last call; a key is called again only if no attempt was usable."""
    last = store.groupBy("key").agg(F.max("call").alias("call"))
    return store.join(last, ["key", "call"])


def dealt(asked: DataFrame, slices: int, workers: int) -> DataFrame:
    """Each ``key`` of ``asked`` once with its prompt, written as partitions: a file for each worker of a slice."""
    spark = asked.sparkSession
    path, h = f"{folder(spark)}/slices-{uuid.uuid4().hex}", F.xxhash64("key")
    own = [F.pmod(h, F.lit(slices)).cast("int").alias("slice"), F.pmod(F.shiftright(h, 32), F.lit(workers)).cast("int").alias("worker")]
    rows = asked.select(*own, "key", "prompt").repartition("slice", "worker").groupBy("slice", "worker", "key").agg(F.any_value("prompt").alias("prompt"))
    rows.write.option("compression", "zstd").partitionBy("slice", "worker").parquet(path)
    out = spark.read.schema(rows.select("key", "prompt", "slice", "worker").schema).parquet(path)
    out._scratch_path = path
    return out


def call_coder(docs: DataFrame, prompt: Column, make: Callable[[], Coder], retries: int = 0, pause: float = 0.0, model: str = "coder", items: str = "instances", store: str | None = None, tasks: int | None = None, slice_rows: int = SLICE) -> DataFrame:
    """Responses of a coder to a prompt a row, a row an attempt, written before anything reads them.

    ``doc_id`` is the key of ``docs``; documents with one prompt share its response.  ``store`` is a folder
    of responses that later runs find again; without it, they are kept for this run alone.  ``tasks`` bounds
    how many coders work at a time.
    """
    spark = docs.sparkSession
    where = store or f"{folder(spark)}/responses-{uuid.uuid4().hex}"
    digest = F.sha2(F.concat(F.lit(f"{model}\0{items}\0"), "prompt"), 256)
    asked = materialise(docs.select(F.col("doc_id").cast("string").alias("doc_id"), prompt.alias("prompt")).withColumn("key", digest), "prompts")
    done = read_store(spark, where).where("usable").select("key")
    slices = -(-asked.select("key").distinct().join(done, "key", "left_anti").count() // slice_rows)
    workers = tasks or spark.sparkContext.defaultParallelism
    if slices:
        todo = dealt(asked.join(done, "key", "left_anti"), slices, workers)
        for k in range(slices):
            part = todo.where(F.col("slice") == k).coalesce(workers)
            ask(part, make, retries, pause, model, items, time.time_ns()).write.mode("append").parquet(where)
        discard(todo)
    got = answered(read_store(spark, where).join(asked.select("key").distinct(), "key", "left_semi"))
    return materialise(asked.select("doc_id", "key").join(got, "key").drop("key", "usable", "call"), "responses")
