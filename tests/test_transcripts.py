"""CSV transcripts read from splits of a few bytes, against Python's reader."""

import csv
import io
import random

import pytest

from codelens.sources import documents


def plain(text):
    """What Python's reader makes of a file: ``speaker: text`` lines of a header ``speaker,text``."""
    rows = [r for r in csv.reader(io.StringIO(text, newline="")) if r]
    head, out = rows[0], []
    for r in rows[1:]:
        cells = {k.lower(): v.strip() for k, v in zip(head, r, strict=False)}
        line = " ".join(x for x in ((cells.get("speaker") and cells["speaker"] + ":"), cells.get("text")) if x)
        if line:
            out.append(line)
    return "\n".join(out)


@pytest.fixture
def small_splits(spark):
    kept = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in kept.items():
        spark.conf.set(k, v)


def test_records_over_splits(spark, tmp_path, small_splits):
    """Line ends, separators and quotes inside quotes, wherever splits fall."""
    rng = random.Random(9)
    words = ["calm", "sea, grey", 'he said "no"', "line one\nline two", "\n\nlate", "", "  ", "é😀", '""', "a,b\nc,d"]
    want = {}
    for k in range(8):
        out = io.StringIO(newline="")
        w = csv.writer(out, lineterminator="\n")
        w.writerow(["Speaker", "id", "text"])
        for i in range(rng.randint(0, 40)):
            w.writerow([rng.choice(["Ann", "Bo", ""]), i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 5)))])
            if rng.random() < 0.1:
                out.write("\n")
        (tmp_path / f"t{k}.csv").write_text(("\ufeff" if k == 3 else "") + out.getvalue(), newline="")
        want[f"t{k}"] = plain(out.getvalue())
    (tmp_path / "other.csv").write_text("content,path,place\nonly this,p,q\n")
    want["other"] = "only this"
    lines = documents.csv_records(spark, str(tmp_path))
    assert lines.where("path = 't1.csv'").count() > 1
    got = {r.doc_id: r.text for r in documents.read_documents(spark, str(tmp_path)).collect()}
    strip = lambda t: "\n".join(x.strip() for x in t.split("\n"))
    assert {k: strip(v) for k, v in got.items()} == {k: strip(v) for k, v in want.items() if v}


def test_a_large_file_is_many_tasks(spark, tmp_path, small_splits):
    (tmp_path / "big.csv").write_text("speaker,text\n" + "".join(f"A,turn {i}\n" for i in range(500)))
    records = documents.csv_records(spark, f"{tmp_path}/big.csv")
    assert [r.record for r in records.orderBy("place").collect()] == ["speaker,text", *(f"A,turn {i}" for i in range(500))]
    assert spark.read.text(f"{tmp_path}/big.csv").rdd.getNumPartitions() > 3
    assert documents.read_documents(spark, f"{tmp_path}/big.csv").first().text == "\n".join(f"A: turn {i}" for i in range(500))
