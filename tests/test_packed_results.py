"""Packed result stores and CSV records by byte ranges."""

import csv
import io
import os
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import grading as G
from plumbline.sources import csv_records, packed_results, result_csv

SPLIT = "spark.sql.files.maxPartitionBytes"
COST = "spark.sql.files.openCostInBytes"


@pytest.fixture
def split_by(spark):
    before = {key: spark.conf.get(key) for key in (SPLIT, COST)}

    def set_size(size):
        spark.conf.set(SPLIT, str(size))
        spark.conf.set(COST, "1")

    yield set_size
    for key, value in before.items():
        spark.conf.set(key, value)


def plain_records(text):
    """One character after the other; None if a value stays open."""
    records, values, field, quoted, state = [], [], "", False, "start"
    own = ""
    if text and not text.endswith("\n"):
        text += "\n"
    for c in text:
        own += c
        if state == "start" and c == '"':
            state, quoted = "inside", True
        elif state == "inside":
            if c == '"':
                state = "quote"
            else:
                field += c
        elif state == "quote" and c == '"':
            field, state = field + c, "inside"
        elif c == ",":
            values.append(field if field or quoted else None)
            field, quoted, state = "", False, "start"
        elif c != "\n":
            field, state = field + c, "plain"
        if c == "\n" and state != "inside":
            own = own[:-1]
            if own.endswith("\r"):
                own, field = own[:-1], field.removesuffix("\r")
            if own.strip(" "):
                records.append([*values, field if field or quoted else None])
            values, field, quoted, state, own = [], "", False, "start", ""
    return None if state == "inside" else records


def read_all(spark, path):
    records, broken = csv_records.read_records(spark, str(path))
    got = {}
    for r in records.collect():
        got.setdefault(os.path.basename(r.file), {})[r.i] = r["values"]
    for own in got.values():
        assert sorted(own) == list(range(1, len(own) + 1))
    return {k: [v[i] for i in sorted(v)] for k, v in got.items()}, {
        os.path.basename(r.file) for r in broken.collect()
    }


@pytest.mark.parametrize("size", [23, 1 << 20])
def test_records_by_any_split(spark, tmp_path, split_by, size):
    rng = random.Random(size)
    texts = {}
    for k in range(24):
        if k % 2:
            text = "".join(rng.choice('a",\n\r b') for _ in range(rng.randint(0, 60)))
        else:
            buffer = io.StringIO()
            writer = csv.writer(buffer, lineterminator=rng.choice(["\n", "\r\n"]))
            for _ in range(rng.randint(1, 30)):
                writer.writerow(
                    ["".join(rng.choice('ab",\n x') for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(1, 6))]
                )
            text = buffer.getvalue()
        texts[f"f{k}.csv"] = text
        (tmp_path / f"f{k}.csv").write_bytes(text.encode())
    split_by(size)
    got, broken = read_all(spark, tmp_path)
    want = {name: plain_records(text) for name, text in texts.items()}
    assert broken == {name for name, rows in want.items() if rows is None}
    assert got == {name: rows for name, rows in want.items() if rows}


def test_one_large_file_is_read_by_many_tasks(spark, tmp_path, split_by):
    rows = [[str(k), f'line one of {k}\nline "two", of\n\n{k}', "x" * (k % 50)] for k in range(4000)]
    rows[2000][1] = 'a value, longer than a block\n"' * 3000
    with open(tmp_path / "big.csv", "w", newline="") as file:
        csv.writer(file, lineterminator="\n").writerows([["id", "text", "pad"], *rows])
    split_by(16384)
    records, broken = csv_records.read_records(spark, str(tmp_path))
    raw = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert raw.rdd.getNumPartitions() > 10 and broken.count() == 0
    got = sorted((r.i, r["values"]) for r in records.collect())
    assert [v for _, v in got[1:]] == [[a, b, c or None] for a, b, c in rows]


def test_wide_records_are_seen(spark, tmp_path):
    (tmp_path / "far.csv").write_text("a,b\n1,2,,,,,x\n")
    (tmp_path / "blank.csv").write_text("a,b\n1,2,,,,\n")
    (tmp_path / "wide.csv").write_text(",".join(f"c{k}" for k in range(3000)) + "\n" + ",".join(map(str, range(3000))) + "\n")
    (tmp_path / "open.csv").write_text('a,b\n1,"2\n3,4\n')
    tables, cells = result_csv.read_predictions(spark, str(tmp_path))
    got = {r.instance_id: (r.n_rows, r.n_cols, r.readable) for r in tables.collect()}
    assert got["far"] == (1, 2, False) and got["blank"] == (1, 2, True)
    assert got["wide"] == (1, 3000, True) and not got["open"][2]
    assert cells.where("instance_id = 'wide'").count() == 3000


def stored(spark, path, rows, batch=0, errors=()):
    df = spark.createDataFrame(rows, "inst string, pos bigint, a double, b string")
    records = packed_results.records_of(df, "inst", "pos", ["a", "b"])
    headers = packed_results.headers_of(records, ["a", "b"])
    if errors:
        bad = spark.createDataFrame([(e, 0, None, "no") for e in errors], "instance_id string, variant int, header array<string>, read_error string")
        headers = headers.withColumn("read_error", F.lit(None).cast("string")).unionByName(bad)
    packed_results.store(str(path), batch, records, headers)


def test_store_and_read_back(spark, tmp_path):
    path = tmp_path / "store"
    assert packed_results.read(spark, str(path))[0].count() == 0
    rows = [(f"i{k % 7}", k // 7, k * 1.5, None if k % 5 else "NULL") for k in range(70)]
    stored(spark, path, rows + [(None, 0, 1.0, "lost")], errors=["gone"])
    tables, cells = packed_results.read(spark, str(path))
    got = {r.instance_id: (r.n_rows, r.n_cols, r.readable, r.read_error) for r in tables.collect()}
    assert got == {f"i{k}": (10, 2, True, None) for k in range(7)} | {"gone": (0, 0, False, "no")}
    want = G.cells_of(spark.createDataFrame(rows, "inst string, pos bigint, a double, b string"), "inst", "pos", ["a"])
    columns = ["instance_id", "variant", "col_idx", "row_idx", "num"]
    assert sorted(map(tuple, cells.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))


def test_newer_batches_replace_results_and_repeats_change_nothing(spark, tmp_path):
    path = tmp_path / "store"
    for _ in range(2):
        stored(spark, path, [("x", 0, 1.0, "old"), ("x", 1, 2.0, "old"), ("y", 0, 3.0, "y")], 0)
    stored(spark, path, [("x", 0, 9.0, "new")], 1)
    os.makedirs(path / "batch=2" / "records")  # a batch that never finished
    tables, cells = packed_results.read(spark, str(path))
    assert {(r.instance_id, r.n_rows) for r in tables.collect()} == {("x", 1), ("y", 1)}
    assert {(r.instance_id, r.txt) for r in cells.where("col_idx = 1").collect()} == {("x", "new"), ("y", "y")}


def test_a_record_wider_than_its_header_is_an_error(spark, tmp_path):
    records = spark.createDataFrame([("w", 0, 0, ["1", "2"]), ("n", 0, 0, ["1"])], packed_results.RECORDS)
    headers = records.select("instance_id", "variant", F.array(F.lit("a")).alias("header"))
    packed_results.store(str(tmp_path), 0, records, headers)
    tables, cells = packed_results.read(spark, str(tmp_path))
    assert {r.instance_id: r.readable for r in tables.collect()} == {"w": False, "n": True}
    assert [r.instance_id for r in cells.collect()] == ["n"]


def test_a_heavy_result_is_cut_and_keys_prune(spark, tmp_path):
    rows = spark.range(60_000).select(
        F.when(F.col("id") < 40_000, "heavy").otherwise(F.concat(F.lit("k"), F.col("id") % 3000)).alias("inst"),
        F.when(F.col("id") < 40_000, F.col("id")).otherwise(F.floor((F.col("id") - 40_000) / 3000)).alias("pos"),
        F.sha2(F.col("id").cast("string"), 512).alias("a"),
    )
    records = packed_results.records_of(rows, "inst", "pos", ["a"])
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "1m")
    try:
        packed_results.store(str(tmp_path), 0, records, packed_results.headers_of(records, ["a"]))
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    files = spark.read.parquet(f"{tmp_path}/batch=0/records").groupBy(F.input_file_name().alias("f")).agg(
        F.countDistinct("instance_id").alias("n"), F.count_if(F.col("instance_id") == "heavy").alias("h")
    )
    counts = files.collect()
    assert 2 < len(counts) < 20 and sum(r.h > 0 for r in counts) > 1 and max(r.n for r in counts) > 500
    tables, cells = packed_results.read(spark, str(tmp_path), ["k17"])
    assert tables.count() == 1 and cells.count() == 6
    plan = cells._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(instance_id), EqualTo(instance_id,k17)" in plan
