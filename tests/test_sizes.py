"""Sizes of tables against counting them and asking the file system."""

import os

from plumbline.sources.sizes import parquet_sizes


def on_disk(folder):
    found = [
        os.path.getsize(os.path.join(where, name))
        for where, _, names in os.walk(folder)
        for name in names
        if name.endswith(".parquet")
    ]
    return len(found), sum(found)


def test_rows_files_and_bytes(spark, tmp_path):
    rows = spark.range(1000).selectExpr("id", "id % 3 AS part", "cast(id AS string) AS n", "id AS size", "id AS file")
    folders = {name: str(tmp_path / name) for name in ("plain", "parted", "empty", "odd names+%41")}
    rows.repartition(5).write.parquet(folders["plain"])
    rows.write.partitionBy("part").parquet(folders["parted"])
    rows.where("id < 0").write.parquet(folders["empty"])
    rows.repartition(2).write.parquet(folders["odd names+%41"])
    got = {r["table_name"]: tuple(r)[1:] for r in parquet_sizes(spark, folders).collect()}
    counts = {"empty": 0}
    assert got == {name: (5, *on_disk(path), counts.get(name, 1000)) for name, path in folders.items()}


def test_many_tables_and_none(spark, tmp_path):
    path = str(tmp_path / "one")
    spark.range(7).write.parquet(path)
    names = [f"t{k}" for k in range(70)]
    got = parquet_sizes(spark, dict.fromkeys(names, path))
    assert sorted(r["table_name"] for r in got.collect()) == sorted(names)
    assert parquet_sizes(spark, {}).count() == 0


def test_footers_alone(spark, sf_dir):
    plan = parquet_sizes(spark, {"orders": f"{sf_dir}/orders.parquet"})
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<>" in text and "o_orderkey" not in text
    assert "content" not in text.split("FileScan binaryFile")[1].split("\n")[0].split("ReadSchema")[1]
