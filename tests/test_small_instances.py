"""Instances with small tables are compared where their rows meet."""

from pyspark.sql import functions as F

from plumbline.operators import grading as G


def _sides(spark, rows):
    df = spark.createDataFrame(rows, "inst string, pos bigint, a double, b string")
    return G.tables_of(df, "inst", ["a", "b"]), df


def test_small_instances_meet_by_one_shuffle_of_rows(spark, monkeypatch):
    """Noise in many instances: no cells are shuffled, and the verdicts are those of the steps."""
    rows = [(f"i{i}", p, i + p / 8 if p % 5 else None, "xyz"[p % 3]) for i in range(40) for p in range(6)]
    moved = [
        (i, 5 - p, v if v is None else v + (0.004 if int(i[1:]) % 2 else 0.02), t) for i, p, v, t in rows
    ]
    moved[7] = (*moved[7][:3], "other")
    (gold_tables, gold), (pred_tables, pred) = _sides(spark, rows), _sides(spark, moved)
    standards = gold_tables.selectExpr(
        "instance_id", "'[[null, 0], [0]]' AS condition_cols_raw", "instance_id <> 'i3' AS ignore_order"
    )
    standards = standards.withColumn(
        "condition_cols_raw", F.expr("IF(instance_id = 'i1', '[]', IF(instance_id = 'i5', condition_cols_raw, '[0]'))")
    )

    def verdicts(shape):
        sides = [pred_tables, shape(pred, "inst", "pos", ["a", "b"])]
        sides += [gold_tables, shape(gold, "inst", "pos", ["a", "b"])]
        got = G.match_golds(standards, *sides)
        return got, sorted(map(tuple, got.collect()))

    one, found = verdicts(G.rows_of)
    plan = one._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.split("\n") if "Exchange hashpartitioning" in line]
    assert not any("col_idx" in line or "row_idx" in line and "REPARTITION" not in line for line in exchanges)
    want = [(f"i{i}", 0, i % 2 == 1 and i not in (1, 3, 5)) for i in range(40)]
    assert found == sorted(want)
    assert verdicts(G.cells_of)[1] == found
    for name, value in (("SMALL_PAIRS", 0), ("SMALL_COLUMN", 3), ("SMALL_CELLS", 20)):
        with monkeypatch.context() as patch:
            patch.setattr(G, name, value)
            assert verdicts(G.rows_of)[1] == found


def test_small_and_large_instances_together(spark):
    """Rows without an instance are left out; a large instance takes its own way."""
    n = G.SMALL_COLUMN + 5
    rows = spark.range(n + 8).selectExpr(
        f"CASE WHEN id < {n} THEN 'large' WHEN id < {n} + 4 THEN 'small' WHEN id < {n} + 6 THEN 'off' END AS inst",
        "id AS pos", "id / 3.0D AS a", "'t' AS b",
    )
    pred = rows.withColumn("a", F.col("a") + F.when(F.col("inst") == "off", 0.5).otherwise(0.004))

    def side(df):
        return G.tables_of(df, "inst", ["a", "b"]), G.rows_of(df, "inst", "pos", ["a", "b"])

    standards = side(rows)[0].selectExpr("instance_id", "'[]' AS condition_cols_raw", "false AS ignore_order")
    got = G.match_golds(standards, *side(pred), *side(rows))
    assert {r["instance_id"]: r["matched"] for r in got.collect()} == {"large": True, "small": True, "off": False}
