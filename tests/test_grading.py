"""Grading rules on hand-written tables, and properties that must hold for any table."""

import math
import random

import pytest
from pyspark.sql import functions as F

from plumbline.operators import grading as G

INF = float("inf")
TABLES = (
    "instance_id STRING, variant INT, n_rows BIGINT, n_cols INT, readable BOOLEAN, "
    "read_error STRING"
)
CELLS = (
    "instance_id STRING, variant INT, col_idx INT, row_idx BIGINT, num DOUBLE, txt STRING, "
    "is_truth BOOLEAN"
)


def _frames(spark, tables):
    """``tables``: (instance, variant) -> list of columns of Python values."""
    shapes, cells = [], []
    for (instance, variant), columns in tables.items():
        n_rows = len(columns[0]) if columns else 0
        shapes.append((instance, variant, n_rows, len(columns), True, None))
        for c, column in enumerate(columns):
            for r, value in enumerate(column):
                if value is None:
                    continue
                number = not isinstance(value, str)
                cells.append(
                    (
                        instance,
                        variant,
                        c,
                        r,
                        float(value) if number else None,
                        None if number else value,
                        isinstance(value, bool),
                    )
                )
    return spark.createDataFrame(shapes, TABLES), spark.createDataFrame(cells, CELLS)


def grade(spark, cases):
    """``cases``: name -> (predicted columns or None, list of gold tables, condition, loose)."""
    preds = {(n, 0): c[0] for n, c in cases.items() if c[0] is not None}
    golds = {(n, i): g for n, c in cases.items() for i, g in enumerate(c[1])}
    standards = spark.createDataFrame(
        [(n, c[2], c[3]) for n, c in cases.items()],
        "instance_id STRING, condition_cols_raw STRING, ignore_order BOOLEAN",
    )
    graded = G.grade(standards, *_frames(spark, preds), *_frames(spark, golds))
    return {r["instance_id"]: r["status"] for r in graded.collect()}


VECTORS = [
    ([1.0, 2.0], [1.009, 2.0], False, True),
    ([1.0], [1.0101], False, False),
    ([26327039.85], [26327039.87], False, True),
    ([1, 2], [2, 1], False, False),
    ([1, 2], [2, 1], True, True),
    ([9.999, 20.0], [20.0, 10.001], True, True),
    ([None, 3], [3, None], True, True),
    ([None, 3], [3, None], False, False),
    ([None], [0], False, False),
    ([None, None], [None, None], False, True),
    (["a"], ["A"], False, False),
    (["b", "a", "a"], ["a", "b", "a"], True, True),
    (["b", "a", "a"], ["a", "b", "b"], True, False),
    (["1", "x"], [1, 2], False, False),
    ([INF], [INF], False, True),
    ([INF], [5.0], False, False),
    ([INF, 1.0], [1.004, INF], True, True),
    ([-INF], [INF], False, False),
    ([], [], False, True),
    ([], [], True, True),
    ([1.0], [1.0, 1.0], False, False),
    ([0.0], [-0.0], False, True),
    ([True, False], [1, 0], False, True),
    ([1e300, 1.0], [1e300, 1.005], True, True),
    ([5, 5, 5, 6], [5.009, 5.0, 4.995, 6], True, True),
    ([5, 5, 5, 6], [5, 5, 6, 6], True, False),
]


@pytest.fixture(params=["arrays", "spread", "spread and joined"], autouse=True)
def route(request, monkeypatch):
    """Every rule must hold for small and for large columns, and for few and many of them."""
    if request.param != "arrays":
        monkeypatch.setattr(G, "SMALL_COLUMN", 0)
    if request.param == "spread and joined":
        monkeypatch.setattr(G, "BROADCAST_PAIRS", 0)


def test_vectors(spark):
    cases = {
        f"v{i}": ([pred], [[gold]], "[]", loose)
        for i, (gold, pred, loose, _) in enumerate(VECTORS)
    }
    expected = {
        f"v{i}": G.CORRECT if fits else G.WRONG for i, (*_, fits) in enumerate(VECTORS)
    }
    assert grade(spark, cases) == expected


def test_columns_conditions_and_variants(spark):
    a, b, c = [1.0, 2.0], ["x", "y"], [7, 8]
    wrong = [9.0, 9.5]
    near_a = [1.003, 2.0]
    cases = {
        "names_and_extras": ([b, a, wrong], [[a, b]], "[]", False),
        "reused_column": ([near_a], [[a, a]], "[]", False),
        "chosen_column": ([a], [[wrong, a]], "[1]", False),
        "chosen_negative": ([a], [[wrong, a]], "[-1]", False),
        "chosen_absent": ([a], [[wrong, a]], "[5]", False),
        "flat_for_single_gold": ([a, b], [[a, b, wrong]], "[0, 1]", False),
        "flat_zero": ([a], [[a, wrong]], "[0]", False),
        "flat_for_all": ([a], [[wrong, a], [a, wrong]], "[0]", False),
        "nested": ([a], [[wrong, b], [wrong, a]], "[[0], [1]]", False),
        "nested_empty_is_all": ([a], [[a, wrong], [a]], "[[1], []]", False),
        "nested_too_short": ([a, c], [[wrong], [a, c]], "[[0]]", False),
        "null_is_all": ([a], [[a, wrong]], "[null]", False),
        "absent_is_all": ([a], [[a, wrong]], None, False),
        "second_gold": ([c], [[a], [c]], "[]", False),
        "no_gold": ([a], [], "[]", False),
        "no_prediction": (None, [[a]], "[]", False),
        "gold_without_columns": ([a], [[]], "[]", False),
        "prediction_without_columns": ([], [[a]], "[]", False),
    }
    assert grade(spark, cases) == {
        "names_and_extras": G.CORRECT,
        "reused_column": G.CORRECT,
        "chosen_column": G.CORRECT,
        "chosen_negative": G.CORRECT,
        "chosen_absent": G.WRONG,
        "flat_for_single_gold": G.CORRECT,
        "flat_zero": G.CORRECT,
        "flat_for_all": G.CORRECT,
        "nested": G.CORRECT,
        "nested_empty_is_all": G.CORRECT,
        "nested_too_short": G.CORRECT,
        "null_is_all": G.WRONG,
        "absent_is_all": G.WRONG,
        "second_gold": G.CORRECT,
        "no_gold": G.MISSING_GOLD,
        "no_prediction": G.MISSING,
        "gold_without_columns": G.CORRECT,
        "prediction_without_columns": G.WRONG,
    }


def _close(a, b):
    if a is None or b is None:
        return a is None and b is None
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    return a == b or (
        math.isfinite(a)
        and math.isfinite(b)
        and abs(a - b) <= max(1e-2, 1e-9 * max(abs(a), abs(b)))
    )


def _brute(pred, gold, loose):
    def arranged(column):
        if not loose:
            return column
        return sorted(column, key=lambda v: (v is None, isinstance(v, str), v if v is not None else 0))

    return all(
        any(
            len(g) == len(p) and all(_close(x, y) for x, y in zip(arranged(g), arranged(p)))
            for p in pred
        )
        for g in gold
    )


@pytest.mark.parametrize("seed", [1])
def test_random_tables_against_brute_force(spark, seed):
    rng = random.Random(seed)
    cases, expected = {}, {}
    for i in range(150):
        n = rng.choice([0, 1, 3, 6])
        loose = rng.random() < 0.5

        def column():
            if rng.random() < 0.3:
                return [rng.choice(["a", "b", None]) for _ in range(n)]
            base = rng.choice([0, 5, 1e8])
            return [
                None if rng.random() < 0.1 else base + rng.choice([0, 0.004, 0.012, 1.0, 2.5])
                for _ in range(n)
            ]

        gold = [column() for _ in range(rng.choice([1, 2, 3]))]
        pred = [list(g) for g in gold] + [column()]
        rng.shuffle(pred)
        if rng.random() < 0.7 and n:
            target = rng.choice(pred)
            at = rng.randrange(n)
            if target[at] is not None and not isinstance(target[at], str):
                target[at] += rng.choice([0.003, 0.02, -0.008, 0.1])
        if loose:
            for p in pred:
                rng.shuffle(p)
        cases[f"r{i}"] = (pred, [gold], "[]", loose)
        expected[f"r{i}"] = G.CORRECT if _brute(pred, gold, loose) else G.WRONG
    assert set(expected.values()) == {G.CORRECT, G.WRONG}
    assert grade(spark, cases) == expected


def test_heavy_instance_with_repeated_values(spark):
    """One instance holds nearly all rows, most of them one value; noise needs the cells."""
    n = 60_000
    gold = (
        spark.range(n)
        .withColumn("inst", F.when(F.col("id") < n - 50, "hot").otherwise("cold"))
        .withColumn("v", F.when(F.col("id") % 3 == 0, 1.0).otherwise(F.col("id") / 7))
    )
    pred = gold.withColumn("v", F.col("v") + 0.003).withColumn("id", -F.col("id"))
    standards = spark.createDataFrame(
        [("hot", "[]", True), ("cold", "[]", True)],
        "instance_id STRING, condition_cols_raw STRING, ignore_order BOOLEAN",
    )

    def sides(df):
        return G.tables_of(df, "inst", ["v"]), G.cells_of(df, "inst", "id", ["v"])

    assert {
        r["instance_id"]: r["status"]
        for r in G.grade(standards, *sides(pred), *sides(gold)).collect()
    } == {"hot": G.CORRECT, "cold": G.CORRECT}
    off = pred.withColumn("v", F.when(F.col("id") == -31, F.col("v") + 0.02).otherwise(F.col("v")))
    assert {
        r["instance_id"]: r["status"]
        for r in G.grade(standards, *sides(off), *sides(gold)).collect()
    } == {"hot": G.WRONG, "cold": G.CORRECT}


def test_more_columns_or_golds_never_harm(spark):
    gold = [[1.0, 2.0, 3.0], ["a", "b", "c"]]
    extra = [[5.0, 5.0, 5.0], ["z", "z", "z"], [None, None, None]]
    cases = {
        "base": (gold, [gold], "[]", False),
        "more_columns": (extra + gold, [gold], "[]", False),
        "more_golds": (gold, [extra, gold], "[]", False),
        "rows_permuted": ([[3.0, 1.0, 2.0], ["c", "a", "b"]], [gold], "[]", True),
        "noise": ([[1.004, 2.0, 2.996], ["a", "b", "c"]], [gold], "[]", False),
    }
    assert set(grade(spark, cases).values()) == {G.CORRECT}


def test_report_of_nothing(spark):
    grades = spark.createDataFrame([], "instance_id STRING, status STRING")
    row = G.report(grades).first().asDict()
    assert row["total"] == 0 and row["accuracy"] == 0.0 and row["accuracy_evaluated"] == 0.0


def test_untyped_columns(spark):
    """Column kinds of text cells: numbers, truth values, big integers, mixed."""
    columns = {
        "numbers": ["007", "7.50", " 8", "1e3"],
        "truths": ["True", "false", None, "TRUE"],
        "mixed_truth": ["True", "1", "0", "1"],
        "big": ["99999999999999999999", "1", "2", "3"],
        "odd": ["1d", "1", "2", "3"],
        "nulls": ["NA", "", "null", "NaN"],
        "infinite": ["inf", "-Infinity", "1", "2"],
    }
    raw = [
        ("i", 0, c, r, v)
        for c, values in enumerate(columns.values())
        for r, v in enumerate(values)
    ]
    cells = G.cells_of_text(
        spark.createDataFrame(
            raw, "instance_id STRING, variant INT, col_idx INT, row_idx BIGINT, raw STRING"
        )
    )
    tables = spark.createDataFrame([("i", 0, 4, len(columns), True, None)], TABLES)
    kinds = {
        list(columns)[r["col_idx"]]: r["kind"] for r in G.column_facts(tables, cells).collect()
    }
    assert kinds == {
        "numbers": "number",
        "truths": "number",
        "mixed_truth": "text",
        "big": "text",
        "odd": "text",
        "nulls": "any",
        "infinite": "number",
    }


def test_failures_are_shown_in_the_order_of_the_standards(spark):
    schema = "instance_id string, error_type string, sql string, error_message string, details string, nlq string"
    failed = spark.createDataFrame([(i, "e", "s", "m", "", "q") for i in ("a", "b", "c", "d")], schema)
    standards = spark.createDataFrame([("d", 0), ("b", 1), ("a", 2), ("d", 7)], "instance_id string, pos bigint")

    def shown(**options):
        row = G.failure_digest(failed, **options).first()
        return row["n_failures"], [part.split("\n")[0][-1] for part in row["digest"].split("\n---\n")]

    assert shown(standards=standards) == (4, ["d", "b", "a", "c"])
    assert shown(size=2, standards=standards) == (2, ["d", "b"])
    assert shown(size=2) == (2, ["a", "b"])
