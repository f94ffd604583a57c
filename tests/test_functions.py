"""Column functions on hand-written inputs."""

import pytest
from pyspark.sql import functions as F

from plumbline.functions import answers as J
from plumbline.functions import errors as E
from plumbline.functions import identifiers as I
from plumbline.functions import numbers as N
from plumbline.functions import semi
from plumbline.functions import sql_text as S
from plumbline.functions import text as T


def run(spark, column, values, schema="x STRING"):
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, f"i INT, {schema}")
    return [r["y"] for r in df.select("i", column.alias("y")).orderBy("i").collect()]


X = F.col("x")


def test_shard_names(spark):
    names = ["EVENTS_20210107", "A_2020_1101", "T_123", "T_123456789", "_2020", "X_2020_b"]
    assert run(spark, I.shard_prefix(X), names) == ["EVENTS", "A_2020", None, None, None, None]
    assert run(spark, I.shard_key(X), names)[:2] == ["20210107", "1101"]


def test_quoting(spark):
    assert run(spark, I.quoted(X), ["ID", "id", "Id", "A_1", "é"]) == [
        "ID", '"id"', '"Id"', "A_1", '"é"',
    ]


def test_truncate(spark):
    assert run(spark, T.truncate(X, 3), ["abc", "abcd", "éèêë"]) == [
        "abc",
        "abc\n... (truncated)\n",
        "éèê\n... (truncated)\n",
    ]
    assert run(spark, T.truncate(X, 0), ["abcd"]) == ["abcd"]


def test_contents(spark):
    texts = ["# A \nx\r\n## B\r #no #C", "no heads", "", "#"]
    assert run(spark, T.contents(X), texts) == ["# A\n## B\n#C", "", "", "#"]
    assert run(spark, T.with_contents(X), texts)[1:3] == ["no heads", ""]


@pytest.mark.parametrize(
    "answer, sql",
    [
        ("```sql\nSELECT 1;\n```", "SELECT 1;"),
        ("```SQL\nSELECT 1\n```", "SELECT 1"),
        ("<thinking>a;\nb</thinking>\nSELECT 2", "SELECT 2"),
        ("```\n\n```", ""),
        (" SELECT 3 ", "SELECT 3"),
    ],
)
def test_answer_sql(spark, answer, sql):
    assert run(spark, S.from_answer(X), [answer]) == [sql]


def test_runnable(spark):
    texts = ["SELECT 1;;\n", "SELECT 1; SELECT 2", ";", "; SELECT 2", "SELECT ';' AS a", "```sql\na;\n```"]
    assert run(spark, S.runnable(X), texts) == ["SELECT 1", "SELECT 1", "", "; SELECT 2", "SELECT '", "a"]


def test_read_only_guard(spark):
    texts = ["select 1", "  DESC t", "WITH a AS (SELECT 1)", "", "drop table t", "selection"]
    assert run(spark, S.is_read_only(X), texts) == [True, True, False, False, False, False]


def test_row_cap(spark):
    texts = ["SELECT a;", "SELECT a LIMIT 3", "SHOW TABLES", "SELECT unlimited 3"]
    assert run(spark, S.capped(X), texts) == [
        "SELECT a\nLIMIT 5",
        "SELECT a LIMIT 3",
        "SHOW TABLES",
        "SELECT unlimited 3\nLIMIT 5",
    ]


def test_estimated_seconds(spark):
    fourteen_unions = "SELECT 1" + " UNION ALL SELECT 1" * 14
    texts = [fourteen_unions, "a JOIN b JOIN c UNION ALL x UNION all y UNION ALL z", "SELECT 1",
             "x LIKE '%a' RANK() " + "JOIN " * 30, "like '%a'"]
    assert run(spark, S.estimated_seconds(X), texts) == [270, 105, 60, 300, 60]


def test_error_kinds(spark):
    messages = [
        "SQL compilation error: invalid identifier 'A'",
        "object DOES NOT EXIST OR NOT AUTHORIZED",
        "unexpected: timed out",
        "Query execution timed out after 60 seconds",
        "role is not authorized",
        "disk full",
    ]
    assert run(spark, E.message_kind(X), messages) == [
        "syntax", "syntax", "syntax", "timeout", "permission", "runtime",
    ]
    kinds = E.execution_kind(F.col("ok"), X)
    assert run(spark, kinds, [(True, None), (False, None), (False, "")], "ok BOOLEAN, x STRING") == [
        "none", "runtime", "runtime",
    ]


def test_close(spark):
    pairs = [(1.0, 1.009), (1.0, 1.0101), (1e9, 1e9 + 1), (1e9, 1e9 + 1.1), (float("inf"),) * 2,
             (float("inf"), 1.0), (float("inf"), float("-inf"))]
    got = run(spark, F.expr(N.close_sql("a", "b")), pairs, "a DOUBLE, b DOUBLE")
    assert got == [True, False, True, False, True, False, False]


def test_number_texts(spark):
    texts = ["007", "1e3", ".5", "5.", "+2", "1d", "0x1", "1,000", "inf", "-Infinity", "True",
             "18446744073709551615", "18446744073709551616", "abc", "1" * 60]
    inf = float("inf")
    assert run(spark, N.number_of_text(X), texts) == [
        7.0, 1000.0, 0.5, 5.0, 2.0, None, None, None, inf, -inf, 1.0,
        18446744073709551615.0, None, None, None,
    ]


def test_distance(spark):
    metres = N.metres_between(*[F.col(c) for c in "abcd"])
    got = run(spark, metres, [(0.0, 0.0, 0.0, 90.0), (0.0, 0.0, 180.0, 0.0), (5.0, 5.0, 5.0, 5.0)],
              "a DOUBLE, b DOUBLE, c DOUBLE, d DOUBLE")
    assert [round(m) for m in got] == [10007543, 20015087, 0]


def test_paths(spark):
    texts = ['{"a": [{"b": 1}]}', '[{"a": 1}]', "none", None, '{"a": "x"}']
    assert run(spark, semi.path(X, "$.a[0].b", "int"), texts) == [1, None, None, None, None]


def test_unfenced_answers(spark):
    texts = ["```json\n[1]\n```\nmore", "```\n[1]\nlost", "x ```\n[1]\n```", "[1]", "```", '"[2]"']
    assert run(spark, J.json_text(X), texts) == ["[1]", "[1]", "x ```\n[1]\n```", "[1]", "", "[2]"]


def test_subtask_fallbacks(spark):
    texts = [
        '[{"id": 1, "description": "a"}, {"id": 2, "description": "b", "parent_id": 1, "level": 1}]',
        '[{"id": 1, "description": "a"}, {"id": 2}]',
        "nothing",
        '{"id": 1}',
        None,
    ]
    tree = J.tree_text(J.usable_tree(J.subtasks(X), F.lit("q?")))
    assert run(spark, tree, texts) == ["#1: a\n  #2: b (child of #1)"] + ["#1: q?"] * 4


def test_lessons_of_answer(spark):
    texts = ['[{"pattern": "p"}, {"error_type": "t", "pattern": "q", "fix": "f", "example": "e"}]', "no"]
    rows = run(spark, J.lessons(X), texts)
    assert [tuple(r) for r in rows[0]] == [
        ("other", "p", "Review and adjust", ""),
        ("t", "q", "f", "e"),
    ]
    assert rows[1] == []


def test_normal_pattern(spark):
    assert run(spark, T.normal_pattern(X), ["  A b\t\nrest", "a B"]) == ["a b", "a b"]


def test_truth_and_ids_of_any_type(spark):
    answer = (
        '[{"subtask_id": "1", "satisfied": 1}, {"subtask_id": 2.5, "satisfied": "yes"}, '
        '{"satisfied": 0}, {"satisfied": ""}, {"satisfied": []}, {"satisfied": {}}, '
        '{"satisfied": null, "reason": "r"}, {"satisfied": [0]}, {"satisfied": "false"}, {"satisfied": 0.0}]'
    )
    tree = F.array(F.struct(F.lit("1").alias("id")))
    row = spark.createDataFrame([(answer,)], "x STRING").withColumn("v", J.verdicts(F.col("x")))
    out = row.select(
        F.transform("v", lambda v: J.is_true(v.satisfied)).alias("t"),
        J.bullets(J.failed_verdicts(F.col("v"), tree)).alias("b"),
    ).first()
    assert out["t"] == [True, True, False, False, False, False, False, True, True, False]
    assert out["b"].split("\n")[4] == "- Subtask #?: r"
    ids = spark.createDataFrame(
        [('[{"id": "1", "description": "a"}, {"id": 1.0, "description": "b", "parent_id": "1", "level": 1}]',)],
        "x STRING",
    )
    text = ids.select(J.tree_text(J.usable_tree(J.subtasks(F.col("x")), F.lit("q?")))).first()[0]
    assert text == "#1: a\n  #1.0: b (child of #1)"
