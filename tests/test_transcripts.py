"""Whole transcripts against putting them together by hand."""

from plumbline.operators import prompts as P
from plumbline.operators.transcripts import transcripts

STEPS = "instance_id string, step int, ready boolean, sql string, success boolean, n_rows int, rows_json string, message string"


def block(sql, result, capped=False):
    note = P.CAP_NOTE if capped else ""
    return f"{note}**Agent Recon Query:**\n```sql\n{sql}\n```\n\n**Database Result:**\n{result}\n\n"


def made(spark, budget=10_000):
    instances = [("a", "d1"), ("b", "d1"), ("c", None), ("d", "unknown"), ("e", "d2")]
    steps = [
        ("a", 3, True, None, None, None, None, None),
        ("a", 2, None, "select 1", True, 1, '[{"x": 1}]', None),
        ("a", 1, False, "select 2 limit 3", False, None, None, "no such table"),
        ("a", 4, False, "select 9", True, 1, "late", None),
        ("a", 5, True, None, None, None, None, None),
        ("c", 1, True, None, None, None, None, None),
        ("d", 1, False, "show tables", True, 0, None, None),
        ("z", 1, False, "select 0", True, 0, None, None),
    ]
    rosters = [("d1", "ROSTER 1\n\n"), ("d2", "r" * 500), ("d3", "never")]
    df = transcripts(
        spark.createDataFrame(instances, "instance_id string, db_id string"),
        spark.createDataFrame(steps, STEPS),
        spark.createDataFrame(rosters, "db_id string, roster string"),
        budget,
        100,
    )
    return {r["instance_id"]: r["transcript"] for r in df.collect()}


def test_roster_steps_and_ready(spark):
    head = P.TRANSCRIPT_HEAD
    assert made(spark) == {
        "a": head
        + "ROSTER 1\n\n"
        + block("select 2 limit 3", P.QUERY_ERROR + "no such table")
        + block("select 1\nLIMIT 5", '[{"x": 1}]', capped=True)
        + P.READY_NOTE,
        "b": head + "ROSTER 1\n\n",
        "c": head + P.READY_NOTE,
        "d": head + block("show tables", P.NO_ROWS),
        "e": head + "r" * 500,
    }


def test_cut_to_the_budget(spark):
    whole, cut = made(spark), made(spark, 200)
    assert {k: v[:200] for k, v in cut.items()} == {k: v[:200] for k, v in whole.items()}
    assert [k for k in sorted(cut) if "truncated)" in cut[k]] == ["a", "e"]
