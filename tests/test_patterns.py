"""A table of patterns against trying them all in order."""

import random

import pytest
from pyspark.sql import functions as F

from plumbline.functions import errors as E
from plumbline.operators import patterns

KIND = "priority bigint, pattern string, kind string"


def brute(message, table):
    fits = [
        (p, n.lower(), k) for p, n, k in table if message is not None and n is not None and n.lower() in message.lower()
    ]
    return min(fits)[2] if fits else "other"


@pytest.mark.parametrize("limit", [patterns.BROADCAST_PATTERNS, 0])
@pytest.mark.parametrize("seed", range(2))
def test_against_all_patterns(spark, limit, seed):
    rng = random.Random(seed)
    say = lambda n: "".join(rng.choice("abAB é\U0001f600.%_\n") for _ in range(n))
    table = [(rng.randrange(30), say(rng.randint(1, 9)), f"k{i}") for i in range(60)] + [(5, None, "null")]
    table += [table[0], (99, "", "empty")] if seed else [(7, "aB", "first"), (7, "AB", "second")]
    texts = [None, "", *[say(rng.randint(0, 30)) for _ in range(150)], "x" * 200_000 + table[3][1]]
    texts += texts[5:20] * 3
    rows = spark.createDataFrame(
        [(i, t, "c") for i, t in enumerate(texts)], "id int, message string, text string"
    )
    got = patterns.classify(rows, "message", spark.createDataFrame(table, KIND), "other", "kind", limit)
    assert got.columns == ["id", "message", "text", "kind"]
    want = [(i, brute(t, table)) for i, t in enumerate(texts)]
    assert sorted((r["id"], r["kind"]) for r in got.collect()) == want


def test_the_fixed_texts_as_rows(spark):
    table = [(i, n, k) for i, (n, k) in enumerate(E.ERROR_KINDS)]
    rng = random.Random(3)
    messages = [
        (" / ".join(rng.choice(table)[1] for _ in range(rng.randint(1, 3))) + rng.choice(["", " at 7"]),)
        for _ in range(200)
    ]
    rows = spark.createDataFrame([*messages, ("nothing",)], "message string").withColumn(
        "chain", E.message_kind(F.col("message"))
    )
    got = patterns.classify(rows, "message", spark.createDataFrame(table, KIND), E.OTHER_KIND)
    assert got.where("chain <> kind").count() == 0 and got.count() == 201


def test_many_patterns_meet_few_messages(spark):
    table = spark.range(10_000).selectExpr("id AS priority", "'code ' || id || ' in' AS pattern", "id || '' AS kind")
    rows = spark.range(3000).selectExpr("id", "'Error CODE ' || id * 4 || ' IN unit' AS message")
    got = patterns.classify(rows, "message", table, "none")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    wrong = got.where("kind <> CASE WHEN id < 2500 THEN string(id * 4) ELSE 'none' END")
    assert wrong.count() == 0 and got.count() == 3000


def test_empty(spark):
    rows = spark.createDataFrame([("a",)], "message string")
    none = spark.createDataFrame([], KIND)
    assert [r["kind"] for r in patterns.classify(rows, "message", none, "other").collect()] == ["other"]
    assert patterns.classify(rows.limit(0), "message", none, "other").count() == 0


def test_patterns_met_do_not_grow_with_the_table(spark):
    """Alike patterns are filed under longer pieces, and pieces that begin like none stay away."""
    table = spark.range(40_000).selectExpr("id AS priority", "'user ' || id || ';' AS pattern", "id || '' AS kind")
    index = patterns.pattern_index(table)
    assert index.count() == 40_000
    most = index.groupBy("gram").count().agg(F.max("count")).first()[0]
    assert most <= patterns.SHARED
    texts = spark.range(500).selectExpr("'003540: by user ' || id * 97 || '; near the end of it' AS text")
    spelt = texts.withColumn("chars", patterns._chars(F.col("text")))
    for limit in (patterns.BROADCAST_PATTERNS, 0):
        assert patterns._met(spelt, index, limit).count() <= 500 * 16
    plan = patterns._met(spelt, index, 0)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    rows = spark.range(600).selectExpr("id", "'003540: by USER ' || id * 97 || '; near' AS message")
    got = patterns.classify(rows, "message", table, "none", broadcast_patterns=0)
    assert got.where("kind <> IF(id * 97 < 40000, string(id * 97), 'none')").count() == 0 and got.count() == 600
