"""Readers and writers on small files."""

import json

import pandas as pd
from pyspark.sql import functions as F

from plumbline.functions import sql_text as S
from plumbline.operators import catalogue as C
from plumbline.operators import grading as G
from plumbline.operators import records as R
from plumbline.operators import batch
from plumbline.sources import context_files, questions, record_files, result_csv, shards
from plumbline.sources.tables import SCHEMAS, load


def _write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")


def test_declared_schemas(spark, sf_dir):
    for name in SCHEMAS:
        stored = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema.simpleString()
        assert load(spark, sf_dir, name).schema.simpleString() == stored


def test_questions(spark, tmp_path):
    lines = [
        {"instance_id": "a", "instruction": "i", "question": "q", "db_id": "D"},
        {"instance_id": "b", "question": "q2", "external_knowledge": "x.md"},
        {"instance_id": "a", "question": "later"},
        {"instance_id": "c"},
    ]
    _write(tmp_path / "q.jsonl", "\n".join(map(json.dumps, lines)) + "\n\n")
    read = questions.read_questions(spark, str(tmp_path / "q.jsonl"))
    rows = {r["instance_id"]: tuple(r)[1:4] for r in read.collect()}
    assert rows == {"a": ("later", "", ""), "b": ("q2", "", "x.md"), "c": ("", "", "")}

    def ids(df):
        return sorted(r["instance_id"] for r in df.collect())

    assert ids(questions.choose(read, limit=2)) == ["a", "b"]
    assert ids(questions.choose(read, limit=1, ids=["c", "z"])) == ["c"]
    assert ids(questions.choose(read)) == ["a", "b", "c"]


def test_standards(spark, tmp_path):
    lines = [
        '{"instance_id": "a", "condition_cols": [[0, 1], [2]], "ignore_order": true}',
        '{"instance_id": "b", "condition_cols": []}',
        '{"instance_id": "c"}',
    ]
    _write(tmp_path / "s.jsonl", "\n".join(lines))
    read = questions.read_standards(spark, str(tmp_path / "s.jsonl"))
    rows = {r["instance_id"]: (r["condition_cols_raw"], r["ignore_order"]) for r in read.collect()}
    assert rows == {"a": ("[[0,1],[2]]", True), "b": ("[]", False), "c": (None, False)}
    assert questions.read_standards(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_grading_from_files(spark, tmp_path):
    pred, gold = tmp_path / "pred", tmp_path / "gold"
    _write(pred / "one.csv", 'n,"t, x"\n1.004,"a, b"\n2,"say ""hi"""\n,NA\n')
    _write(gold / "one_a.csv", "k\n9\n")
    _write(gold / "one_b.csv", 'k,extra\n"a, b",1\n"say ""hi""",2\n,\n')
    _write(pred / "two.csv", "")
    _write(gold / "two.csv", "a\n1\n")
    _write(pred / "three.csv", "a,b\n1,2\n1,2,3\n")
    _write(gold / "three.csv", "a\n1\n")
    _write(gold / "four.csv", "a\n1\n")
    _write(pred / "five.csv", "a\n1\n")
    _write(pred / "six_a.csv", "multi\n\"line one\nline two\"\n7\n")
    _write(gold / "six_a.csv", "m,o\n\"line one\nline two\",1\n7,2\n")
    _write(pred / "seven.csv", "a,b\n")
    _write(gold / "seven.csv", "z\n")
    _write(pred / "eight.csv", "x\nTrue\nFalse\n")
    _write(gold / "eight.csv", "x\n1.0\n0\n")
    for i in range(3):
        part = pred / "nine.csv" / f"part-0000{i}.csv"
        _write(part, "v\n" + "".join(f"{10 * i + j}\n" for j in range(4)))
    _write(gold / "nine.csv", "v\n" + "".join(f"{10 * i + j}\n" for i in range(3) for j in range(4)))
    _write(pred / "one.sql", "SELECT 1\n;")
    rows = [(i, "[[], [0]]" if i == "one" else "[0]", False)
            for i in "one two three four five six_a seven eight nine".split()]
    standards = spark.createDataFrame(
        rows, "instance_id STRING, condition_cols_raw STRING, ignore_order BOOLEAN"
    )
    predicted = result_csv.read_predictions(spark, str(pred))
    golds = result_csv.read_golds(spark, str(gold), standards)
    grades = G.grade(standards, *predicted, *golds)
    assert {r["instance_id"]: r["status"] for r in grades.collect()} == {
        "one": G.CORRECT,
        "two": G.BROKEN,
        "three": G.BROKEN,
        "four": G.MISSING,
        "five": G.MISSING_GOLD,
        "six_a": G.CORRECT,
        "seven": G.CORRECT,
        "eight": G.CORRECT,
        "nine": G.CORRECT,
    }
    sql = result_csv.read_sql_texts(spark, str(pred))
    asked = spark.createDataFrame([("two", "why?")], "instance_id STRING, nlq STRING")
    failures = {r["instance_id"]: r for r in G.failures(grades, sql, asked).collect()}
    assert set(failures) == {"two", "three", "four"}
    assert failures["two"]["nlq"] == "why?" and failures["four"]["error_type"] == G.BROKEN
    assert failures["two"]["error_message"] == G.UNREADABLE + result_csv.NO_COLUMNS
    assert [tuple(r) for r in sql.collect()] == [("one", "SELECT 1\n;")]


def test_a_file_is_judged_by_its_own_header(spark, tmp_path):
    """Alone, beside a wider file, and with blank or quoted header cells."""
    _write(tmp_path / "a" / "wide.csv", "a,b\n1,2\n3,4,5\n")
    for name in ("wide", "other"):
        _write(tmp_path / "b" / f"{name}.csv", "a,b\n3,4,5\n" if name == "wide" else "p,q,r,s\n1,2,3,4\n")
    _write(tmp_path / "b" / "blank.csv", 'a,b,\n1,2,3\n4,5,\n')
    _write(tmp_path / "b" / "quoted.csv", '"a,b",c\n1,2\n')
    _write(tmp_path / "b" / "late.csv", "a,b\n3,4,,6\n")

    def shapes(folder):
        tables, cells = result_csv.read_predictions(spark, str(tmp_path / folder))
        counts = {r["instance_id"]: r["count"] for r in cells.groupBy("instance_id").count().collect()}
        return {
            r["instance_id"]: (r["n_rows"], r["n_cols"], r["readable"], counts.get(r["instance_id"], 0))
            for r in tables.collect()
        }

    assert shapes("a") == {"wide": (2, 2, False, 0)}
    assert shapes("b") == {
        "wide": (1, 2, False, 0),
        "other": (1, 4, True, 4),
        "blank": (2, 3, True, 5),
        "quoted": (1, 2, True, 2),
        "late": (1, 2, False, 0),
    }


def test_positions_hold_when_files_are_split_in_another_way(spark, tmp_path):
    for k in range(12):
        _write(tmp_path / f"t{k}.csv", "a\n" + "".join(f"{i}\n" for i in range(210)))
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    tables, cells = result_csv.read_predictions(spark, str(tmp_path))
    try:
        spark.conf.set(name, "200")
        assert cells.count() == 12 * 210 and tables.agg(F.sum("n_rows")).first()[0] == 12 * 210
        assert cells.filter("num != row_idx").count() == 0
    finally:
        spark.conf.set(name, before)


def test_no_predictions_at_all(spark, tmp_path):
    (tmp_path / "p").mkdir()
    tables, cells = result_csv.read_predictions(spark, str(tmp_path / "p"))
    assert tables.count() == 0 and cells.count() == 0


def test_gold_of_two_ids(spark, tmp_path):
    _write(tmp_path / "x.csv", "a\n1\n")
    _write(tmp_path / "x_a.csv", "a\n2\n")
    _write(tmp_path / "x_0.csv", "a\n3\n")
    standards = spark.createDataFrame([("x",), ("x_a",)], "instance_id STRING")
    _, cells = result_csv.read_golds(spark, str(tmp_path), standards)
    assert sorted((r["instance_id"], r["variant"], r["num"]) for r in cells.collect()) == [
        ("x", 0, 1.0),
        ("x", 1, 3.0),
        ("x", 2, 2.0),
        ("x_a", 0, 2.0),
    ]


def test_store_and_read_result(spark, tmp_path):
    df = spark.range(100).select(F.col("id").alias("n"), F.concat(F.lit('a"'), "id").alias("t"))
    result_csv.store_result(spark, str(tmp_path), "q1", "SELECT\n1", df.repartition(4).sort("n"))
    result_csv.store_result(spark, str(tmp_path), "q2", "SELECT 2", None)
    tables, cells = result_csv.read_predictions(spark, str(tmp_path))
    assert [(r["instance_id"], r["n_rows"], r["n_cols"]) for r in tables.collect()] == [("q1", 100, 2)]
    numbers = {r["row_idx"]: r["num"] for r in cells.filter("col_idx = 0").collect()}
    assert numbers == {i: float(i) for i in range(100)}
    texts = result_csv.read_sql_texts(spark, str(tmp_path)).collect()
    sql = {r["instance_id"]: r["sql"].strip() for r in texts}
    assert sql == {"q1": "SELECT\n1", "q2": "SELECT 2"}


def test_ddl_columns_by_their_own_header(spark, tmp_path):
    base = tmp_path / "base"
    _write(base / "D" / "S1" / "DDL.csv", 'table_name,DDL\nT1,"create, one"\n')
    _write(base / "D" / "S2" / "DDL.csv", 'table_name,description,DDL\nT1,about,two\n')
    _write(base / "base" / "S3" / "DDL.csv", 'ddl,Table_Name\nthree,T3\n')
    many = [f"c{k}" for k in range(70)]
    _write(base / "D" / "S4" / "DDL.csv", ",".join([*many, "table_name", "DDL"]) + "\n" + "x," * 70 + 'T4,"of two\nlines"\n')
    rows = context_files.read_ddl(spark, str(base)).drop("pos").collect()
    assert sorted(tuple(r) for r in rows) == [
        ("D", "S1", "T1", "create, one"),
        ("D", "S2", "T1", "two"),
        ("D", "S4", "T4", "of two\nlines"),
        ("base", "S3", "T3", "three"),
    ]


def test_ddl_files_and_schema_text(spark, tmp_path):
    base = tmp_path / "databases"
    tables = pd.DataFrame(
        {"table_name": ["E_20200101", "E_20200102", "E_20200103", "U", "P_2020"],
         "DDL": [f'create table t{i} (\n "c" int\n);' for i in range(5)]}
    )
    (base / "DB" / "S1").mkdir(parents=True)
    tables.to_csv(base / "DB" / "S1" / "DDL.csv", index=False)
    (base / "DB" / "deep" / "S0").mkdir(parents=True)
    tables.iloc[3:4].to_csv(base / "DB" / "deep" / "S0" / "DDL.csv", index=False)
    ddl = context_files.read_ddl(spark, str(base))
    assert ddl.count() == 6
    text = C.schema_texts(ddl, 0).first()["ddl"]
    head = "DATABASE: DB | SCHEMA: {0}\nFull path format: DB.{0}.TABLE_NAME\n" \
           "IMPORTANT: Quote column names exactly as shown in DDL.\n\n"  # fmt: skip
    regular = 'TABLES: U\n\nTABLE STRUCTURES:\n\n-- DB.S0.U\ncreate table t3 (\n "c" int\n);\n\n'
    group = (
        "PARTITIONED TABLES — prefix 'E' (3 tables):\n"
        "- Pattern: E_<KEY> (key range: 20200101 to 20200103)\n"
        "- Use UNION ALL to query across multiple partitions (no wildcards).\n\n"
        "SAMPLE STRUCTURE (all 'E' tables share this schema):\n"
        'Table: DB.S1.E_<KEY>\ncreate table t0 (\n "c" int\n);\n\n'
    )
    rest = (
        "TABLES: U, P_2020\n\nTABLE STRUCTURES:\n\n"
        '-- DB.S1.U\ncreate table t3 (\n "c" int\n);\n\n'
        '-- DB.S1.P_2020\ncreate table t4 (\n "c" int\n);\n\n'
    )
    whole = head.format("S0") + regular + "\n" + head.format("S1") + group + rest
    assert text == whole
    for budget in (len(whole), len(whole) - 1, len(whole) - 60, 200, 30):
        expected = whole
        if len(whole) > budget:
            cut = whole.rfind("\n\n--", 0, budget)
            expected = whole[: cut if cut != -1 else budget] + "\n... (truncated)\n"
        assert C.schema_texts(ddl, budget).first()["ddl"] == expected


def test_documents(spark, tmp_path):
    _write(tmp_path / "a.md", "# A\ntext\n")
    _write(tmp_path / "b.md", "plain")
    rows = {r["name"]: r["content"] for r in context_files.read_documents(spark, str(tmp_path)).collect()}
    assert rows == {"a.md": "# A\ntext\n", "b.md": "plain"}
    assert context_files.read_documents(spark, str(tmp_path / "none")).count() == 0


def test_live_catalogue(spark):
    spark.range(1).selectExpr("id AS N", "'x' AS lower").createOrReplaceTempView("cat_view")
    names = [r["table_name"] for r in context_files.list_tables(spark).collect()]
    assert "cat_view" in names
    columns = context_files.list_columns(spark, [("", "cat_view")])
    assert [tuple(r)[2:] for r in columns.collect()] == [(1, "N", "BIGINT"), (2, "lower", "STRING")]
    tables = spark.createDataFrame([("", "cat_view", 0)], "schema_name STRING, table_name STRING, pos LONG")
    lines = C.column_roster(tables, columns)
    assert lines.first()["line"] == '.cat_view: N (BIGINT), "lower" (STRING)'
    roster = C.roster_text(lines.withColumn("db_id", F.lit("d")), "db_id").first()["roster"]
    assert roster == C.ROSTER_HEAD + lines.first()["line"] + C.ROSTER_TAIL


def test_lessons_roundtrip(spark, tmp_path):
    path = str(tmp_path / "lessons")
    lessons = spark.createDataFrame(
        [(i, "2024-01-01 10:00", "syntax", f"pattern {i}", "fix `a`", "SELECT '`'") for i in range(7)],
        "seq LONG, ts STRING, error_type STRING, pattern STRING, fix STRING, example_sql STRING",
    )
    record_files.write_lessons(lessons.repartition(3), path)
    read = record_files.read_lessons(spark, path)
    rows = sorted(tuple(r) for r in read.collect())
    assert [r[1:] for r in rows] == [tuple(r)[1:] for r in lessons.sort("seq").collect()]
    assert record_files.read_lessons(spark, str(tmp_path / "none")).count() == 0


def test_step_logs(spark, tmp_path):
    log = {
        "instance_id": "a",
        "total_elapsed_ms": 90,
        "steps": [
            {"step": "context_loaded", "timestamp": "t", "elapsed_ms": 5, "db_id": "D"},
            {"step": "decomposed", "timestamp": "t", "elapsed_ms": 30, "subtasks": [{"id": 1, "desc": "x"}]},
            {"step": "executed", "timestamp": "t", "elapsed_ms": 90, "success": False, "error": "e"},
        ],
    }
    _write(tmp_path / "a_log.json", json.dumps(log, indent=2))
    logs = record_files.read_step_logs(spark, str(tmp_path))
    got = [tuple(r) for r in R.array_step_durations(logs).sort("position").collect()]
    assert got == [("a", 1, "context_loaded", 5), ("a", 2, "decomposed", 25), ("a", 3, "executed", 60)]
    record_files.write_step_logs(logs, str(tmp_path / "stored"))
    assert spark.read.parquet(str(tmp_path / "stored")).first()["steps"][2]["error"] == "e"
    record_files.write_log_lines(logs, str(tmp_path / "lines"))
    again = record_files.read_step_logs(spark, str(tmp_path / "lines"))
    assert again.collect() == logs.collect()


def test_a_plain_text_is_the_only_detail(spark):
    failed = spark.createDataFrame([("a", "x", "t", "m" * 600)], "instance_id string, failure_type string, ts string, m string")
    assert R.hard_failures(failed, F.col("m")).first()["details"] == {"value": "m" * 500}


def test_attempts_and_time_limits_are_parameters(spark):
    rows = [("a", 1, "syntax", "m", "s"), ("a", 2, "syntax", "m", "s"), ("a", 3, "none", "", "s")]
    runs = spark.createDataFrame(rows, "instance_id string, attempt int, error_type string, message string, sql string")
    none = spark.createDataFrame([], "instance_id string, success boolean, message string, sql string")
    assert R.lesson_candidates(runs, none).count() == 2 and R.lesson_candidates(runs, none, 2).count() == 1
    many = F.lit("SELECT 1" + " JOIN x" * 50)
    got = spark.range(1).select(S.estimated_seconds(F.lit("SELECT 1"), 7), S.estimated_seconds(many, 7, 99)).first()
    assert tuple(got) == (7, 99)


def test_hard_failures(spark, tmp_path):
    failed = spark.createDataFrame(
        [("a", "execution", "2024-01-01", "x" * 600)],
        "instance_id STRING, failure_type STRING, ts STRING, message STRING",
    )
    records = R.hard_failures(failed, {"error_message": F.col("message")})
    record_files.write_hard_failures(records, str(tmp_path / "f"))
    row = record_files.read_hard_failures(spark, str(tmp_path / "f")).first()
    assert row["failure_type"] == "execution" and row["details"] == {"error_message": "x" * 500}


def test_listed_shards_prune_folders(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = spark.range(200).selectExpr("id", "lpad(id % 20, 4, '0') AS shard", "'x' AS late")
    shards.write_shards(rows.where("shard < '0010'").drop("late"), path, "shard")
    shards.write_shards(rows.where("shard >= '0010'"), path, "shard", "append")
    listed = spark.createDataFrame([("0003",), ("0012",), ("0012",), ("9999",), (None,)], "shard string")
    chosen = shards.listed_shards(shards.read_shards(spark, path, "shard"), "shard", listed)
    got = sorted(tuple(r) for r in chosen.select("shard", "id", "late").collect())
    want = [("0003", k, None) for k in range(3, 200, 20)] + [("0012", k, "x") for k in range(12, 200, 20)]
    assert got == want
    plan = chosen._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan
    assert shards.listed_shards(shards.read_shards(spark, path, "shard"), "shard", listed.limit(0)).count() == 0


def test_shards(spark, tmp_path, sf_dir):
    events = load(spark, sf_dir, "events").withColumn("shard", shards.day_shard(F.col("ts")))
    shards.write_shards(events, str(tmp_path / "s"), "shard")
    week = shards.read_shards(spark, str(tmp_path / "s"), "shard", "20240124", "20240130")
    direct = events.filter("shard >= '20240124'")
    assert week.count() == direct.count() and dict(week.dtypes)["shard"] == "string"
    plan = week._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(shard" in plan
    parts = [events.filter(F.col("shard") == d).select("event_id") for d in ("20240101", "20240102")]
    wider = parts[1].withColumn("extra", F.lit(1))
    assert shards.union_shards([parts[0], wider]).count() == sum(p.count() for p in parts)


def test_batch_stores_results(spark, tmp_path):
    texts = spark.createDataFrame(
        [("ok", "SELECT id FROM range(12);"), ("bad", "SELECT missing FROM range(1)"),
         ("syntax", "SELECT 1 FORM x WHERE"), ("refused", "DROP TABLE x"), ("zero", "SELECT 1 / 0 AS x"),
         ("cast", "SELECT cast('x' AS int) AS x")], "instance_id STRING, sql STRING"
    )
    results, outcomes = str(tmp_path / "r"), str(tmp_path / "o")
    ran = batch.run_batch(spark, texts, outcomes, results, chunk=2)
    rows = {r["instance_id"]: r for r in ran.collect()}
    assert rows["ok"]["success"] and rows["ok"]["n_rows"] == 12 and rows["ok"]["error_type"] == "none"
    assert not rows["bad"]["success"] and rows["bad"]["n_rows"] is None
    kinds = {k: r["error_type"] for k, r in rows.items()}
    assert kinds["bad"] == kinds["syntax"] == "syntax" and kinds["refused"] == "permission"
    assert kinds["zero"] == kinds["cast"] == "runtime"
    again = batch.run_batch(spark, texts, outcomes)
    assert again.count() == 6 and {r["instance_id"]: r["n_rows"] for r in again.collect()}["ok"] == 12
    assert batch.run_batch(spark, texts.filter("false"), str(tmp_path / "e")).count() == 0
    tables, _ = result_csv.read_predictions(spark, results)
    assert [(r["instance_id"], r["n_rows"]) for r in tables.collect()] == [("ok", 12)]


def test_batch_keeps_one_outcome_per_text(spark, tmp_path):
    rows = [("e", "SELECT nothing_here"), ("s", "SELECT 1"), ("dup", "SELECT 2"), ("dup", "SELECT 3 AS a JOIN"), (None, "SELECT 4")]
    texts = spark.createDataFrame(rows, "instance_id string, sql string")
    got = batch.run_batch(spark, texts, str(tmp_path / "outcomes"), str(tmp_path / "results")).collect()
    assert sorted((str(r.instance_id), r.success) for r in got) == [
        ("None", True), ("dup", False), ("dup", True), ("e", False), ("s", True),
    ]
    assert all(r.estimated_seconds > 0 for r in got)
    assert {p.name for p in (tmp_path / "results").iterdir()} >= {"s.csv", "s.sql", "dup.csv"}
    assert not list((tmp_path / "results").glob("None*"))
