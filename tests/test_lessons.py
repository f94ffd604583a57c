"""Lesson store: dedup, latest entries, and the stream against the batch form."""

import os

from pyspark.sql import functions as F

from plumbline.operators import lessons as L
from plumbline.streaming import lessons as stream


def _lessons(spark, patterns, start=0):
    rows = [(start + i, "t", "syntax", p, "f", "s") for i, p in enumerate(patterns)]
    return spark.createDataFrame(rows, stream.LESSON_SCHEMA)


def test_new_lessons(spark):
    stored = _lessons(spark, ["Known one", "other"])
    incoming = _lessons(spark, [" known ONE\t", "fresh", "FRESH", "two\nlines", "Two"], 10)
    fresh = L.new_lessons(incoming, stored).sort("seq").collect()
    assert [(r["seq"], r["norm"]) for r in fresh] == [(11, "fresh"), (13, "two")]
    again = L.new_lessons(incoming, stored.unionByName(incoming))
    assert again.count() == 0


def test_latest(spark):
    lessons = _lessons(spark, ["a", "b", "c"])
    assert sorted(r["pattern"] for r in L.latest(lessons, 2).collect()) == ["b", "c"]
    assert L.latest(lessons, 0).count() == 3
    text = L.lessons_text(lessons, 2).first()["lessons"]
    assert text.count("## [t] [syntax]") == 2 and text.index("b") < text.index("**Pattern:** c")
    assert L.lessons_text(lessons.limit(0), 2).first()["lessons"] == ""


def test_lesson_of_answer(spark):
    df = spark.createDataFrame(
        [('{"fix": "f"}', "m" * 200), ("oops", "m" * 200), ("[1]", "short")], "a STRING, m STRING"
    )
    from pyspark.sql import functions as F

    rows = df.select(L.from_answer(F.col("a"), F.lit("runtime"), F.col("m"), "X").alias("l")).collect()
    assert tuple(rows[0]["l"]) == ("runtime", "m" * 100, "f", "")
    assert tuple(rows[1]["l"])[1:3] == (
        "Raw error: " + "m" * 100,
        "Review the X error and adjust SQL accordingly",
    )
    assert rows[2]["l"]["pattern"] == "Raw error: short"


def test_replayed_batch_adds_nothing(spark, tmp_path):
    store = str(tmp_path / "store")
    stream.append_batch(_lessons(spark, ["a", "b", "A"]), 0, store)
    second = _lessons(spark, ["b", "c", "C "], 10)
    stream.append_batch(second, 1, store)
    first = sorted(r["norm"] for r in stream.read_store(spark, store).collect())
    stream.append_batch(second, 1, store)
    assert sorted(r["norm"] for r in stream.read_store(spark, store).collect()) == first == ["a", "b", "c"]


def test_stream_equals_batch(spark, tmp_path):
    source, store, progress = (str(tmp_path / n) for n in ("in", "store", "progress"))
    patterns = [f"p{i % 17}" for i in range(60)]
    os.makedirs(source)
    for k in range(3):
        _lessons(spark, patterns[20 * k : 20 * k + 20], 20 * k).write.mode("append").json(source)
        stream.start(spark, source, store, progress, files_per_batch=2).awaitTermination()
    stored = sorted(r["norm"] for r in stream.read_store(spark, store).collect())
    batch = sorted(r["norm"] for r in L.new_lessons(_lessons(spark, patterns), None).collect())
    assert stored == batch
    stream.start(spark, source, store, progress).awaitTermination()
    assert stream.read_store(spark, store).count() == len(stored)
    stream.start(spark, source, store, str(tmp_path / "other")).awaitTermination()
    assert stream.read_store(spark, store).count() == len(stored)


def test_fields_of_several_lines_come_back(spark):
    row = spark.createDataFrame(
        [("2026-01-01 10:00", "syntax", "first\nsecond", "use\nmore", "select `a`\nfrom t")],
        "ts STRING, kind STRING, pattern STRING, fix STRING, sql STRING",
    )
    entry = L.to_markdown(*[F.col(c) for c in row.columns])
    back = row.select(entry.alias("e")).select(*[c.alias(n) for n, c in L.parse(F.col("e")).items()])
    assert tuple(back.first()) == tuple(row.first())


def test_a_lesson_without_pattern_is_stored_once(spark):
    first = L.new_lessons(_lessons(spark, [None, "a"]), None)
    assert sorted(r["norm"] for r in first.collect()) == ["", "a"]
    assert L.new_lessons(_lessons(spark, [None, "A"]), first).count() == 0


def _stored(spark, store):
    return sorted((r["norm"], r["seq"]) for r in stream.read_store(spark, store).collect())


def test_a_batch_reads_its_own_buckets_only(spark, tmp_path):
    store = str(tmp_path / "store")
    stream.append_batch(_lessons(spark, [f"pattern number {k}" for k in range(300)]), 0, store)
    few = [3, 4]

    def plan():
        return stream._rows(spark, store, few)._jdf.queryExecution().executedPlan().toString()

    own = stream.read_store(spark, store).filter(stream._bucket().isin(few)).count()
    assert "In(bucket, [3,4])" in plan() and stream.read_store(spark, store, few).count() == own
    stream.compact(spark, store)
    assert "bucket" in plan().split("PartitionFilters: [")[1].split("PushedFilters")[0]
    assert stream.read_store(spark, store, few).count() == own


def test_two_writers_of_one_pattern_leave_one_row(spark, tmp_path):
    store, other = str(tmp_path / "store"), str(tmp_path / "other")
    stream.append_batch(_lessons(spark, ["same", "mine"]), 0, store, "one")
    # The second writer saw the store before the first one wrote.
    stream.append_batch(_lessons(spark, ["x", "same"]), 0, other, "two")
    (tmp_path / "other" / "batches" / "writer=two").rename(tmp_path / "store" / "batches" / "writer=two")
    assert stream._rows(spark, store, None).count() == 4
    before = _stored(spark, store)
    assert [norm for norm, _ in before] == ["mine", "same", "x"]
    assert stream.compact(spark, store) == 1
    assert stream._rows(spark, store, None).count() == 3 and _stored(spark, store) == before


def test_compaction_changes_nothing_that_is_read(spark, tmp_path):
    store = str(tmp_path / "store")
    assert stream.compact(spark, store) == 0
    stream.append_batch(_lessons(spark, ["a", "b"]), 0, store)
    stream.append_batch(_lessons(spark, ["b", "c"]), 1, store)
    before = _stored(spark, store)
    assert stream.compact(spark, store) == 1 and stream.compact(spark, store) == 1
    assert _stored(spark, store) == before
    # A batch run again after the compaction, a new one, and another compaction.
    stream.append_batch(_lessons(spark, ["b", "c"]), 1, store)
    assert _stored(spark, store) == before
    stream.append_batch(_lessons(spark, ["c", "d"]), 2, store)
    after = _stored(spark, store)
    assert [norm for norm, _ in after] == ["a", "b", "c", "d"]
    assert stream.compact(spark, store) == 2 and _stored(spark, store) == after
    # One that did not come to its commit does not count.
    (tmp_path / "store" / "base" / "generation=3").mkdir()
    assert _stored(spark, store) == after
