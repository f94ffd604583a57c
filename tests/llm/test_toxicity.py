"""Toxicity: segments against brute force, and held-out accuracy."""

import random

import numpy as np
import pyarrow as pa

from plumbline.llm import toxicity
from plumbline.llm.toxicity import Model, segments


def brute_segments(values):
    """All maximal scoring subsequences, by taking the best one and going on at both sides."""

    def best(lo, hi):
        found = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += values[b]
                if total > 1e-9 and (found is None or total > found[2] + 1e-9):
                    found = a, b, total
        return found

    out, todo = [], [(0, len(values))]
    while todo:
        lo, hi = todo.pop()
        one = best(lo, hi)
        if one:
            out.append((one[0], one[1], round(one[2], 6)))
            todo += [(lo, one[0]), (one[1] + 1, hi)]
    return sorted(out)


def test_segments_are_maximal():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.randint(1, 40)
        # Scores without ties between different segments.
        at = sorted(rng.sample(range(n), rng.randint(1, n)))
        scores = [rng.uniform(0.1, 3) for _ in at]
        values = [-0.53] * n
        for place, score in zip(at, scores):
            values[place] = score
        got = [(a, b, round(s, 6)) for a, b, s in segments(at, scores, 0.53)]
        assert sorted(got) == brute_segments(values)


def made(n, seed):
    rng = random.Random(seed)
    plain = [f"word{k}" for k in range(300)]
    bad = ["slur", "insultish", "insulting", "insulted", "vile"]
    rows, labels = [], []
    for k in range(n):
        own = [rng.choice(plain) for _ in range(rng.randint(30, 200))]
        toxic = k % 5 == 0
        if toxic:
            at = rng.randrange(len(own))
            own[at:at] = [rng.choice(bad) for _ in range(rng.randint(2, 5))]
        rows.append((k, " ".join(own).capitalize()))
        if k % 3:
            labels.append((k, 1, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_odd_rows(spark):
    rows, labels = made(1500, 3)
    rows += [(9000, None), (9001, ""), (9002, "..."), (None, "slur vile slur"), (9003, "word1 " * 40_000)]
    rows += [(5, rows[5][1])]
    labels += [(5, 0, 1), (5, 0, 0), (None, 1, 1), (7, 1, None)]
    docs = spark.createDataFrame([(*r, 1.0, "x") for r in rows], "doc_id bigint, text string, score double, id string")
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = toxicity.toxicity(docs, marks).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    held = [r for r in got if r.held_out and r.doc_id < 1500]
    right = sum(r.predicted == int(r.doc_id % 5 == 0) for r in held)
    assert right >= 0.98 * len(held) and len(held) > 300
    lowest = min(r.score for r in got)
    assert by[9000].score == by[9001].score == by[9002].score == lowest
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert by[None].predicted == 1 and not by[None].held_out and by[9003].predicted == 0
    shown = {r.doc_id: r.text for r in docs.where("doc_id < 1500").collect()}
    passage = by[0].passages[0]
    assert any(w in shown[0].lower()[passage.start : passage.end] for w in ("slur", "insult", "vile"))
    kept = toxicity.clean_documents(docs, marks)
    assert kept.columns == docs.columns
    assert kept.count() == sum(1 for r in got if not r.predicted)


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id bigint, text string")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    assert [r.score for r in toxicity.toxicity(docs, none).collect()] == [0.0, 0.0]
    assert toxicity.toxicity(docs.where("false"), none).count() == 0
    one = spark.createDataFrame([(1, 1, 1)], "doc_id bigint, quality int, toxic int")
    assert toxicity.clean_documents(docs, one).count() == 2


def test_heads_of_words_are_tokens():
    tokens = []
    for text in ("insulting", "insulted", "insu"):
        chunk = next(iter(toxicity.kernels.chunks(pa.array([text]), toxicity.kernels.ALNUM)))
        tokens.append({int(h) for _, own in toxicity.word_tokens(chunk) for h in own})
    assert len(tokens[0] & tokens[1]) == 3 and len(tokens[0] & tokens[1] & tokens[2]) == 1
    assert Model().probability(np.array([5.0])).tolist() == [0.0]
