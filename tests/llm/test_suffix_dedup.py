"""Suffix-array dedup against counting every string."""

import collections
import hashlib
import random

import numpy as np
import pytest

from plumbline.llm import suffix_dedup
from plumbline.llm.suffix_dedup import LENGTH


def brute(rows, keep_first=False):
    texts = [(i, (t or "").encode()) for i, t in rows]
    first, times = {}, collections.Counter()
    for k, (_, b) in enumerate(sorted(texts, key=lambda r: (r[0] is not None, r[0]))):
        for at in range(len(b) - LENGTH + 1):
            times[b[at : at + LENGTH]] += 1
    out = []
    for i, b in texts:
        cover = np.zeros(len(b) + 1, int)
        for at in range(len(b) - LENGTH + 1):
            if times[b[at : at + LENGTH]] > 1:
                cover[at] += 1
                cover[at + LENGTH] -= 1
        gone = np.cumsum(cover)[:-1] > 0
        runs = int((gone[1:] & ~gone[:-1]).sum() + gone[:1].sum())
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(8)

    def prose(n):
        return "".join(rng.choice("abcdefghij é") for _ in range(n))

    passage, other = prose(700), prose(260)
    rows = [(k, prose(rng.randint(0, 900))) for k in range(30)]
    rows += [(100 + k, prose(300) + passage[k * 10 : 690] + prose(50)) for k in range(12)]
    rows += [(200 + k, other) for k in range(3)] + [(210, other[:199]), (211, other[:200]), (212, other[1:])]
    rows += [(300, prose(150) + other + prose(20) + other + prose(90))]  # twice in one text
    rows += [(310, "For " * 400), (311, "x" * 1000), (312, "x" * 199), (313, "日本" * 90)]
    rows += [(400, None), (401, ""), (None, prose(400) + other), (None, passage)]
    rows += [(500, prose(5000))] * 2
    return rows


def digests(df):
    return sorted([tuple(r) for r in suffix_dedup.digest(df).collect()], key=repr)


@pytest.mark.parametrize("hot,step", [(500, 8), (3, 8), (1, 5)])
def test_removes_what_counting_removes(spark, monkeypatch, hot, step):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "STEP", step)
    rows = corpus()
    docs = spark.createDataFrame([(i, t, 1, "a") for i, t in rows], "doc_id bigint, text string, n int, at string")
    assert digests(suffix_dedup.suffix_dedup(docs)) == brute(rows)


def test_first_copies_stay(spark):
    rng = random.Random(2)
    parts = ["".join(rng.choice("abcdefgh ") for _ in range(400)) for _ in range(6)]
    rows = [(1, parts[0] + parts[1]), (2, parts[2] + parts[1]), (3, parts[0]), (4, parts[3]), (5, parts[3] + parts[2])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = {r.doc_id: bytes(r.kept).decode() for r in suffix_dedup.suffix_dedup(docs, True).collect()}
    assert kept == {1: parts[0] + parts[1], 2: parts[2], 3: "", 4: parts[3], 5: ""}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert suffix_dedup.suffix_dedup(docs).count() == 0


def test_suffix_order_and_factors():
    rng = np.random.default_rng(1)
    for _ in range(20):
        data = rng.integers(97, 99, 400).astype(np.uint8)
        length = int(rng.integers(9, 40))
        starts = np.arange(len(data) - length)
        order, run = suffix_dedup.suffix_order(data, starts, length)
        text = data.tobytes()
        cut = [text[s : s + length] for s in starts[order]]
        assert cut == sorted(cut)
        assert all((a == b) == (x == y) for a, b, x, y in zip(cut, cut[1:], run, run[1:]))
        earlier, later = suffix_dedup.factors(run)
        for place, e, l in zip(starts[order], earlier, later):
            same = [s for s in starts if text[s : s + length] == text[place : place + length]]
            assert e == (min(same) < place) and l == (max(same) > place)
