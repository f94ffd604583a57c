"""N-gram Jaccard join against brute force over all pairs."""

import random
import re
import string

import numpy as np
import pyarrow as pa
import pytest

from plumbline.llm import ngram_join

LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    runs = range(max(1, len(words) - width + 1)) if words else ()
    return frozenset(tuple(words[k : k + width]) for k in runs)


def brute(rows, width, percent):
    """Component (smallest id that is not null) per row, by comparing all pairs."""
    sets = [shingle_set(text, width) for _, text in rows]
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and 100 * both >= percent * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    out = []
    for k, (id_, _) in enumerate(rows):
        ids = [i for j, (i, _) in enumerate(rows) if root(j) == root(k) and i is not None]
        out.append((id_, len(sets[k]), min(ids) if sets[k] and ids else id_))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(5)
    words = [f"w{k}" for k in range(400)]
    base = [rng.choice(words) for _ in range(120)]
    rows = [(1, " ".join(base)), (2, " ".join(base).upper()), (2, " ".join(base).upper())]
    for k in range(40):
        near = list(base)
        for _ in range(rng.randint(1, 6)):
            near[rng.randrange(len(near))] = rng.choice(words)
        rows.append((10 + k, " ".join(near)))
    for k in range(30):
        rows.append((100 + k, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60)))))
    chain = [rng.choice(words) for _ in range(80)]
    for k in range(12):  # each like the next, the ends not like each other
        rows.append((200 + k, " ".join(chain[k:] + [f"x{j}" for j in range(k)])))
    rows += [(300, None), (301, ""), (302, " \t\n"), (303, "one two"), (304, "ONE  two"), (305, "two one")]
    rows += [(None, "one two"), (None, "lonely words here are few"), (306, "é è ê ë"), (307, "É è ê ë")]
    rows += [(400, " ".join(["same"] * 5000)), (401, " ".join(["same"] * 4000))]
    rows.append((402, " ".join(rng.choice(words) for _ in range(60_000))))
    return rows


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_components_match_all_pairs(spark, width, percent):
    rows = corpus()
    extra = [(i, t, k, "x", 0.5) for k, (i, t) in enumerate(rows)]
    docs = spark.createDataFrame(extra, "doc_id bigint, text string, n int, token string, cls double")
    joined = ngram_join.ngram_jaccard_join(docs, width, percent)
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in joined.members.collect()]
    assert sorted(got, key=repr) == brute(rows, width, percent)
    for link in joined.links.collect():
        assert 100 * link.overlap >= percent * (link.n_a + link.n_b - link.overlap)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    joined = ngram_join.ngram_jaccard_join(docs)
    assert joined.members.count() == 0 and joined.links.count() == 0
    assert ngram_join.one_of_each_group(docs).count() == 0


def test_one_of_each_group(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    kept = ngram_join.one_of_each_group(docs, 4, 85)
    assert kept.columns == docs.columns
    groups = {}
    for id_, n, component in brute(rows, 4, 85):
        if n:
            groups.setdefault((component, component is None and id_), []).append(id_)
    without_words = sum(1 for _, t in rows if not shingle_set(t, 4))
    ids = [r.doc_id for r in kept.collect()]
    assert 2 not in ids and 1 in ids and 303 in ids and 304 not in ids
    # Two rows without id are one group with 303 and one alone.
    assert len(ids) == len(groups) + without_words


def test_divide_skip_finds_what_counting_finds():
    rng = np.random.default_rng(3)
    for _ in range(60):
        query = np.unique(rng.integers(0, 300, rng.integers(1, 120)).astype(np.uint64))
        others = [
            np.unique(rng.integers(0, 300, rng.integers(1, 150)).astype(np.uint64)) for _ in range(20)
        ]
        needed = rng.integers(1, 40, len(others))
        expected = [
            (k, len(np.intersect1d(query, own)))
            for k, own in enumerate(others)
            if len(np.intersect1d(query, own)) >= needed[k]
        ]
        assert sorted(ngram_join.divide_skip(query, others, needed)) == expected


def test_document_counts(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "HELD", 500)  # several rows of partial counts a task
    rows = corpus()
    docs = spark.createDataFrame([(k, t or "") for k, (_, t) in enumerate(rows)], "id bigint, text string")
    got = ngram_join.document_counts(docs.repartition(3), 4)
    want = np.zeros(len(got), np.int64)
    for _, sets in ngram_join.sets_of(pa.array([t or "" for _, t in rows]), 4):
        for own in sets:
            want += np.bincount(ngram_join._slot(own, len(got)), minlength=len(got))
    assert len(got) == ngram_join.SPAN and want.max() > 20
    assert (got == np.where(want, np.floor(np.log2(np.maximum(want, 1)) * ngram_join.STEPS) + 1, 0)).all()
    empty = ngram_join.document_counts(docs.where("id < 0"), 4)
    assert not empty.any()
