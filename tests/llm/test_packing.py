"""Packing: ids against the tokenizer, places without gaps, bounds against the best packing."""

import itertools
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers

from plumbline.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [
    None, "", " ", "\n", "a", "a b", " lead", "trail ", "two  spaces", "tab\tin", "a \n b", "a\n\n\nb",
    "don't we'll I'M", "x<|endoftext|>y z", "déjà vu – naïve 日本語 テスト", "\x1c odd \x85 blanks\xa0here",
    "line one\nline two, more.\nAnd 3 numbers 12345", "emoji 👩‍👩‍👧 ok", "ﬁ ligature sep",
]


def test_words_give_the_ids_of_the_whole():
    encoder = packing.Encoder(PATH)
    assert encoder.by_word
    rng = random.Random(1)
    made = ["".join(rng.choice(" \n\taéB1.,'’日") for _ in range(rng.randint(1, 40))) for _ in range(400)]
    for text in [t for t in TEXTS if t] + made:
        assert encoder(text) == packing.encode(encoder.tokenizer, text), text


def check_rows(rows, texts, limit):
    encoder = packing.Encoder(PATH)
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_sequence[r.sequence_id].append(r)
    assert set(by_doc) == set(range(len(texts)))
    for doc, own in by_doc.items():
        ids = encoder(texts[doc] or "") + np.array([2], "<u4").tobytes()
        at = 0
        for k, r in enumerate(sorted(own, key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert r.length == limit or k == 0
            assert r.ids_crc32 == zlib.crc32(ids[4 * at : 4 * (at + r.length)])
            at += r.length
        assert 4 * at == len(ids)
        assert len(own) == -(-len(ids) // 4 // limit) or len(own) == 1
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= limit
    return len(by_sequence)


def test_pieces_and_places(spark):
    rng = random.Random(2)
    texts = TEXTS + [" ".join(rng.choice(["the", "of", "and", "river"]) for _ in range(rng.randint(1, 900))) for _ in range(150)]
    texts.append("word " * 30_000)
    rows = [(k, t, "extra", k) for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, piece string, uid int")
    got = packing.best_fit_packing(docs, PATH, 256).collect()
    n = check_rows(got, texts, 256)
    bound = packing.lower_bound(np.array([r.length for r in got]), 256)
    assert bound <= n <= bound + max(2, bound // 50)


def test_partitions_exchange_until_little_is_left(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP", 40)
    rng = random.Random(4)
    texts = [" ".join(["river"] * rng.randint(20, 200)) for _ in range(400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = packing.best_fit_packing(docs, PATH, 256).collect()
    n = check_rows(got, texts, 256)
    best = packing.best_fit(np.array([r.length for r in got]), 256).max() + 1
    assert n <= best * 1.03 + 1


def test_empty_and_null_ids(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    assert packing.best_fit_packing(none, PATH).count() == 0
    docs = spark.createDataFrame([(None, "a"), (None, "a"), (7, None)], "doc_id bigint, text string")
    rows = packing.best_fit_packing(docs, PATH).collect()
    assert len(rows) == 3 and len({r.sequence_id for r in rows}) == 1


def best_packing(sizes, limit):
    for n in range(1, len(sizes) + 1):
        for places in itertools.product(range(n), repeat=len(sizes)):
            fill = [0] * n
            for size, place in zip(sizes, places):
                fill[place] += size
            if max(fill) <= limit:
                return n


def test_bounds_hold_and_best_fit_is_valid():
    rng = random.Random(6)
    for _ in range(40):
        sizes = [rng.randint(1, 20) for _ in range(rng.randint(1, 6))]
        own = np.array(sizes)
        assert packing.lower_bound(own, 20) <= best_packing(sizes, 20)
        fill = np.bincount(packing.best_fit(own, 20), own)
        assert fill.max() <= 20 and fill.sum() == own.sum()
    # Three items above half a sequence need three, though their sum fits two.
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3
