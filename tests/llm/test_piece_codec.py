"""SentencePiece codec: ids and texts against the library, and the table against the rule."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from plumbline.llm import piece_codec, queries
from plumbline.sources.tables import load

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "   ", "\n", "\n\n a", "a", " lead", "trail ", "two  blanks", "tab\tin", "a \n b",
    "▁ x▁▁y", "\x00nul", "café café 日本語 ① ﬁ", "<s> </s> <unk> <0x41>",
    "\U0001f469‍\U0001f469 ok", "x" * 3000, "漢字" * 2000, " " * 333 + "end", "word " * 20_000,
]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def model():
    return piece_codec.PieceModel(PATH)


def made_texts(rng, n):
    for _ in range(n):
        letters = rng.choice(["  aab c\n\t", "▁ ab", "日本 é①́b\x00", "thequickbrown  ", "0123 ,.;:-_/()'\"", "         "])
        yield "".join(rng.choice(letters) for _ in range(rng.randint(0, 60)))


def test_ids_are_those_of_the_library(model, library):
    for text in [t or "" for t in TEXTS] + list(made_texts(random.Random(1), 3000)):
        assert model.encode(text).tolist() == library.encode(text), text


def test_every_prefix_has_the_rules_last_token(model):
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice("▁abcdehinorst") for _ in range(rng.randint(1, 14)))
        for end in range(1, len(text) + 1):
            want = [model.ids[p] for p in model.merged(text[:end])]
            assert model.table_ids(text[:end]) == want


def test_decoding_of_any_ids(model, library):
    rng = random.Random(3)
    for _ in range(3000):
        kinds = [rng.randrange(32000), rng.randrange(3, 259), rng.randrange(3), 259, 29871]
        ids = [rng.choice(kinds) for _ in range(rng.randint(0, 8))]
        assert model.decode(np.array(ids, np.int32)) == library.decode(ids), ids
    with pytest.raises(ValueError):
        model.decode(np.array([32000]))


def test_memory_of_words_and_pairs_may_be_full(monkeypatch, library):
    monkeypatch.setattr(piece_codec, "CACHED_WORDS", 3)
    monkeypatch.setattr(piece_codec, "CACHED_PAIRS", 5)
    model = piece_codec.PieceModel(PATH)
    for text in made_texts(random.Random(4), 300):
        assert model.encode(text).tolist() == library.encode(text)
    assert len(model.words) <= 3


def digest_of(library, text):
    ids = library.encode(text or "")
    return (
        len(ids),
        hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(),
        hashlib.sha256(library.decode(ids).encode()).hexdigest(),
    )


def test_query_over_the_whole_table(spark, sf_dir, library):
    texts = {r.doc_id: r.text for r in load(spark, sf_dir, "documents").collect()}
    rows = queries.op12_sentencepiece(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == digest_of(library, texts[r.doc_id])


def test_odd_rows(spark, library):
    rows = [(k, t, [1], "x") for k, t in enumerate(TEXTS)] + [(None, "twin", [2], "y")] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, ids array<int>, decoded string")
    both = piece_codec.round_trip(docs, PATH)
    got = sorted(map(tuple, piece_codec.digest(both).collect()), key=str)
    want = [(id_, *digest_of(library, text)) for id_, text, *_ in rows]
    assert got == sorted(want, key=str)
    again = {(r.doc_id, r.text) for r in piece_codec.decoded(both, PATH).collect()}
    assert again == {(r.doc_id, r.decoded) for r in both.collect()}
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    assert piece_codec.digest(piece_codec.round_trip(empty, PATH)).count() == 0


def test_null_ids_are_left_out(spark):
    tokens = spark.createDataFrame([(1, None), (2, [450, None]), (3, [])], "doc_id int, ids array<int>")
    got = {r.doc_id: r.text for r in piece_codec.decoded(tokens, PATH).collect()}
    assert got[1] == got[3] == "" and got[2]
