"""Tokenizer alignment against a plain version that knows no words, divisions or Spark."""

import hashlib
import random
from bisect import bisect_left
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm import alignment, queries
from plumbline.sources.tables import load

PATH_A = public_tokenizers.path("byte_bpe_50k.json")
PATH_B = public_tokenizers.path("piece_bpe_32k.model")
TEXTS = [
    None, "", " ", "  ", "\n", "\n\na", "a", "a b", " lead", "trail ", "two  blanks", "tab\tin", "a \n b",
    "one\ntwo\nthree", "▁ differs", "x<|endoftext|>y <s>", "café café 日本語 ①",
    "\x1c odd \x85 blanks\xa0here", "\U0001f469‍\U0001f469 ok", "漢字仮名" * 500, "=" * 2000,
    "the theory of the thing " * 4000, "same words", "same words",
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(PATH_A)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=PATH_B)
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        hidden = [b for b in range(256) if b not in shown]
        letters = [chr(b) for b in shown] + [chr(256 + k) for k in range(len(hidden))]
        self.byte = dict(zip(letters, shown + hidden))

    def tokens(self, text):
        made = self.a.encode(" " + text, add_special_tokens=False)
        a = [(i, bytes(self.byte[c] for c in t)) for i, t in zip(made.ids, made.tokens)]
        b = []
        for i in self.b.encode(text):
            piece = self.b.id_to_piece(i)
            own = bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()
            b.append((i, own))
        return a, b

    def groups(self, text):
        if not text:
            return []
        a, b = self.tokens(text)
        whole = (" " + text).encode()
        if any(b"".join(t for _, t in side) != whole for side in (a, b)):
            return []
        ends = [np.cumsum([len(t) for _, t in side]).tolist() for side in (a, b)]
        cuts = sorted(set(ends[0]) & set(ends[1]))
        out = [([], []) for _ in cuts]
        for k, side in enumerate((a, b)):
            for (i, _), end in zip(side, ends[k]):
                out[bisect_left(cuts, end)][k].append(i)
        return out


def digests(texts):
    plain = Plain()
    rows = [plain.groups(t) for t in texts]
    links = [Counter((x, y) for a, b in groups for x in a for y in b) for groups in rows]
    count = Counter(pair for own in links for pair in own)
    best = defaultdict(int)
    for (a, _), n in count.items():
        best[a] = max(best[a], n)
    for groups, own in zip(rows, links):
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        yield (
            sum(len(a) for a, _ in groups),
            sum(len(b) for _, b in groups),
            len(groups),
            sum(own.values()),
            sum(n for pair, n in own.items() if count[pair] == best[pair[0]]),
            sum(n * count[pair] for pair, n in own.items()),
            hashlib.sha256(text.encode()).hexdigest() if text else "",
        )


def test_groups_are_those_between_all_shared_ends():
    rng = random.Random(1)
    for _ in range(400):
        length = rng.randint(1, 60)
        sides = [sorted({*rng.sample(range(1, length + 1), rng.randint(0, length // 2)), length}) for _ in "ab"]
        got = alignment.shared_groups(*sides)
        cuts = sorted(set(sides[0]) & set(sides[1]))
        assert [(sides[0][a1 - 1], sides[1][b1 - 1]) for _, a1, _, b1 in got] == [(c, c) for c in cuts]
        assert [g[0] for g in got[1:]] == [g[1] for g in got[:-1]]
        assert [g[2] for g in got[1:]] == [g[3] for g in got[:-1]]
        assert got[0][0] == got[0][2] == 0


def test_long_stretches_without_shared_ends_are_quick():
    n = 200_000
    even, odd = [*range(2, 2 * n, 2), 2 * n], [*range(1, 2 * n, 2), 2 * n]
    assert alignment.shared_groups(even, odd) == [(0, n, 0, n + 1)]
    assert len(alignment.shared_groups(even, even)) == n


def test_odd_texts_one_by_one():
    plain, aligner = Plain(), alignment.Aligner(PATH_A, PATH_B)
    rng = random.Random(2)
    made = []
    for _ in range(1500):
        letters = rng.choice(["  aab c\n\t", "▁ ab", "日本 é①́b\x00", "thequickbrown  ", "12 ,.;:'\"\x1c\x85\xa0\n"])
        made.append("".join(rng.choice(letters) for _ in range(rng.randint(0, 50))))
    made += [t or "" for t in TEXTS] + [f"'s {x}don't(a_b)x's.y,{x};z" for x in "aé×1²"]
    for text, got in zip(made, aligner.aligned(made)):
        want = plain.groups(text)
        shown = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in want)
        assert got.groups == shown, text
        links = Counter(x << 32 | y for a, b in want for x in a for y in b)
        assert dict(zip(*(a.tolist() for a in got.pairs))) == links and got.n_links == sum(links.values())


@pytest.mark.parametrize("broadcast", [1 << 18, 20, 0])
def test_odd_rows(spark, monkeypatch, broadcast):
    monkeypatch.setattr(alignment, "BROADCAST_PAIRS", broadcast)
    rows = [(k, t, "g", k) for k, t in enumerate(TEXTS)] + [(None, "the twin", "g", 1)] * 2
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, groups string, uid int")
    got = alignment.alignment(docs, PATH_A, PATH_B).collect()
    want = [(r[0], *d) for r, d in zip(rows, digests([r[1] for r in rows]))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_memory_of_words_may_be_full(monkeypatch):
    monkeypatch.setattr(alignment, "CACHED_WORDS", 7)
    small, aligner = alignment.Aligner(PATH_A, PATH_B), alignment.Aligner(PATH_A, PATH_B)
    texts = ["one, two, three four five six seven eight nine", "", "nine, ten one\neleven", "one  two"]
    for _ in range(3):
        for text in texts:
            assert str(small.aligned([text])) == str(aligner.aligned([text]))
            assert len(small) == len(small.groups) == len(small.numbers) == small.kept <= 7
    assert small.kept == 7 and sorted(small.values()) == list(range(7))
    assert len(small.keys) == sum(row[5] for row in small.numbers)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert alignment.alignment(docs, PATH_A, PATH_B).count() == 0
    only = spark.createDataFrame([(1, None)], "doc_id bigint, text string")
    assert tuple(alignment.alignment(only, PATH_A, PATH_B).first()) == (1, 0, 0, 0, 0, 0, 0, "")


def test_query_over_the_whole_table(spark, sf_dir):
    docs = load(spark, sf_dir, "documents").collect()
    want = [(r.doc_id, *d) for r, d in zip(docs, digests([r.text for r in docs]))]
    got = queries.op13_tokenizer_alignment(spark, sf_dir).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_words_with_all_cuts_shared_are_not_searched(monkeypatch):
    paths = [public_tokenizers.path(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    usual = alignment.Aligner(*paths).aligned(["the cat and the dog", "", "(the) end,"])
    monkeypatch.setattr(alignment, "shared_groups", lambda *ends: pytest.fail("searched"))
    again = alignment.Aligner(*paths).aligned(["the cat and the dog", "", "(the) end,"])
    for made, other in zip(usual, again):
        assert made[:5] == other[:5] and made.n_links == made.pairs[1].sum()
        assert [a.tolist() for a in made.pairs] == [a.tolist() for a in other.pairs]
