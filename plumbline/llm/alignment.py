"""Alignment of two tokenizers by divide and conquer at shared cuts, with corpus-wide counts.

Both tokenizers cut the same bytes. A stretch of them is divided at an end that both share:
from its middle outwards ends of one side are looked up in the other by bisection, and both
halves are divided again; a stretch without a shared end inside is a group. Every token of a
group is linked with every token of the other side in it.

Both tokenizers are known to cut before a lone space or line end between two other characters,
so these cuts are taken first: the words between them are encoded and divided once and
remembered, and a document is the sum of its words. Documents then carry their different
pairs of ids with the number of links; documents per pair are counted by Spark. Pairs in many
documents, of a checked number, are looked up by a broadcast join, all others by a shuffle, in
which no pair has more rows than the documents it is in.

Defined cases: null and empty texts, and texts whose tokens do not give back the text after a
space (as with U+2581 in it), have no tokens: zeros and an empty hash. Null and repeated ids are
documents of their own; an empty table gives no rows; further columns are ignored; texts of any
length are aligned whole; of equally frequent pairs all are best.
"""

from __future__ import annotations

import functools
import hashlib
import re
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate, compress, islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.packing import word_merger
from plumbline.llm.tables import pinned, texts
from plumbline.sources.tables import spread

CACHED_WORDS = 400_000
LONGEST_CACHED = 40  # characters
FACTS = 6  # numbers kept of a word
FEW_LINKS = 64  # of a group whose links are listed one by one
BROADCAST_PAIRS = 1 << 18  # id pairs with their counts: some 20 MB

_UNEVEN = re.compile(r"\s\s|^\s|\s$")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ɏ"
_MARKS = r"!-&(-/:-@\[-`{-~"  # signs, without the apostrophe, which may begin a token of letters
#: Between a letter and a sign.
_SIGNS = re.compile(f"(?<=[{_LETTERS}])(?=[{_MARKS}])|(?<=[{_MARKS}])(?=[{_LETTERS}])")
_CUT = re.compile(r"(?<=\S)(?=[ \n]\S)")


def shared_groups(ends_a: list[int], ends_b: list[int]) -> list[tuple[int, int, int, int]]:
    """Token ranges (a from, a to, b from, b to) of the groups, in order.

    ``ends_a`` and ``ends_b``: rising byte offsets, with the same last one.
    """
    out = []
    todo = [(0, len(ends_a), 0, len(ends_b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a1 - a0 == 1 or b1 - b0 == 1:
            out.append((a0, a1, b0, b1))
            continue
        # The last ends of a stretch are its own; one inside it is wanted, near its middle.
        start = ends_a[a0 - 1] if a0 else 0
        middle = bisect_left(ends_a, (start + ends_a[a1 - 1]) / 2, a0, a1 - 1)
        found = None
        for step in range(max(middle - a0, a1 - 1 - middle) + 1):
            for at in (middle - step, middle + step):
                if a0 <= at < a1 - 1:
                    other = bisect_left(ends_b, ends_a[at], b0, b1 - 1)
                    if other < b1 - 1 and ends_b[other] == ends_a[at]:
                        found = at + 1, other + 1
                        break
            if found:
                break
        if found:
            at, other = found
            todo.append((at, a1, other, b1))
            todo.append((a0, at, b0, other))
        else:
            out.append((a0, a1, b0, b1))
    return out


class Aligned(NamedTuple):
    """A stretch of text. ``pairs``: keys a << 32 | b, in any order and maybe more than once, and
    the number of links of each."""

    n_a: int
    n_b: int
    n_groups: int
    n_links: int
    groups: str
    pairs: tuple[list[int], list[int]]
    same: bool  # the tokens give back the text


class Aligner(dict):
    """Numbers of words, and the alignment of each number.

    A word is named by its text after a space, or with a line end at its start. Words that
    come once or beyond ``CACHED_WORDS`` are forgotten after each batch.
    """

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        super().__init__()
        merger = word_merger(path_a)
        if merger is None:
            raise ValueError("the first tokenizer must be a byte-level one")
        self.encode_a = merger.encode_ordinary
        self.bytes_a = list(map(merger.decode_single_token_bytes, range(merger.max_token_value + 1)))
        library = sentencepiece.SentencePieceProcessor(model_file=path_b)
        self.encode_b = library.encode
        self.lead_b = library.piece_to_id("▁")
        pieces = list(map(library.id_to_piece, range(library.get_piece_size())))
        self.bytes_b = [
            bytes([int(p[3:5], 16)]) if library.is_byte(k) else p.replace("▁", " ").encode()
            for k, p in enumerate(pieces)
        ]
        #: Whether the second tokenizer, like the first, cuts between letters and signs.
        normal = [p for k, p in enumerate(pieces) if not (library.is_byte(k) or library.is_control(k))]
        self.splits = not any(_SIGNS.search(p) for p in normal if p != "<unk>")
        self.lengths_a, self.lengths_b = list(map(len, self.bytes_a)), list(map(len, self.bytes_b))
        self.high_a = [k << 32 for k in range(len(self.bytes_a))]
        self.shown_a = [f"{k}|" for k in range(len(self.bytes_a))]
        self.shown_b = list(map(str, range(len(self.bytes_b))))
        self.parts: dict[str, Aligned] = {}
        self.inner: dict[str, Aligned] = {}
        self.groups: list[str] = []
        self.facts = array("q")  # FACTS of each: four sums, whether it is whole, its pairs
        self.keys, self.links = array("q"), array("q")
        self.kept = 0
        self.seen = bytearray(1 << 22)

    def __missing__(self, word: str | tuple[str]) -> int:
        made = self.word(word if word[:1] == "\n" else " " + word) if isinstance(word, str) else self.stretch(*word)
        number = self[word] = len(self.groups)
        n_a, n_b, n_groups, n_links, groups, (keys, links), same = made
        self.groups.append(groups)
        self.facts.extend((n_a, n_b, n_groups, n_links, same, len(keys)))
        self.keys.extend(keys)
        self.links.extend(links)
        return number

    @property
    def numbers(self) -> np.ndarray:
        """FACTS of each word, a copy."""
        return np.array(self.facts, np.int64).reshape(-1, FACTS)

    def forget(self) -> None:
        """Of the words that are new since the last call, keeps those met before it as well, up
        to CACHED_WORDS in all; rare words would fill the memory and not come again."""
        tail = list(islice(self, self.kept, None))
        rows = np.array(self.facts[self.kept * FACTS :], np.int64).reshape(-1, FACTS)
        keep = []
        for word in tail:
            at = hash(word) & (len(self.seen) - 1)
            keep.append(self.seen[at] and isinstance(word, str) and len(word) <= LONGEST_CACHED)
            self.seen[at] = 1
            del self[word]
        keep = np.array(keep, bool)
        keep &= np.cumsum(keep) <= CACHED_WORDS - self.kept
        chosen = np.repeat(keep, rows[:, 5])
        start = len(self.keys) - len(chosen)
        for column in (self.keys, self.links):
            kept = np.array(column[start:], np.int64)[chosen].tobytes()
            del column[start:]
            column.frombytes(kept)
        groups = self.groups[self.kept :]
        del self.groups[self.kept :], self.facts[self.kept * FACTS :]
        self.groups.extend(compress(groups, keep))
        self.facts.frombytes(rows[keep].tobytes())
        for word in compress(tail, keep):
            self[word] = self.kept
            self.kept += 1

    def word(self, text: str) -> Aligned:
        """A word from its letters and signs, which are remembered."""
        parts = _SIGNS.split(text) if self.splits else [text]
        if len(parts) == 1:
            return self.stretch(text)
        n_a = n_b = n_groups = n_links = 0
        shown, keys, times, whole = [], [], [], True
        known = self.parts
        for part in parts:
            made = known.get(part)
            if made is None:
                made = self.stretch(part, known is self.inner)
                if len(part) <= LONGEST_CACHED and len(self.parts) + len(self.inner) < CACHED_WORDS // 4:
                    known[part] = made
            known = self.inner
            own_a, own_b, own_groups, own_links, groups, (own_keys, own_times), same = made
            n_a += own_a
            n_b += own_b
            n_groups += own_groups
            n_links += own_links
            shown.append(groups)
            keys += own_keys
            times += own_times
            whole = whole and same
        return Aligned(n_a, n_b, n_groups, n_links, ";".join(shown), (keys, times), whole)

    def stretch(self, text: str, inner: bool = False) -> Aligned:
        """Alignment of a text that starts with a space or a line end, or stands inside a word."""
        ids_a = self.encode_a(text)
        if inner:  # the library puts a space before, and a line end is a token of its own
            ids_b = self.encode_b("\n" + text)[2:]
        elif text[0] == " ":
            ids_b = self.encode_b(text[1:]) if len(text) > 1 else [self.lead_b]
        else:
            ids_b = self.encode_b(text)[1:]
        lengths_a, lengths_b, bytes_b = self.lengths_a, self.lengths_b, self.bytes_b
        ends_a = list(accumulate([lengths_a[k] for k in ids_a]))
        whole = text.encode()
        # The first tokenizer leaves bytes out or keeps them, so their number tells.
        if not ends_a or ends_a[-1] != len(whole) or b"".join([bytes_b[k] for k in ids_b]) != whole:
            return Aligned(0, 0, 0, 0, "", ([], []), False)
        ends_b = list(accumulate([lengths_b[k] for k in ids_b]))
        high_a, shown_a, shown_b = self.high_a, self.shown_a, self.shown_b
        if ends_a == ends_b:  # every cut is shared
            keys = [high_a[a] | b for a, b in zip(ids_a, ids_b)]
            groups = ";".join([shown_a[a] + shown_b[b] for a, b in zip(ids_a, ids_b)])
            n = len(ids_a)
            return Aligned(n, n, n, n, groups, (keys, [1] * n), True)
        groups, keys, times, n_links = [], [], [], 0
        for a0, a1, b0, b1 in shared_groups(ends_a, ends_b):
            if a1 - a0 == 1 == b1 - b0:
                a, b = ids_a[a0], ids_b[b0]
                groups.append(shown_a[a] + shown_b[b])
                n_links += 1
                keys.append(high_a[a] | b)
                times.append(1)
                continue
            own_a, own_b = ids_a[a0:a1], ids_b[b0:b1]
            groups.append(",".join(map(str, own_a)) + "|" + ",".join([shown_b[b] for b in own_b]))
            n = len(own_a) * len(own_b)
            n_links += n
            if n <= FEW_LINKS:
                keys += [high_a[a] | b for a in own_a for b in own_b]
                times += [1] * n
                continue
            # A long group may repeat few ids very often.
            own_b = list(Counter(own_b).items())
            for a, many in Counter(own_a).items():
                keys += [high_a[a] | b for b, _ in own_b]
                times += [many * others for _, others in own_b]
        return Aligned(len(ids_a), len(ids_b), len(groups), n_links, ";".join(groups), (keys, times), True)

    def words(self, text: str) -> list[str | tuple[str]]:
        """The text, after a space, cut where both tokenizers surely cut. Words come without
        the space before them; stretches with white space of another kind as tuples."""
        if not text:
            return []
        if not _UNEVEN.search(text):
            return text.replace("\n", " \n").split(" ")
        return [
            (part,) if part[0] == " " and part[1:2].isspace() or part == " " else part.removeprefix(" ")
            for part in _CUT.split(" " + text)
        ]

    def aligned(self, texts: list[str]) -> list[Aligned]:
        """Alignments of whole texts, each after a space. ``pairs`` are two arrays, of keys in
        order, each once, and of links."""
        numbers = [list(map(self.__getitem__, self.words(text))) for text in texts]
        facts = np.frombuffer(self.facts, np.int64).reshape(-1, FACTS)
        keys, links = np.frombuffer(self.keys, np.int64), np.frombuffer(self.links, np.int64)
        starts = np.cumsum(facts[:, 5]) - facts[:, 5]
        out = []
        for own in numbers:
            rows = np.array(own, np.int64)
            counts = facts[rows]
            if not counts[:, 4].all():
                own, rows, counts = [], rows[:0], counts[:0]
            sizes = counts[:, 5]
            at = np.repeat(starts[rows] - (np.cumsum(sizes) - sizes), sizes)
            at += np.arange(len(at))
            order = np.argsort(keys[at], kind="stable")
            found, times = keys[at][order], links[at][order]
            first = np.flatnonzero(np.diff(found, prepend=-1))
            found, times = found[first], np.add.reduceat(times, first) if len(first) else times
            sums = counts[:, :4].sum(0).tolist()
            groups = ";".join(map(self.groups.__getitem__, own))
            out.append(Aligned(*sums, groups, (found, times), True))
        del facts, keys, links  # a view of an array forbids its change
        self.forget()
        return out


@functools.lru_cache(maxsize=1)
def aligner_at(path_a: str, path_b: str) -> Aligner:
    """One per worker process, so that its memory of words outlives a task."""
    return Aligner(path_a, path_b)


def _lists(rows: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate([*rows, []]), pa.int64()))


def aligned_groups(
    docs: DataFrame,
    path_a: str,
    path_b: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    hashed: bool = False,
) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, pairs, links) of each document.

    ``groups``: `a1,a2|b1;a3|b2,b3`, or its SHA-256 (empty without tokens) if ``hashed``;
    ``pairs``: the different linked ids, a << 32 | b, in order, and ``links``: how often each.
    """
    schema = pa.schema(
        [("doc_id", pa.int64())]
        + [(name, pa.int64()) for name in ("n_a", "n_b", "n_groups", "n_links")]
        + [("groups", pa.string()), ("pairs", pa.list_(pa.int64())), ("links", pa.list_(pa.int64()))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_at(path_a, path_b)
        for batch in batches:
            sums, groups, pairs, links = [], [], [], []
            for made in aligner.aligned(batch.column("text").to_pylist()):
                sums.append(made[:4])
                shown = made.groups
                if hashed and shown:
                    shown = hashlib.sha256(shown.encode()).hexdigest()
                groups.append(shown)
                pairs.append(made.pairs[0])
                links.append(made.pairs[1])
            columns = np.array(sums, np.int64).reshape(-1, 4).T
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    *map(pa.array, columns),
                    pa.array(groups, pa.string()),
                    _lists(pairs),
                    _lists(links),
                ],
                schema=schema,
            )

    return spread(texts(docs, id_col, text_col)).mapInArrow(
        run,
        "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, "
        "groups string, pairs array<bigint>, links array<bigint>",
    )


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, documents, best): documents that hold each linked pair of ids, and whether no
    other pair of the same A id is in more."""
    counts = aligned.select(F.explode("pairs").alias("pair")).groupBy("pair")
    counts = pinned(counts.agg(F.count(F.lit(1)).alias("documents")), "pairs")
    # One row per id of the first tokenizer: bounded by its vocabulary.
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("documents").alias("top"))
    return counts.join(F.broadcast(top), F.shiftright("pair", 32) == F.col("a")).select(
        "pair", "documents", (F.col("documents") == F.col("top")).alias("best")
    )


def _frequent(counts: DataFrame) -> int:
    """Least number of documents, a power of two, that at most BROADCAST_PAIRS pairs reach."""
    power = F.floor(F.log2("documents")).cast("int").alias("power")
    rows = dict(counts.groupBy(power).count().collect())  # at most 64
    total, least = 0, 64
    while least and total + rows.get(least - 1, 0) <= BROADCAST_PAIRS:
        least -= 1
        total += rows.get(least, 0)
    return 1 << least if least < 63 else (1 << 63) - 1


def alignment(
    docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best (links whose pair is
    the most frequent one of its A id), count_sum (documents of the pair, over all links) and
    groups_sha256."""
    rows = aligned_groups(docs, path_a, path_b, id_col, text_col, hashed=True)
    rows = pinned(rows.withColumn("uid", F.monotonically_increasing_id()), "aligned")
    counts = pinned(pair_counts(rows), "counts")
    least = _frequent(counts)
    many, few = counts.where(F.col("documents") >= least), counts.where(F.col("documents") < least)
    each = rows.select("uid", F.explode(F.arrays_zip("pairs", "links")).alias("one"))
    each = each.select("uid", F.col("one.pairs").alias("pair"), F.col("one.links").alias("links"))
    known = each.join(F.broadcast(many), "pair")  # BROADCAST_PAIRS rows at most
    if least > 1:
        rest = each.join(F.broadcast(many.select("pair")), "pair", "left_anti")
        known = known.unionByName(rest.join(few, "pair"))
    sums = known.groupBy("uid").agg(
        F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("n_best"),
        F.sum(F.col("links") * F.col("documents")).alias("count_sum"),
    )
    zero = F.lit(0).cast("bigint")
    return rows.drop("pairs", "links").join(sums, "uid", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        "n_links",
        F.coalesce("n_best", zero).alias("n_best"),
        F.coalesce("count_sum", zero).alias("count_sum"),
        F.col("groups").alias("groups_sha256"),
    )
