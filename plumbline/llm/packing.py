"""Best-fit packing of tokenised documents, repacked until lower bounds certify it.

Documents are tokenised and, only where longer than a sequence, cut into pieces; the first
piece takes the remainder, so all others fill a sequence alone. Shorter pieces are dealt into
partitions of some thousands; each is packed by best-fit decreasing and compared with a lower
bound from dual-feasible functions (rounding and threshold families over its sizes). A
partition that meets its bound is certified and keeps its sequences, except its emptiest one.
Partitions with a gap, and those emptiest sequences, exchange documents: all of them are dealt
anew into fewer partitions and packed again, for a few rounds or until nothing is left over.

Defined cases: null text is empty and becomes the end token alone; null and repeated ids are
documents of their own; ties in size are placed by id; an empty table gives no rows; further
columns of the input are ignored; a text of any length is tokenised whole.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import pinned, texts

GROUP = 1 << 14  # pieces packed together
ROUNDS = 6
CACHED_WORDS = 150_000
PIECES = "id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"

_UNEVEN = re.compile(r"\s\s|^\s|\s$")


#: Fixed value: how byte-level tokenizers of this kind cut a text before merging.
WORD_PATTERN = (
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)


def encode(tokenizer, text: str) -> bytes:
    """Ids of a whole text as little-endian 32-bit numbers."""
    return np.array(tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def word_merger(path: str):
    """An encoder of single words with the same ids, several times faster on short input.

    Only for byte-level vocabularies whose ids follow the order of the merges; else None.
    """
    import tiktoken

    with open(path, encoding="utf-8") as file:
        made = json.load(file)
    model = made["model"]
    plain = made.get("normalizer") is None and made["pre_tokenizer"].get("type") == "ByteLevel"
    if model["type"] != "BPE" or not plain or made["pre_tokenizer"].get("add_prefix_space"):
        return None
    # A byte-level vocabulary writes bytes as printable characters, in this order.
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in shown]
    letters = [chr(b) for b in shown] + [chr(256 + k) for k in range(len(hidden))]
    byte = dict(zip(letters, shown + hidden))
    special = {t["content"] for t in made.get("added_tokens", [])}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    ids = [vocab["".join(pair)] for pair in pairs]
    if ids != sorted(ids) or len(vocab) != len(ids) + 256:
        return None
    ranks = {bytes(byte[c] for c in t): i for t, i in vocab.items()}
    return tiktoken.Encoding(
        "words", pat_str=WORD_PATTERN, mergeable_ranks=ranks, special_tokens={}
    )


class _Ids(dict):
    """Packed ids of a word with what stands before it: a space, or nothing."""

    def __init__(self, tokenizer, merger, lead: str):
        super().__init__()
        self.tokenizer, self.merger, self.lead = tokenizer, merger, lead

    def __missing__(self, word: str) -> bytes:
        text = word if word[:1] == "\n" else self.lead + word
        if self.merger is None or "<|" in text:
            ids = encode(self.tokenizer, text)
        else:
            found = self.merger.encode_ordinary(text)
            ids = struct.pack(f"<{len(found)}I", *found)
        if len(word) <= 40 and len(self) < CACHED_WORDS:
            self[word] = ids
        return ids


class Encoder:
    """Ids of whole texts, remembering words.

    A byte-level tokenizer of this kind cuts before a space or line end that stands alone
    between two other characters, so such texts can be encoded word by word. Any other text
    is given to the tokenizer as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        merger = word_merger(path)
        self.by_word = merger is not None
        self.first = _Ids(self.tokenizer, merger, "")
        self.later = _Ids(self.tokenizer, merger, " ")

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.by_word or _UNEVEN.search(text):
            return encode(self.tokenizer, text)
        words = text.replace("\n", " \n").split(" ")
        return self.first[words[0]] + b"".join(map(self.later.__getitem__, words[1:]))


@functools.lru_cache(maxsize=1)
def encoder_at(path: str) -> Encoder:
    """One encoder per worker process, so that its memory of words outlives a task."""
    return Encoder(path)


def pieces(
    docs: DataFrame, tokenizer_path: str, limit: int, end_id: int, id_col: str, text_col: str
) -> DataFrame:
    """One row per piece: id, piece, start, length and crc32 of its ids."""
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("piece", pa.int32()),
            ("start", pa.int64()),
            ("length", pa.int64()),
            ("ids_crc32", pa.int64()),
        ]
    )
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_at(tokenizer_path)
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for id_, text in zip(batch.column("id").to_pylist(), batch.column("text")):
                ids = encoder(text.as_py()) + end
                n = len(ids) // 4
                heads = [0, *range(n % limit or limit, n, limit)]
                for k, (a, b) in enumerate(zip(heads, [*heads[1:], n])):
                    row = id_, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])
                    for column, value in zip(out, row):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, f.type) for v, f in zip(out, schema)], schema=schema
            )

    return texts(docs, id_col, text_col).mapInArrow(cut, PIECES)


def lower_bound(sizes: np.ndarray, limit: int) -> int:
    """Sequences that any packing needs, by dual-feasible functions of size / limit."""
    if len(sizes) == 0:
        return 0
    counts = np.bincount(sizes, minlength=limit + 1).astype(np.int64)
    size = np.arange(limit + 1)
    best = -(-int((counts * size).sum()) // limit)
    # Threshold family: above limit - e counts as 1, below e as 0, the rest as it is.
    above = np.cumsum(counts[::-1])[::-1]
    mass = np.concatenate([[0], np.cumsum(counts * size)])
    e = np.arange(1, limit // 2 + 1)
    large = np.where(limit - e + 1 <= limit, above[limit - e + 1], 0)
    middle = mass[limit - e + 1] - mass[e]
    best = max(best, int((large + -(-middle // limit)).max()))
    # Rounding family: floor((k + 1) x) / k, or x where (k + 1) x is whole.
    for k in range(1, 65):
        whole = ((k + 1) * size) % limit == 0
        value = np.where(whole, k * size, ((k + 1) * size // limit) * limit)
        best = max(best, -(-int((counts * value).sum()) // (k * limit)))
    return best


def best_fit(sizes: np.ndarray, limit: int) -> np.ndarray:
    """Sequence of each size, by best-fit decreasing over sequences kept by their free space."""
    where = np.zeros(len(sizes), np.int64)
    open_: list[list[int]] = [[] for _ in range(limit + 1)]
    free = 0  # bit r is set if a sequence has r left
    n = 0
    for k in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[k])
        fits = free >> size
        if fits:
            room = size + (fits & -fits).bit_length() - 1
            bin_ = open_[room].pop()
            if not open_[room]:
                free ^= 1 << room
        else:
            room, bin_, n = limit, n, n + 1
        where[k] = bin_
        room -= size
        if room:
            open_[room].append(bin_)
            free |= 1 << room
    return where


def _pack(limit: int, last: bool, stamp: int):
    def pack(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["length", "id", "piece", "uid"], ascending=[False, True, True, True])
        sizes = rows["length"].to_numpy()
        where = best_fit(sizes, limit)
        n = int(where.max()) + 1
        order = np.argsort(where, kind="stable")
        ends = np.cumsum(sizes[order])
        first = np.flatnonzero(np.r_[True, np.diff(where[order]) > 0])
        begin = np.repeat((ends - sizes[order])[first], np.diff(np.r_[first, len(order)]))
        offset = np.empty(len(order), np.int64)
        offset[order] = ends - sizes[order] - begin
        fill = np.bincount(where, sizes, minlength=n)
        gap = n > lower_bound(sizes, limit)
        emptiest = int(fill.argmin())
        again = np.full(len(rows), gap) | ((where == emptiest) & (fill[emptiest] < limit))
        part = int(rows["part"].iloc[0])
        return rows.drop(columns="part").assign(
            sequence_id=(stamp << 56) | (part << 28) | where,
            offset=offset,
            again=again & (not last),
            certified=not gap,
        )

    return pack


def best_fit_packing(
    docs: DataFrame,
    tokenizer_path: str,
    limit: int = 1024,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Pieces with their sequence and place: doc_id, piece, start, length, ids_crc32,
    sequence_id, offset, certified (whether its partition met its lower bound)."""
    cut = pinned(pieces(docs, tokenizer_path, limit, end_id, id_col, text_col), "pieces")
    cut = cut.withColumn("uid", F.monotonically_increasing_id())
    full = cut.where(F.col("length") == limit).select(
        "*",
        (F.lit(1 << 60) + F.col("uid")).alias("sequence_id"),
        F.lit(0).cast("bigint").alias("offset"),
        F.lit(False).alias("again"),
        F.lit(True).alias("certified"),
    )
    done, left = full, cut.where(F.col("length") < limit)
    kind = f"{PIECES}, uid bigint, sequence_id bigint, offset bigint, again boolean, certified boolean"
    before = None
    for stamp in range(1, ROUNDS + 1):
        n = left.count()
        if n == 0:
            break
        parts = -(-n // GROUP)
        # One partition left, or no progress: this packing stands.
        last = stamp == ROUNDS or parts == 1 or (before is not None and n >= before)
        before = n
        dealt = left.withColumn("part", F.pmod(F.xxhash64("uid", F.lit(stamp)), F.lit(parts)))
        packed = dealt.groupBy("part").applyInPandas(_pack(limit, last, stamp), kind)
        packed = pinned(packed, "packed")
        done = done.unionByName(packed.where("not again"))
        left = packed.where("again").select(*cut.columns)
        if last:
            break
    return done.select(
        F.col("id").alias("doc_id"),
        "piece",
        "start",
        "length",
        "ids_crc32",
        "sequence_id",
        "offset",
        "certified",
    )
