"""Suffix-array dedup: bytes covered by a long string that also starts elsewhere.

Every string of LENGTH bytes names an anchor, the gram of GRAM bytes in it with the least hash,
so equal strings name equal anchors and meet. Runs of strings with one anchor are segments;
each byte position starts a string of one segment only. Anchors that come once are dropped.
Equal segments are aggregated: all strings of a segment that comes twice are repeated. One
copy of each different segment is fetched, grouped by anchor, and a suffix array (to the depth
of LENGTH, by prefix doubling) is built over blocks of whole groups. Longest previous factors
follow from the previous and next smaller positions in suffix order: a position whose factor
reaches LENGTH repeats an earlier one; in the same way, larger positions give those that are
repeated later. The query removes both; ``keep_first`` keeps the first of each string.

An anchor with more than HOT different segments (the edge of a passage that a third of all
texts share) is not gathered. Its segments are cut into blocks of STEP strings by their place
before the anchor; the bytes that all strings of a block share are the block's new anchor, and
blocks are treated as segments were. What is still too common then is split to the finest
groups there are, one per string, counted by hash in Spark.

Defined cases: null text is empty; texts shorter than LENGTH keep everything; strings never
cross texts; removed spans may cut characters, so kept texts are bytes; repeated rows repeat
each other; null ids take part; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernels
from plumbline.llm.tables import filtered, key_filter, pinned, texts

LENGTH = 200
GRAM = 48
HOT = 500
STEP = 8
BLOCK_BYTES = 1 << 20
_CODES = (kernels.byte_codes(b"", fold=False), kernels.mix(kernels.byte_codes(b"", fold=False)))
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
SEGMENT = (
    "id bigint, print bigint, at bigint, n int, lead int, anchor bigint, s1 bigint, s2 bigint"
)
BODY = "cls bigint, anchor bigint, id bigint, at bigint, n int, lead int, body binary"


def _words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on, as one number; big-endian, so numbers sort as text."""
    own = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    for k in (1, 2, 4):
        own = (own[: len(own) - k] << np.uint64(8 * k)) | own[k:]
    return own[: len(data)]


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` consecutive values."""
    n = len(values)
    full = -(-n // width) * width
    padded = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


@functools.lru_cache(maxsize=4)
def _tables(kind: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a base and of its inverse."""
    base = int(_BASES[kind])
    inverse = pow(base, -1, 1 << 64)
    out = []
    for value in (base, inverse):
        table = np.full(n, value, np.uint64)
        table[0] = 1
        out.append(np.cumprod(table))
    return out[0], out[1]


def _print_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of each span of the data."""
    size = 1 << max(20, int(len(data)).bit_length())
    out = []
    for kind in (0, 1):
        power, inverse = _tables(kind, size)
        total = np.concatenate(
            [np.zeros(1, np.uint64), np.cumsum(_CODES[kind][data] * power[: len(data)], dtype=np.uint64)]
        )
        own = (total[ends] - total[starts]) * inverse[starts]
        out.append(kernels.mix(own + (ends - starts).astype(np.uint64)).view(np.int64))
    return out


def segments_of(data: np.ndarray, offsets: np.ndarray):
    """(start, number of strings, anchor hash, bytes before the anchor) of the segments of
    texts laid end to end."""
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none, none
    words = _words(data)
    grams = np.zeros(n - GRAM + 1, np.uint64)
    for k in range(0, GRAM, 8):
        grams = kernels.mix(grams + words[k : n - GRAM + 1 + k] * _BASES[1])
    # Hash above, place below: ties go to the first.
    keyed = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=np.uint64)
    anchor = (_least(keyed, LENGTH - GRAM + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = np.flatnonzero(doc[: n - LENGTH + 1] == doc[LENGTH - 1 :])
    if len(inside) == 0:
        return none, none, none, none
    own = anchor[inside]
    fresh = np.r_[True, (own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)]
    heads = np.flatnonzero(fresh)
    counts = np.diff(np.r_[heads, len(inside)])
    hashes = kernels.mix(grams[own[heads]]).view(np.int64)
    return inside[heads], counts, hashes, own[heads] - inside[heads]


def _chunks(column: pa.Array):
    blob, offsets = kernels.string_buffers(column)
    for a, b in kernels.spans_of(offsets):
        yield a, blob[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def anchors(rows: DataFrame) -> DataFrame:
    """anchor, n: anchors of the segments of each batch, counted."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, data, offsets in _chunks(batch.column("text")):
                found, n = np.unique(segments_of(data, offsets)[2], return_counts=True)
                yield pa.RecordBatch.from_pydict({"anchor": found, "n": n.astype(np.int64)})

    return rows.select("text").mapInArrow(read, "anchor bigint, n bigint")


def segments(rows: DataFrame, own) -> DataFrame:
    """Segments whose anchor passes the filter: id, print, at, n (strings), anchor, s1, s2."""
    shared = rows.sparkSession.sparkContext.broadcast(own)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, data, offsets in _chunks(batch.column("text")):
                found = segments_of(data, offsets)
                keep = shared.value.passes(found[2])
                starts, counts, anchor, lead = (f[keep] for f in found)
                s1, s2 = _print_spans(data, starts, starts + counts + LENGTH - 1)
                doc = np.searchsorted(offsets, starts, "right") - 1
                at = pa.array(doc + first)
                yield pa.RecordBatch.from_pydict(
                    {
                        "id": batch.column("id").take(at),
                        "print": batch.column("print").take(at),
                        "at": pa.array(starts - offsets[doc]),
                        "n": pa.array(counts.astype(np.int32)),
                        "lead": pa.array(lead.astype(np.int32)),
                        "anchor": pa.array(anchor),
                        "s1": pa.array(s1),
                        "s2": pa.array(s2),
                    }
                )

    return rows.mapInArrow(read, SEGMENT)


# Suffix order and longest previous factors


def suffix_order(data: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The starts in the order of the ``length`` bytes from them on, and which run of equal
    ones each belongs to (neighbours in suffix order with a common prefix of ``length``).

    Prefix doubling: ranks of all places by their first few bytes, then by twice as many, and
    so on; the last step overlaps. Keys are sorted with the place in their low bits, so that
    sorting numbers is all there is to do, and runs stand in the order of the starts.
    ``data`` must reach ``length`` bytes beyond every start. A block has fewer than 2^21 places.
    """
    bits = np.uint64(max(len(data), len(starts)).bit_length())
    if 3 * int(bits) > 63:
        raise ValueError("too long a block for a suffix array")

    def ordered(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        packed = np.sort((keys << bits) | np.arange(len(keys), dtype=np.uint64))
        order = (packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        packed >>= bits
        return order, np.cumsum(np.r_[False, packed[1:] != packed[:-1]])

    def ranked(keys: np.ndarray) -> np.ndarray:
        order, run = ordered(keys)
        rank = np.empty(len(keys), np.uint64)
        rank[order] = run
        return rank

    def joined(by: int) -> np.ndarray:
        """The rank of each place, followed by that of the place ``by`` bytes on."""
        out = rank << bits
        if by < len(rank):
            out[: len(rank) - by] |= rank[by:]
        return out

    depth = min(length, (64 - int(bits)) // 8)
    rank = ranked(_words(data) >> np.uint64(8 * (8 - depth)))
    while depth * 2 <= length:
        rank = ranked(joined(depth))
        depth *= 2
    return ordered(joined(length - depth)[starts])


def factors(run: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per entry in suffix order: whether its longest previous factor, and its longest later
    one, reach the depth of the order.

    The longest previous factor is the longer of the common prefixes with the previous and the
    next smaller position in suffix order, and reaches the depth if one of these lies in the
    entry's run. Runs stand in order of position: the neighbour before an entry is its previous
    smaller position as long as it is in the run, and no smaller one follows there. For later
    factors it is the other way round.
    """
    same = run[1:] == run[:-1]
    return np.r_[False, same][: len(run)], np.r_[same, False][: len(run)]


def repeated_starts(parts: list[bytes], counts: list[int], keep_first: bool) -> list[list[tuple[int, int]]]:
    """Per segment, the ranges (from, to) of its strings that come elsewhere in the block.

    Segments are given in the order of their places in the corpus.
    """
    data = np.frombuffer(b"".join(parts), np.uint8)
    begins = np.cumsum([0, *[len(p) for p in parts]])[:-1]
    n = np.array(counts)
    owner = np.repeat(np.arange(len(parts)), n)
    inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    starts = begins[owner] + inner
    order, run = suffix_order(data, starts, LENGTH)
    earlier, later = factors(run)
    hit = earlier if keep_first else earlier | later
    found = np.zeros(len(starts), bool)
    found[order] = hit
    return ranges(found, owner, inner, len(parts))


def ranges(found: np.ndarray, owner: np.ndarray, inner: np.ndarray, n: int) -> list[list[tuple[int, int]]]:
    """Per owner the runs (from, to) of consecutive found places."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    at = np.flatnonzero(found)
    if len(at):
        cut = np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at][1:] != owner[at][:-1])]
        heads = np.flatnonzero(cut)
        tails = np.r_[heads[1:], len(at)] - 1
        for a, b in zip(at[heads].tolist(), at[tails].tolist()):
            out[owner[a]].append((int(inner[a]), int(inner[b]) + 1))
    return out


def _fetch(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """cls, anchor, id, at, n, lead, body: the bytes of the wanted segments (cls, anchor, id,
    print, at, n, lead)."""
    asked = wanted.groupBy("id", "print").agg(
        F.collect_list(F.struct("cls", "anchor", "at", "n", "lead")).alias("asked")
    )
    asked = pinned(asked, "asked")
    near = filtered(rows, "print", key_filter(asked.select("print"), "print"))
    both = near.alias("r").join(
        asked.alias("a"),
        F.col("r.id").eqNullSafe(F.col("a.id")) & (F.col("r.print") == F.col("a.print")),
    ).select("r.id", "r.text", "a.asked")
    schema = pa.schema(
        [
            ("cls", pa.int64()),
            ("anchor", pa.int64()),
            ("id", pa.int64()),
            ("at", pa.int64()),
            ("n", pa.int32()),
            ("lead", pa.int32()),
            ("body", pa.binary()),
        ]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, offsets = kernels.string_buffers(batch.column("text"))
            out: list[list] = [[] for _ in schema]
            held = 0
            for k, asked in enumerate(batch.column("asked")):
                id_ = batch.column("id")[k].as_py()
                own = blob[offsets[k] : offsets[k + 1]].tobytes()
                for one in asked.as_py():
                    body = own[one["at"] : one["at"] + one["n"] + LENGTH - 1]
                    row = one["cls"], one["anchor"], id_, one["at"], one["n"], one["lead"], body
                    for column, value in zip(out, row):
                        column.append(value)
                    held += len(body)
                if held > 4 << 20:
                    yield _batch(out, schema)
                    out, held = [[] for _ in schema], 0
            yield _batch(out, schema)

    # Repeated rows bring their segments twice.
    return both.mapInArrow(cut, BODY).groupBy("cls").agg(
        *[F.any_value(c).alias(c) for c in ("anchor", "id", "at", "n", "lead", "body")]
    )


def _batch(columns: list[list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema
    )


def _by_suffix(bodies: DataFrame, keep_first: bool) -> DataFrame:
    """cls, a, b: ranges of repeated strings, by suffix arrays over blocks of anchors."""
    schema = pa.schema([("cls", pa.int64()), ("a", pa.int64()), ("b", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def finish() -> pa.RecordBatch:
            found = repeated_starts([h[2] for h in held], [h[1] for h in held], keep_first)
            rows = [(h[0], a, b) for h, own in zip(held, found) for a, b in own]
            return _batch([[r[i] for r in rows] for i in range(3)], schema)

        last = None
        for batch in batches:
            for cls, anchor, n, body in zip(
                *(batch.column(c).to_pylist() for c in ("cls", "anchor", "n", "body"))
            ):
                if anchor != last and size >= BLOCK_BYTES:
                    yield finish()
                    held, size = [], 0
                last = anchor
                held.append((cls, n, body))
                size += len(body)
        if held:
            yield finish()

    ordered = bodies.repartition("anchor").sortWithinPartitions("anchor", "id", "at")
    return ordered.select("cls", "anchor", "n", "body").mapInArrow(read, "cls bigint, a bigint, b bigint")


def _by_block(bodies: DataFrame, keep_first: bool) -> DataFrame:
    """The same for anchors with very many different segments, by blocks of their strings."""
    names = ("cls", "id", "at", "k", "n", "anchor", "s1", "s2", "body")
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    schema = pa.schema(list(zip(names, kinds)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cls, id_, at, n, lead, body = (
                batch.column(c).to_pylist() for c in ("cls", "id", "at", "n", "lead", "body")
            )
            if not cls:
                continue
            # String k lies lead - k bytes before the anchor; blocks are cut by that.
            rows, whole, core = [], [], []
            base = 0
            for row in range(len(cls)):
                for j in range((lead[row] - n[row] + 1) // STEP, lead[row] // STEP + 1):
                    first = max(0, lead[row] - (j * STEP + STEP - 1))
                    last = min(n[row] - 1, lead[row] - j * STEP)
                    rows.append((row, first, last - first + 1, j))
                    whole.append((base + first, base + last + LENGTH))
                    # What the strings of a full block share.
                    at_core = lead[row] - j * STEP
                    core.append((base + at_core, base + at_core - STEP + 1 + LENGTH))
                base += len(body[row])
            data = np.frombuffer(b"".join(body), np.uint8)
            w, c = np.array(whole), np.array(core)
            s1, s2 = _print_spans(data, w[:, 0], w[:, 1])
            anchor = _print_spans(data, c[:, 0], c[:, 1])[0]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([cls[r[0]] for r in rows], pa.int64()),
                    pa.array([id_[r[0]] for r in rows], pa.int64()),
                    pa.array([at[r[0]] + r[1] for r in rows], pa.int64()),
                    pa.array([r[1] for r in rows], pa.int64()),
                    pa.array([r[2] for r in rows], pa.int32()),
                    pa.array(anchor),
                    pa.array(s1),
                    pa.array(s2),
                    pa.array([body[r[0]][r[1] : r[1] + r[2] - 1 + LENGTH] for r in rows], pa.binary()),
                ],
                schema=schema,
            )

    kind = "cls bigint, id bigint, at bigint, k bigint, n int, anchor bigint, s1 bigint, s2 bigint, body binary"
    blocks = bodies.select("cls", "id", "at", "n", "lead", "body").mapInArrow(cut, kind)
    blocks = pinned(blocks.withColumn("bid", F.monotonically_increasing_id()), "blocks")
    same = ["anchor", "s1", "s2", "n"]
    rep = F.min(F.struct("id", "at", "cls", "bid")).alias("rep")
    classes = blocks.groupBy(*same).agg(F.count(F.lit(1)).alias("times"), rep)
    classes = pinned(classes, "block_classes")
    copies = blocks.drop("body").join(classes.where("times > 1"), same)
    if keep_first:
        copies = copies.where(F.col("bid") != F.col("rep.bid"))
    copies = copies.select("cls", F.col("k").alias("a"), (F.col("k") + F.col("n")).alias("b"))
    many = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    reps = classes.join(many, "anchor").select(F.col("rep.bid").alias("bid"), "kinds")
    own = blocks.drop("cls").join(reps, "bid").withColumnRenamed("bid", "cls")
    own = pinned(own.select("cls", "anchor", "id", "at", "n", "body", "kinds"), "block_bodies")
    inner = _by_suffix(own.where(F.col("kinds") <= HOT), keep_first).unionAll(
        _by_string(own.where(F.col("kinds") > HOT), keep_first)
    )
    back = inner.withColumnRenamed("cls", "bid").join(blocks.select("bid", "cls", "k"), "bid")
    return copies.unionAll(
        back.select("cls", (F.col("k") + F.col("a")).alias("a"), (F.col("k") + F.col("b")).alias("b"))
    )


def _by_string(bodies: DataFrame, keep_first: bool) -> DataFrame:
    """The same with one group per string."""
    schema = pa.schema(
        [("cls", pa.int64()), ("k", pa.int64()), ("w1", pa.int64()), ("w2", pa.int64())]
    )

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = b"".join(batch.column("body").to_pylist())
            n = batch.column("n").to_numpy(zero_copy_only=False).astype(np.int64)
            if len(n) == 0:
                continue
            sizes = n + LENGTH - 1
            owner = np.repeat(np.arange(len(n)), n)
            inner = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            starts = (np.cumsum(sizes) - sizes)[owner] + inner
            w1, w2 = _print_spans(np.frombuffer(data, np.uint8), starts, starts + LENGTH)
            cls = batch.column("cls").to_numpy(zero_copy_only=False)[owner]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c) for c in (cls, inner, w1, w2)], schema=schema
            )

    strings = bodies.select("cls", "n", "body").mapInArrow(
        read, "cls bigint, k bigint, w1 bigint, w2 bigint"
    )
    strings = pinned(strings.join(bodies.select("cls", "id", "at"), "cls"), "hot_strings")
    twice = strings.groupBy("w1", "w2").agg(
        F.count(F.lit(1)).alias("times"), F.min(F.struct("id", "at", "k", "cls")).alias("first")
    ).where("times > 1")
    found = strings.join(twice, ["w1", "w2"])
    if keep_first:
        found = found.where((F.col("first.cls") != F.col("cls")) | (F.col("first.k") != F.col("k")))
    return found.select("cls", F.col("k").alias("a"), (F.col("k") + 1).alias("b"))


def repeated_spans(rows: DataFrame, keep_first: bool = False) -> DataFrame:
    """id, print, spans: the byte ranges (a, b) of each text (id, print, text) to be removed.

    Only texts with a span are listed; spans may touch or overlap.
    """
    twice = anchors(rows).groupBy("anchor").agg(F.sum("n").alias("n")).where("n > 1")
    own = key_filter(pinned(twice.select("anchor"), "anchors"), "anchor")
    found = pinned(segments(rows, own), "segments")
    rep = F.min(F.struct("id", "print", "at")).alias("rep")
    classes = found.groupBy("anchor", "s1", "s2", "n", "lead").agg(
        F.count(F.lit(1)).alias("times"), rep
    )
    classes = pinned(
        classes.select("anchor", "s1", "s2", "n", "lead", "times", "rep.*").withColumn(
            "cls", F.monotonically_increasing_id()
        ),
        "segment_classes",
    )
    # Wholly repeated segments.
    whole = classes.where("times > 1").select(
        "anchor", "s1", "s2", "n", "lead", F.struct("id", "print", "at").alias("rep")
    )
    copies = found.join(whole, ["anchor", "s1", "s2", "n", "lead"])
    if keep_first:
        copies = copies.where(
            ~F.struct("id", "print", "at").eqNullSafe(F.col("rep"))
        )
    marks = copies.select(
        "id", "print", F.col("at").alias("a"), (F.col("at") + F.col("n") + LENGTH - 1).alias("b")
    )
    # Different segments of one anchor.
    many = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("kinds")).where("kinds > 1")
    wanted = classes.join(many, "anchor")
    bodies = _fetch(rows, wanted.select("cls", "anchor", "id", "print", "at", "n", "lead"))
    bodies = pinned(bodies.join(many, "anchor"), "bodies")
    ranges_ = _by_suffix(bodies.where(F.col("kinds") <= HOT), keep_first).unionAll(
        _by_block(bodies.where(F.col("kinds") > HOT), keep_first)
    )
    # Copies of a class that is wholly repeated are marked already, its first one if all go.
    places = classes if keep_first else classes.where("times = 1")
    more = ranges_.join(places.select("cls", "id", "print", "at"), "cls").select(
        "id",
        "print",
        (F.col("at") + F.col("a")).alias("a"),
        (F.col("at") + F.col("b") + LENGTH - 1).alias("b"),
    )
    return marks.unionAll(more).groupBy("id", "print").agg(
        F.collect_list(F.struct("a", "b")).alias("spans")
    )


def suffix_dedup(
    docs: DataFrame, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes, spans (maximal removed byte ranges a, b), kept (the remaining bytes)."""
    rows = texts(docs, id_col, text_col).withColumn("print", F.xxhash64("id", "text"))
    spans = pinned(repeated_spans(rows, keep_first), "spans")
    own = key_filter(spans.select("print"), "print")
    kind = "id bigint, n_bytes bigint, spans array<struct<a: bigint, b: bigint>>, kept binary"
    span = pa.struct([("a", pa.int64()), ("b", pa.int64())])
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("n_bytes", pa.int64()),
            ("spans", pa.list_(span)),
            ("kept", pa.binary()),
        ]
    )

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blob, offsets = kernels.string_buffers(batch.column("text"))
            out: list[list] = [[] for _ in schema]
            for k, found in enumerate(batch.column("spans")):
                text = blob[offsets[k] : offsets[k + 1]].tobytes()
                merged: list[dict] = []
                for one in sorted(found.as_py() or [], key=lambda s: s["a"]):
                    if merged and one["a"] <= merged[-1]["b"]:
                        merged[-1]["b"] = max(merged[-1]["b"], one["b"])
                    else:
                        merged.append(dict(one))
                cuts = [0, *[v for s in merged for v in (s["a"], s["b"])], len(text)]
                kept = b"".join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2]))
                row = batch.column("id")[k].as_py(), len(text), merged, kept
                for column, value in zip(out, row):
                    column.append(value)
            yield _batch(out, schema)

    touched = filtered(rows, "print", own).alias("r").join(
        spans.alias("s"),
        F.col("r.id").eqNullSafe(F.col("s.id")) & (F.col("r.print") == F.col("s.print")),
        "left",
    )
    touched = touched.select("r.id", "r.text", "s.spans").mapInArrow(remove, kind)
    others = filtered(rows, "print", own, passing=False).select(
        "id",
        F.octet_length("text").cast("bigint").alias("n_bytes"),
        F.array().cast("array<struct<a: bigint, b: bigint>>").alias("spans"),
        F.col("text").cast("binary").alias("kept"),
    )
    return touched.unionAll(others).withColumnRenamed("id", "doc_id")


def digest(kept: DataFrame) -> DataFrame:
    removed: Column = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["b"] - s["a"])
    return kept.select(
        "doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("bigint").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
