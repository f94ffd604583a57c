"""N-gram Jaccard join by T-occurrence search (DivideSkip).

Texts become sets of word shingles (64-bit hashes). Texts with equal sets form a class. A
shingle's inverted list holds the classes that have it. To reach the required overlap T with a
set of n shingles, a partner must be on one of the n - T + 1 shortest lists of that set, so
only those lists are built, in Spark, with one row per entry; the long lists are never
gathered. What is short is settled by one table of document counts over all texts (shingles
hashed to counters in proportion to the texts, up to a fixed number). Two entries of a
list become candidates only if the place of the shingle among each one's short lists leaves
room for T, which depends on both sizes, and if the parities of both sets in some hundred
buckets, whose difference never exceeds that of the sets, do not rule T out.

The remaining candidates are searched block by block: the lists of the query's shingles over
the block's candidates are split as DivideSkip does, the short ones heap-merged with counts,
the long ones probed by binary search, and candidates that reach T are links.

Candidates are taken in two rounds, so that a group of many near copies does not become all
its pairs. First every entry of a list meets the list's first class; links give components.
Then entries of different components on one list meet, the largest component of the list only
as the other side. Pairs inside a component cannot change it and are not formed: ``links`` is a
spanning set of links, enough to connect each component, and not all links inside it.

Defined cases: null text counts as empty; an empty set links with nothing and its component is
the row's own id; rows with a null id take part, and a component's id is the smallest id in it
that is not null; repeated rows are a class of copies; an empty table gives no rows; further
columns of the input are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import kernels
from plumbline.llm.tables import (
    KeyFilter,
    components,
    drop_pinned,
    key_filter,
    numbered,
    passing_rows,
    pinned,
    texts,
    without,
)

MAX_COUNTERS = 1 << 25  # of one byte
WORD_BYTES = 32  # bytes of text for one counter: a table of 3 % of the text
SPAN = 1 << 16  # counters that are summed together
HELD = 1 << 20  # shingles that a task holds before it sends their counts
STEPS = 8  # codes for each doubling of a count: a byte reaches beyond 2^31
MU = 0.01  # DivideSkip's weight of a probe against a merge step
PARITY = 256  # buckets
BITS = [f"p{k}" for k in range(PARITY // 64)]


@dataclass
class JaccardJoin:
    members: DataFrame  # doc_id, n_shingles, component_id, n_copies (rows with the same set)
    links: DataFrame  # doc_a, doc_b, n_a, n_b, overlap: a spanning set of verified links between classes


def sets_of(column: pa.Array, width: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first row, sorted shingle set of each text) for pieces of a batch."""
    for chunk in kernels.chunks(column):
        found, runs = kernels.shingles(chunk.hashes, chunk.heads, width)
        yield chunk.first, [np.unique(found[a:b]) for a, b in zip(runs[:-1], runs[1:])]


def _fingerprint(own: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed integers."""
    if len(own) == 0:
        return 0, 0
    one = kernels.mix(own + np.uint64(0x51ED270B)).sum(dtype=np.uint64)
    two = kernels.mix(own ^ np.uint64(0xA5A5A5A55A5A5A5A)).sum(dtype=np.uint64)
    return int(one.astype(np.int64)), int(two.astype(np.int64))


def _slot(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.uint32)


def _planes(values: np.ndarray) -> bytes:
    """Whole numbers with all first bytes before all second ones, which packs small ones well."""
    return values.view(np.uint8).reshape(len(values), -1).T.tobytes()


def _unplaned(data: bytes, kind: type) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(width, -1).T).view(kind).ravel()


def _partial_counts(slots: np.ndarray, schema: pa.Schema) -> pa.RecordBatch:
    """One row per span of counters: which of them were met, as steps, and how often."""
    met, times = np.unique(slots, return_counts=True)
    cuts = np.flatnonzero(np.diff(met // SPAN)) + 1
    rows = [
        (
            int(one[0]) // SPAN,
            _planes(np.diff(one % SPAN, prepend=np.uint32(0)).astype(np.uint16)),
            _planes(n.astype(np.uint32)),
        )
        for one, n in zip(np.split(met, cuts), np.split(times, cuts))
        if len(one)
    ]
    return pa.RecordBatch.from_pydict(
        {name: [row[k] for row in rows] for k, name in enumerate(schema.names)}, schema
    )


def document_counts(rows: DataFrame, width: int) -> np.ndarray:
    """How many texts have a shingle in each counter, over all texts, as one byte each: 0 for
    none, else 1 and STEPS more for each doubling.

    There is a counter for every WORD_BYTES of text, up to MAX_COUNTERS. Tasks send the counters
    they met and no others; the sums are made per span of counters.
    """
    n_bytes = rows.agg(F.sum(F.octet_length("text").cast("bigint"))).first()[0] or 0
    size = min(MAX_COUNTERS, max(SPAN, 1 << (n_bytes // WORD_BYTES).bit_length()))
    schema = pa.schema([("span", pa.int32()), ("steps", pa.binary()), ("times", pa.binary())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for _, sets in sets_of(batch.column("text"), width):
                held += [_slot(own, size) for own in sets]
                if sum(map(len, held)) >= HELD:
                    yield _partial_counts(np.concatenate(held), schema)
                    held = []
        if held:
            yield _partial_counts(np.concatenate(held), schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for span, steps, times in zip(*(column.to_pylist() for column in batch.columns)):
                own = total.setdefault(span, np.zeros(SPAN, np.uint64))
                own[np.cumsum(_unplaned(steps, np.uint16), dtype=np.int64)] += _unplaned(times, np.uint32)
        for span, own in total.items():
            code = np.floor(np.log2(np.maximum(own, 1)) * STEPS) + (own > 0)
            data = np.minimum(code, 255).astype(np.uint8).tobytes()
            yield pa.RecordBatch.from_pydict({"span": pa.array([span], pa.int32()), "data": [data]})

    parts = rows.select("text").mapInArrow(count, "span int, steps binary, times binary")
    parts = parts.repartition(16, "span").mapInArrow(add, "span int, data binary")
    out = np.zeros(size, np.uint8)
    for span, data in parts.collect():  # MAX_COUNTERS bytes at most
        out[span * SPAN : (span + 1) * SPAN] = np.frombuffer(data, np.uint8)
    return out


def signatures(rows: DataFrame, width: int, percent: int, counts: np.ndarray) -> DataFrame:
    """Per text: size and fingerprint of its set, and the shingles whose lists are shortest."""
    shared = rows.sparkSession.sparkContext.broadcast(counts)  # MAX_COUNTERS bytes at most
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("n", pa.int32()),
            ("f1", pa.int64()),
            ("f2", pa.int64()),
            ("short", pa.list_(pa.int64())),
            *[(name, pa.int64()) for name in BITS],
        ]
    )

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            for first, sets in sets_of(batch.column("text"), width):
                prints, short = [], []
                parity = np.zeros((len(sets), len(BITS)), np.int64)
                for row, own in zip(parity, sets):
                    prints.append(_fingerprint(own))
                    odd = np.bincount((own >> np.uint64(40)).astype(np.int64) % PARITY, minlength=PARITY)
                    row[:] = np.packbits((odd & 1).astype(np.uint8)).view(np.int64)
                    keep = len(own) + (percent * len(own)) // -100 + 1 if len(own) else 0
                    frequency = table[_slot(own, len(table))]
                    limit = np.partition(frequency, keep - 1)[keep - 1] if keep else 0
                    near = np.flatnonzero(frequency <= limit)
                    # Sets are sorted, so equal counts stay in the order of their hashes.
                    near = near[np.argsort(frequency[near], kind="stable")][:keep]
                    short.append(own[near].view(np.int64))
                offsets = np.concatenate([[0], np.cumsum([len(s) for s in short])])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("id").slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int32()),
                        pa.array([p[0] for p in prints], pa.int64()),
                        pa.array([p[1] for p in prints], pa.int64()),
                        pa.ListArray.from_arrays(
                            pa.array(offsets, pa.int32()), pa.array(np.concatenate(short))
                        ),
                        *[pa.array(np.ascontiguousarray(bits)) for bits in parity.T],
                    ],
                    schema=schema,
                )

    bits = ", ".join(f"{name} bigint" for name in BITS)
    kind = f"id bigint, n int, f1 bigint, f2 bigint, short array<bigint>, {bits}"
    return rows.mapInArrow(sign, kind)


def list_entries(classes: DataFrame, own: KeyFilter) -> DataFrame:
    """cls, pos, token of the short lists whose shingle passes the filter."""
    shared = classes.sparkSession.sparkContext.broadcast(own)  # MAX_BITS / 8 bytes at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            short = batch.column("short")
            token = short.flatten().to_numpy(zero_copy_only=False)
            lengths = np.diff(short.offsets.to_numpy())
            pos = np.arange(len(token)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            cls = np.repeat(batch.column("cls").to_numpy(zero_copy_only=False), lengths)
            keep = shared.value.passes(token)
            yield pa.RecordBatch.from_pydict(
                {
                    "cls": pa.array(cls[keep]),
                    "pos": pa.array(pos[keep].astype(np.int32)),
                    "token": pa.array(token[keep]),
                }
            )

    return classes.mapInArrow(read, "cls bigint, pos int, token bigint")


def class_sets(rows: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """(cls, shingles) of the wanted classes (cls, first_id, n, f1, f2), as packed hashes."""
    schema = pa.schema(
        [("f1", pa.int64()), ("f2", pa.int64()), ("n", pa.int32()), ("shingles", pa.binary())]
    )

    # Only texts that may be wanted are read; one worker chooses them and builds their sets.
    chosen = wanted.select(F.col("first_id").alias("id"))
    shared = rows.sparkSession.sparkContext.broadcast(key_filter(chosen, "id"))  # MAX_BITS / 8 bytes

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = passing_rows(batch, "id", shared.value)
            for _, sets in sets_of(own.column("text"), width):
                prints = [_fingerprint(own) for own in sets]
                yield pa.RecordBatch.from_pydict(
                    {
                        "f1": [p[0] for p in prints],
                        "f2": [p[1] for p in prints],
                        "n": [len(own) for own in sets],
                        "shingles": [own.tobytes() for own in sets],
                    },
                    schema,
                )

    built = rows.select("id", "text").mapInArrow(
        build, "f1 bigint, f2 bigint, n int, shingles binary"
    )
    found = wanted.join(built, ["f1", "f2", "n"]).select("cls", "shingles")
    return found.groupBy("cls").agg(F.any_value("shingles").alias("shingles"))


def divide_skip(
    query: np.ndarray, candidates: list[np.ndarray], needed: np.ndarray
) -> list[tuple[int, int]]:
    """(candidate, overlap) of the candidates whose overlap with the query reaches ``needed``.

    The inverted list of a query shingle holds, in order, the candidates that have it.
    """
    least = int(needed.min())
    owner = np.repeat(np.arange(len(candidates)), [len(c) for c in candidates])
    place = np.searchsorted(query, joined := np.concatenate(candidates))
    hit = place < len(query)
    hit[hit] = query[place[hit]] == joined[hit]
    place, owner = place[hit], owner[hit]
    order = np.lexsort((owner, place))
    place, owner = place[order], owner[order]
    cuts = np.flatnonzero(np.diff(place)) + 1
    lists = sorted(np.split(owner, cuts), key=len) if len(place) else []
    if len(lists) < least:
        return []
    longest = len(lists[-1])
    # As many long lists as pay, so that a candidate still needs least - n_long short ones.
    n_long = min(int(least / (MU * np.log2(longest + 1) + 1)), least - 1, len(lists) - 1)
    short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
    seen: dict[int, int] = {}
    for candidate in heapq.merge(*[one.tolist() for one in short]):
        seen[candidate] = seen.get(candidate, 0) + 1
    alive = np.array(sorted(seen), np.int64)
    counts = np.array([seen[c] for c in alive.tolist()], np.int64)
    for left, one in zip(range(len(long), 0, -1), long):
        fits = counts + left >= needed[alive]
        alive, counts = alive[fits], counts[fits]
        if len(alive) == 0:
            return []
        at = np.searchsorted(one, alive)
        inside = at < len(one)
        inside[inside] = one[at[inside]] == alive[inside]
        counts = counts + inside
    fits = counts >= needed[alive]
    return list(zip(alive[fits].tolist(), counts[fits].tolist()))


def _search(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b, n_a, n_b, overlap) among candidate pairs (x: the query, y)."""
    schema = pa.schema([(n, pa.int64()) for n in ("a", "b", "n_a", "n_b", "overlap")])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").to_numpy(zero_copy_only=False)
            y = batch.column("y").to_numpy(zero_copy_only=False)
            out = []
            cuts = np.flatnonzero(np.diff(x)) + 1
            for block in np.split(np.arange(len(x)), cuts):
                if len(block) == 0:
                    continue
                query = np.frombuffer(batch.column("sx")[int(block[0])].as_py(), np.uint64)
                others = [
                    np.frombuffer(batch.column("sy")[int(k)].as_py(), np.uint64) for k in block
                ]
                sizes = np.array([len(o) for o in others])
                needed = -(-percent * (sizes + len(query)) // (100 + percent))
                for k, overlap in divide_skip(query, others, needed):
                    pair = x[block[0]], y[block[k]], len(query), sizes[k], overlap
                    out.append(tuple(int(v) for v in pair))
            names = schema.names
            yield pa.RecordBatch.from_pydict(
                {n: [row[i] for row in out] for i, n in enumerate(names)}, schema
            )

    y_sets = sets.select(F.col("cls").alias("y"), F.col("shingles").alias("sy"))
    x_sets = sets.select(F.col("cls").alias("x"), F.col("shingles").alias("sx"))
    full = pairs.select("x", "y").join(y_sets, "y").join(x_sets, "x")
    return full.select("x", "y", "sx", "sy").mapInArrow(
        search, "a bigint, b bigint, n_a bigint, n_b bigint, overlap bigint"
    )


def _possible(x: str, y: str, percent: int) -> Column:
    """Whether a shingle that both have can be the first they share if their overlap suffices."""
    n_x, n_y = F.col(f"{x}.n").cast("bigint"), F.col(f"{y}.n").cast("bigint")
    needed = F.ceil((n_x + n_y) * percent / (100 + percent))
    differ = sum(F.bit_count(F.col(f"{x}.{b}").bitwiseXOR(F.col(f"{y}.{b}"))) for b in BITS)
    return (
        (F.col(f"{x}.pos") <= n_x - needed)
        & (F.col(f"{y}.pos") <= n_y - needed)
        & (differ <= n_x + n_y - needed * 2)
    )


def ngram_jaccard_join(
    docs: DataFrame,
    width: int = 5,
    percent: int = 80,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> JaccardJoin:
    """Components of texts whose sets of ``width`` words have a similarity of ``percent`` or more."""
    spark: SparkSession = docs.sparkSession
    rows = texts(docs, id_col, text_col)
    counts = document_counts(rows, width)
    signed = pinned(signatures(rows, width, percent, counts), "signatures")
    grouped = signed.where("n > 0").groupBy("n", "f1", "f2")
    classes = grouped.agg(
        F.min("id").alias("first_id"),
        F.count(F.lit(1)).alias("n_copies"),
        *[F.any_value(name).alias(name) for name in ["short", *BITS]],
    ).withColumn("cls", F.monotonically_increasing_id())
    classes = pinned(classes, "classes")
    lists = classes.select(F.explode("short").alias("token")).groupBy("token")
    lists = pinned(lists.agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("token"), "lists")
    # Most lists have one entry and end here; sizes and parities are fetched for the others.
    entries = list_entries(classes.select("cls", "short"), key_filter(lists, "token"))
    shared = pinned(entries.join(lists, "token"), "shared")
    entries = pinned(shared.join(classes.select("cls", "n", *BITS), "cls"), "entries")
    drop_pinned(lists, shared)

    # The first of a list is the one with the fewest rarer shingles: others are most likely
    # copies of it with changes.
    own = ["pos", "cls", "n", *BITS]
    first = entries.groupBy("token").agg(F.min(F.struct(*own)).alias("first"))
    first = first.select("token", "first.*")
    star = (
        entries.alias("e")
        .join(first.alias("p"), "token")
        .where(F.col("e.cls") != F.col("p.cls"))
        .where(_possible("e", "p", percent))
        .select(F.col("p.cls").alias("x"), F.col("e.cls").alias("y"))
        .distinct()
    )
    star = pinned(star, "stars")
    key = classes.select("cls", "first_id", "n", "f1", "f2")

    def verified(pairs: DataFrame) -> DataFrame:
        own = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
        wanted = pinned(key.join(own, "cls"), "wanted")
        sets = pinned(class_sets(rows, wanted, width), "sets")
        found = pinned(_search(pairs, sets, percent), "links")
        drop_pinned(wanted, sets)
        return found

    links = verified(star)

    label = components(links.select("a", "b"))
    label = label.select(F.col("node").alias("cls"), F.col("component").alias("joined"))
    marked = entries.join(label, "cls", "left").withColumn(
        "component", F.coalesce("joined", "cls")
    )
    marked = pinned(marked.select("token", *own, "component"), "marked")
    drop_pinned(entries)
    shares = marked.groupBy("token", "component").agg(F.count(F.lit(1)).alias("k"))
    main = (
        shares.groupBy("token")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.max(F.struct("k", "component")).alias("main"),
        )
        .where("parts > 1")
        .select("token", F.col("main.component").alias("main"))
    )
    mixed = marked.join(main, "token")
    minor = mixed.where("component != main")
    cross = (
        minor.alias("e")
        .join(mixed.alias("p"), "token")
        .where(F.col("e.component") != F.col("p.component"))
        .where((F.col("p.component") == F.col("p.main")) | (F.col("e.cls") < F.col("p.cls")))
        .where(_possible("e", "p", percent))
        .select(
            F.least("e.cls", "p.cls").alias("x"), F.greatest("e.cls", "p.cls").alias("y")
        )
        .distinct()
        .join(star, ["x", "y"], "left_anti")
    )
    cross = pinned(cross, "crossings")
    drop_pinned(marked, star)
    links = pinned(links.unionAll(verified(cross)), "links")
    drop_pinned(cross)
    label = components(links.select("a", "b"))
    named = classes.join(
        label.select(F.col("node").alias("cls"), "component"), "cls", "left"
    ).withColumn("component", F.coalesce("component", "cls"))
    smallest = named.groupBy("component").agg(F.min("first_id").alias("component_id"))
    named = named.select("n", "f1", "f2", "n_copies", "component").join(smallest, "component")
    members = signed.select("id", "n", "f1", "f2").join(
        named.drop("component"), ["n", "f1", "f2"], "left"
    )
    members = members.select(
        F.col("id").alias("doc_id"),
        F.col("n").cast("bigint").alias("n_shingles"),
        F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id")).alias("component_id"),
        F.coalesce("n_copies", F.lit(1)).cast("bigint").alias("n_copies"),
    )
    one = classes.select(F.col("cls").alias("a"), F.col("first_id").alias("doc_a"))
    two = classes.select(F.col("cls").alias("b"), F.col("first_id").alias("doc_b"))
    shown = links.join(one, "a").join(two, "b").select("doc_a", "doc_b", "n_a", "n_b", "overlap")
    return JaccardJoin(members, shown)


def one_of_each_group(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The documents without all but one of each group of similar ones.

    The one with the smallest doc_id stays, the first row of it, one without id only if there is
    no other. Documents without words stay.
    """
    rows, row = numbered(docs, "grouped")
    members = ngram_jaccard_join(rows, width, percent, row, "text").members
    members = members.where("n_shingles > 0").select(
        F.col("doc_id").alias(row), F.col("component_id").alias("group")
    )
    members = pinned(rows.select(row, "doc_id").join(members, row), "members")
    order = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", row)
    kept = members.groupBy("group").agg(F.min(order).alias("kept"))
    lost = members.join(kept, "group").where(F.col(row) != F.col("kept")[row])
    return without(rows, lost, row).select(*docs.columns)
