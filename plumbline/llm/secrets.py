"""Secret scans: fixed formats, and character Markov models for what has no format.

Three fixed kinds are matched by pattern. Every other long run of key characters is scored by
two first-order Markov models over characters, one of random strings and one of ordinary words
and identifiers; a run whose log-likelihood ratio per step exceeds a threshold is a span of
kind ``markov``. The models are trained from samples the corpus labels itself: the values of
the fixed kinds are random strings, and the runs of key characters of all texts are ordinary,
apart from the fixed kinds and from candidates. Candidates are what is to be judged, and keys
among them would teach the model that keys are ordinary; so a first model without any of them
judges them, and those it does not flag are counted as well before the decision. Counts are kept
in one table of fixed size per model, over all texts. The labelled random strings are few and of
few formats, so their model is mixed with even use of all key characters. The ordinary model
gives a fixed share of each row to steps it has not seen, so a verdict follows the shares of
the steps and not the size of the input.

Texts are read once for the fixed kinds and the candidate runs and once for the step counts;
both decisions work on the small table of candidates alone.

Defined cases: null text is empty; null and repeated ids are rows of their own; without any
labelled random string the smoothed model alone decides; equal starts are listed in the order
of the kinds; an empty table gives no rows; further columns are kept out of the result; texts
of any length are scanned whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernels
from plumbline.llm.tables import (
    filtered,
    folded,
    free_name,
    key_filter,
    numbered,
    pinned,
    texts,
)

KINDS = ("assign", "access", "hex", "markov")
MIN_RUN = 16
THRESHOLD = 0.4  # nats a step
SMOOTHING = 2.0
EVEN = 0.25  # share of even use in the model of random strings
UNSEEN = 0.05  # share of each row of the ordinary model that follows the characters' own shares
UNSEEN_EVEN = 0.15  # share of even use in those

# The formats, and the shortest length that counts.
_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.IGNORECASE | re.ASCII,
)
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_SHORTEST = {"assign": 12, "access": 18, "hex": 16}

_RUN = re.compile(r"(?<![^\W_])[A-Za-z0-9+/_=-]{%d,}(?![^\W_])" % MIN_RUN)
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SYMBOLS = len(_LETTERS)
_PLACE = np.full(256, SYMBOLS, np.int64)
_PLACE[np.frombuffer(_LETTERS.encode(), np.uint8)] = np.arange(SYMBOLS)
_RUN_CODES = kernels.byte_codes(bytes(b for b in range(256) if chr(b) not in _LETTERS))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed kinds, by start and then kind."""
    found = []
    low = text.lower()
    if any(word in low for word in _KEYWORDS):
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= _SHORTEST["assign"]:
                found.append((m.start(), 0, m.end()))
    if "AKIA" in text:
        for m in _ACCESS.finditer(text):
            if m.end() - m.start() >= _SHORTEST["access"]:
                found.append((m.start(), 1, m.end()))
    for m in _HEX.finditer(text):
        if m.end() - m.start() >= _SHORTEST["hex"]:
            found.append((m.start(), 2, m.end()))
    return sorted(found)


def values_of(text: str, spans: list[tuple[int, int, int]]) -> list[str]:
    """The random strings inside the spans."""
    out = []
    for start, kind, end in spans:
        own = text[start:end]
        out.append(_ASSIGN.match(own)[2] if kind == 0 else own)
    return out


def candidate_runs(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Long runs of key characters with two kinds of characters, apart from the spans."""
    out = []
    for m in _RUN.finditer(text):
        own = m.group()
        kinds = any(c.isdigit() for c in own) + any(c.islower() for c in own)
        kinds += any(c.isupper() for c in own[1:])
        if kinds > 1 and not any(a < m.end() and m.start() < b for a, _, b in spans):
            out.append((m.start(), m.end()))
    return out


def regions(text: str, spans: list[tuple[int, int]]) -> list[str]:
    """The parts of a text that the spans cover, with the characters beside them: all steps that
    begin or end in a span, each once."""
    out, at, to = [], 0, -1
    for start, end in [*sorted(spans), (len(text) + 2, 0)]:
        if start > to:
            if to >= 0:
                out.append(text[max(at - 1, 0) : to + 1])
            at, to = start, end
        else:
            to = max(to, end)
    return out


def _steps(runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(run, index of its two characters in a table) of every step inside the runs."""
    blob = np.frombuffer("\n".join(runs).encode("ascii", "replace"), np.uint8)
    if len(blob) < 2:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = _PLACE[blob]
    one, two = place[:-1], place[1:]
    inside = (one < SYMBOLS) & (two < SYMBOLS)
    run = np.cumsum(blob == 10)[:-1]
    return run[inside], (one * SYMBOLS + two)[inside]


def ordinary_counts(rows: DataFrame) -> np.ndarray:
    """Steps between two key characters, over all texts."""
    size = SYMBOLS * SYMBOLS

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for batch in batches:
            blob, offsets = kernels.string_buffers(batch.column("text"))
            for a, b in kernels.spans_of(offsets):
                place = _PLACE[blob[offsets[a] : offsets[b]]]
                inside = (place[:-1] < SYMBOLS) & (place[1:] < SYMBOLS)
                ends = offsets[a + 1 : b] - offsets[a] - 1
                inside[ends[(ends >= 0) & (ends < len(inside))]] = False  # texts end there
                pairs = (place[:-1] * SYMBOLS + place[1:])[inside]
                total += np.bincount(pairs, minlength=size)
        return total

    return folded(rows.select("text"), fill, size, np.int64, np.add)


def string_counts(found: DataFrame, column: str) -> np.ndarray:
    """Steps inside the strings of a column of lists: the labelled random strings (``values``),
    or what is apart from ordinary runs (``apart``)."""
    size = SYMBOLS * SYMBOLS

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for batch in batches:
            runs = [v for own in batch.column(column).to_pylist() for v in own or []]
            total += np.bincount(_steps(runs)[1], minlength=size)
        return total

    return folded(found.select(column), fill, size, np.int64, np.add)


def cleared_counts(found: DataFrame, ratios: np.ndarray, threshold: float) -> np.ndarray:
    """Steps inside the candidates (``runs``) that the ratios do not flag."""
    size = SYMBOLS * SYMBOLS
    shared = found.sparkSession.sparkContext.broadcast(ratios)  # one number per character pair

    def fill(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(size, np.int64)
        for batch in batches:
            runs = [r["text"] for own in batch.column("runs").to_pylist() for r in own or []]
            run, pairs = _steps(runs)
            clear = ~flagged(run, pairs, shared.value, len(runs), threshold)
            total += np.bincount(pairs[clear[run]], minlength=size)
        return total

    return folded(found.select("runs"), fill, size, np.int64, np.add)


def flagged(
    run: np.ndarray, pairs: np.ndarray, ratios: np.ndarray, n: int, threshold: float
) -> np.ndarray:
    """Which of ``n`` runs with these steps have more than the threshold a step."""
    total = np.bincount(run, ratios[pairs], minlength=n)
    steps = np.bincount(run, minlength=n)
    return (steps > 0) & (total > threshold * steps)


def log_ratios(random: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
    """Log of P(next | this, random) / P(next | this, ordinary) for each pair of characters."""
    table = random.reshape(SYMBOLS, SYMBOLS).astype(float)
    # Few samples: lean on how often each character comes, and that on even use.
    overall = (table.sum(axis=0) + 1) / (table.sum() + SYMBOLS)
    own = table + SMOOTHING * SYMBOLS * overall
    # Secrets of formats that the samples lack use the whole alphabet evenly.
    mixed = (1 - EVEN) * own / own.sum(axis=1, keepdims=True) + EVEN / SYMBOLS

    # Shares alone, no counts: the same steps a hundred times as often give the same ratios.
    table = ordinary.reshape(SYMBOLS, SYMBOLS).astype(float)
    even = np.full(SYMBOLS, 1 / SYMBOLS)
    overall = table.sum(axis=0) / table.sum() if table.any() else even
    overall = (1 - UNSEEN_EVEN) * overall + UNSEEN_EVEN * even
    sums = table.sum(axis=1, keepdims=True)
    seen = np.where(sums > 0, table / np.maximum(sums, 1), overall)
    return np.log(mixed / ((1 - UNSEEN) * seen + UNSEEN * overall)).ravel()


def models(rows: DataFrame, found: DataFrame, threshold: float) -> np.ndarray:
    """The log ratios for the texts ``rows`` and what was found in them."""
    random = string_counts(found, "values")
    ordinary = ordinary_counts(rows) - string_counts(found, "apart")
    first = log_ratios(random, ordinary)
    return log_ratios(random, ordinary + cleared_counts(found, first, threshold))


def scan(rows: DataFrame) -> DataFrame:
    """id, base (spans), values, runs (candidates) and their texts, and the parts apart from
    ordinary runs, per row."""
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    run = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())])
    schema = pa.schema(
        [
            ("id", pa.int64()),
            ("base", pa.list_(span)),
            ("values", pa.list_(pa.string())),
            ("runs", pa.list_(run)),
            ("apart", pa.list_(pa.string())),
        ]
    )

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            n = batch.num_rows
            base: list[list] = [[]] * n
            values: list[list] = [[]] * n
            runs: list[list] = [[]] * n
            apart: list[list] = [[]] * n
            # A key character run as long as any kind needs; values of 12 follow a keyword.
            for chunk in kernels.chunks(column, _RUN_CODES):
                long = np.flatnonzero(chunk.ends - chunk.starts >= MIN_RUN)
                has = np.zeros(len(chunk), bool)
                has[np.searchsorted(chunk.offsets, chunk.starts[long], "right") - 1] = True
                for k in range(len(chunk)):
                    at = chunk.first + k
                    text = column[at].as_py()
                    if not has[k]:
                        low = text.lower()
                        if not any(word in low for word in _KEYWORDS):
                            continue
                    own = base_spans(text)
                    base[at] = [{"start": a, "kind": kind, "end": b} for a, kind, b in own]
                    values[at] = values_of(text, own)
                    tried = candidate_runs(text, own)
                    runs[at] = [{"start": a, "end": b, "text": text[a:b]} for a, b in tried]
                    apart[at] = regions(text, tried + [(a, b) for a, _, b in own])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("id"),
                    pa.array(base, schema.field("base").type),
                    pa.array(values, schema.field("values").type),
                    pa.array(runs, schema.field("runs").type),
                    pa.array(apart, schema.field("apart").type),
                ],
                schema=schema,
            )

    kind = (
        "id bigint, base array<struct<start: bigint, kind: int, end: bigint>>, "
        "values array<string>, runs array<struct<start: bigint, end: bigint, text: string>>, "
        "apart array<string>"
    )
    return rows.mapInArrow(look, kind)


def secret_spans(
    docs: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """doc_id and its spans, an array of (start, kind, end) in code points, by start and kind.

    ``kind`` counts through KINDS.
    """
    rows = texts(docs, id_col, text_col)
    found = pinned(scan(rows), "scanned")
    ratios = models(rows, found, threshold)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)  # one number per character pair
    span = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span))])
    markov = KINDS.index("markov")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            runs = batch.column("runs").to_pylist()
            flat = [(k, r["start"], r["end"], r["text"]) for k, own in enumerate(runs) for r in own]
            run, pairs = _steps([r[3] for r in flat])
            over = flagged(run, pairs, table, len(flat), threshold)
            spans = [[(s["start"], s["kind"], s["end"]) for s in own] for own in batch.column("base").to_pylist()]
            for (k, start, end, _), secret in zip(flat, over):
                if secret:
                    spans[k].append((start, markov, end))
            shown = [
                [{"start": a, "kind": kind, "end": b} for a, kind, b in sorted(own)] for own in spans
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(shown, schema.field("spans").type)], schema=schema
            )

    kind = "doc_id bigint, spans array<struct<start: bigint, kind: int, end: bigint>>"
    return found.select("id", "base", "runs").mapInArrow(decide, kind)


def redact(docs: DataFrame, mask: str = "[SECRET]", threshold: float = THRESHOLD) -> DataFrame:
    """The documents with every secret replaced by ``mask``, and n_chars to match.

    Rows are matched to their spans by a number given to each row, so repeated ids are safe.
    """
    rows, row = numbered(docs, "redact")
    found, masked = free_name(rows, "_spans"), free_name(rows, "_mask")
    spans = secret_spans(rows, threshold, row, "text")
    spans = pinned(
        spans.where(F.size("spans") > 0).select(
            F.col("doc_id").alias(row), F.col("spans").alias(found)
        ),
        "secret_spans",
    )
    own = key_filter(spans.select(row), row)
    joined = filtered(rows, row, own).join(spans, row, "left")
    # Spans may overlap: cut the text at each start that lies beyond all earlier ends.
    cut = F.expr(
        f"""aggregate({found}, struct('' AS done, cast(0 AS bigint) AS at),
             (s, x) -> struct(
               concat(s.done,
                 if(x.start >= s.at,
                    concat(substring(text, cast(s.at + 1 AS int), cast(x.start - s.at AS int)), {masked}),
                    '')) AS done,
               greatest(s.at, x.end) AS at),
             s -> concat(s.done, substring(text, cast(s.at + 1 AS int))))"""
    )
    joined = joined.withColumn(masked, F.lit(mask))
    has = F.col(found).isNotNull()
    joined = joined.withColumn("text", F.when(has, cut).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        size = F.length("text").cast(docs.schema["n_chars"].dataType)
        joined = joined.withColumn("n_chars", F.when(has, size).otherwise(F.col("n_chars")))
    others = filtered(rows, row, own, passing=False)
    return joined.select(*docs.columns).unionByName(others.select(*docs.columns))


def digest(spans: DataFrame) -> DataFrame:
    """Counts per fixed kind, and the spans as text."""

    def shown(array: str) -> Column:
        names = F.array(*[F.lit(k) for k in KINDS])
        return F.concat_ws(
            ",",
            F.transform(
                F.col(array),
                lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"]),
            ),
        )

    def n(kind: str) -> Column:
        own = F.filter("spans", lambda s: s["kind"] == KINDS.index(kind))
        return F.size(own).cast("bigint").alias(f"n_{kind}")

    base = spans.withColumn("_base", F.filter("spans", lambda s: s["kind"] < 3))
    return base.select(
        "doc_id",
        *[n(kind) for kind in KINDS],
        F.sha2(shown("_base"), 256).alias("base_sha256"),
        shown("spans").alias("spans"),
    )
