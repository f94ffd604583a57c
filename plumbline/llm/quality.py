"""Quality rules: counts inside each document, and lines that too many documents of a host share.

Every document gets its counts (words, symbols, repeated lines, repeated word windows). Its
lines are normalised (A-Z lower-cased, white space collapsed) and hashed. For each host the
distinct documents that have a line are counted, documents with the same normalised lines once; a line on
more than ``share`` of the host's distinct documents, and on more than ``least`` of them, is
above the limit and removed. ``without_limited_lines`` gives the texts without such lines, and
the words that each lost are counted on what comes out. A document that loses more than half its
words to such lines is depleted and rejected; a short one that merely has such a line stays.

Counts per host and line are pre-aggregated, so a host with a third of all documents is only
as many counters as it has different lines. Texts are read again to be cut; only those that may
have a line above the limit meet the table of limited lines.

Defined cases: null text has no words and fails the base rule; a null host is a host of its
own; repeated rows count as one document and all get its verdict; lines without a word are
never counted nor removed; a null text stays null; a line goes with its line end, all others stay
as they are and in order; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm import kernels
from plumbline.llm.tables import KeyFilter, key_filter, pinned

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SHARE_PERCENT = 10
LEAST = 20
_SYMBOLS = np.isin(np.arange(256), np.frombuffer(b"#*$%&|<>", np.uint8))
_ORDER = np.uint64(0xD1342543DE82EF95)

_STATS = (
    "id bigint, host string, n_words bigint, word_chars bigint, n_symbols bigint, "
    "n_dup_lines bigint, n_repeat_words bigint, f1 bigint, f2 bigint, "
    "lines array<struct<line: bigint, words: bigint>>"
)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x, np.uint64).view(np.int64)


def _again(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal to an earlier value of its document, equal to any other one)."""
    order = np.lexsort((np.arange(len(doc)), value, doc))
    same = np.zeros(len(doc) + 1, bool)
    same[1:-1] = (doc[order][1:] == doc[order][:-1]) & (value[order][1:] == value[order][:-1])
    later, either = np.zeros(len(doc), bool), np.zeros(len(doc), bool)
    later[order] = same[:-1]
    either[order] = same[:-1] | same[1:]
    return later, either


def _per_text(values: np.ndarray, at: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of the values whose place lies in each text."""
    total = np.concatenate([[0], np.cumsum(values)])
    cuts = np.searchsorted(at, offsets)
    return total[cuts[1:]] - total[cuts[:-1]]


def normal_lines(chunk: kernels.Chunk) -> dict[str, np.ndarray]:
    """The lines of a chunk that hold a word: their text, place among its lines that are not
    empty, hash as they stand, hash of their words in lower case, and number of words."""
    data, offsets = chunk.data, chunk.offsets
    lines = kernels.split(data, offsets, kernels.LINES)
    line_doc = np.repeat(np.arange(len(chunk)), np.diff(lines.heads))
    word_line = np.searchsorted(lines.starts, chunk.starts, "right") - 1
    line_words = np.bincount(word_line, minlength=len(lines.starts))
    worded = line_words > 0

    low = kernels.split(data, offsets, kernels.SPACED).hashes
    head = np.r_[0, np.cumsum(line_words)]
    turn = np.arange(len(low)) - head[word_line]
    longest = int(turn.max()) + 1 if len(turn) else 1
    weight = np.cumprod(np.full(longest, _ORDER, np.uint64))
    mixed = low * weight[turn] if len(turn) else low
    keys = np.add.reduceat(mixed, head[:-1][worded]) if worded.any() else np.zeros(0, np.uint64)
    return {
        "line_doc": line_doc[worded],
        "line_place": (np.arange(len(line_doc)) - lines.heads[line_doc])[worded],
        "line_hash": lines.hashes[worded],
        "line": kernels.mix(keys),
        "line_words": line_words[worded],
    }


def measure(chunk: kernels.Chunk) -> dict[str, np.ndarray]:
    """Counts of each text of a chunk, whose words keep their case, and its normalised lines."""
    data, offsets = chunk.data, chunk.offsets
    n = len(chunk)
    n_words = np.diff(chunk.heads)
    begins = np.r_[0, np.cumsum((data & 0xC0) != 0x80)]
    chars = begins[chunk.ends] - begins[chunk.starts] if len(chunk.starts) else np.zeros(0, int)
    symbols = np.r_[0, np.cumsum(_SYMBOLS[data])]

    # Words in windows of three that come again.
    runs, at = kernels.shingles(chunk.hashes, chunk.heads, 3)
    run_doc = np.repeat(np.arange(n), np.diff(at))
    _, either = _again(run_doc, runs)
    either &= n_words[run_doc] >= 3
    cover = np.zeros(len(chunk.starts) + 3, np.int64)
    first = chunk.heads[run_doc] + np.arange(len(runs)) - at[run_doc]
    np.add.at(cover, first[either], 1)
    np.add.at(cover, first[either] + 3, -1)
    covered = np.cumsum(cover)[: len(chunk.starts)] > 0

    found = normal_lines(chunk)
    later, _ = _again(found["line_doc"], found["line_hash"])
    dup = np.bincount(found["line_doc"], later, minlength=n).astype(np.int64)
    return found | {
        "n_words": n_words,
        "word_chars": _per_text(chars, chunk.starts, offsets),
        "n_symbols": symbols[offsets[1:]] - symbols[offsets[:-1]],
        "n_dup_lines": dup,
        "n_repeat_words": np.bincount(
            np.repeat(np.arange(n), n_words), covered, minlength=n
        ).astype(np.int64),
    }


def _line_lists(found: dict[str, np.ndarray], n: int):
    """Distinct lines of each text with their words."""
    doc, line, words = found["line_doc"], found["line"], found["line_words"]
    order = np.lexsort((line, doc))
    doc_s, line_s = doc[order], line[order]
    fresh = np.r_[True, (doc_s[1:] != doc_s[:-1]) | (line_s[1:] != line_s[:-1])][: len(doc)]
    heads = np.flatnonzero(fresh)
    total = np.add.reduceat(words[order], heads) if len(heads) else np.zeros(0, np.int64)
    offsets = np.searchsorted(doc_s[heads], np.arange(n + 1))
    return line_s[heads], total, offsets


def _prints(found: dict[str, np.ndarray], n: int) -> list[np.ndarray]:
    """A fingerprint of all lines of each text, in order."""
    doc, line = found["line_doc"], found["line"]
    place = np.arange(len(doc)) - np.searchsorted(doc, doc)
    seed = np.uint64(2) * place.astype(np.uint64) + np.uint64(1)
    prints = []
    for salt in (np.uint64(0x1234567), np.uint64(0x89ABCDE)):
        own = kernels.mix(kernels.mix(line + salt) * seed)
        running = np.r_[np.uint64(0), np.cumsum(own, dtype=np.uint64)]
        cuts = np.searchsorted(doc, np.arange(n + 1))
        prints.append(running[cuts[1:]] - running[cuts[:-1]])
    return prints


def _rows(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    return docs.select(
        docs[id_col].cast("bigint").alias("id"),
        docs[host_col].cast("string").alias("host"),
        docs[text_col].cast("string").alias("text"),
    )


def _with_host(rows: DataFrame) -> DataFrame:
    """``own_host``, which is never null."""
    own = F.coalesce(F.concat(F.lit("="), "host"), F.lit(""))
    return rows.withColumn("own_host", own)


def statistics(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """One row per document: its counts, the fingerprint of its lines, and the lines."""
    rows = _rows(docs, id_col, text_col, host_col)
    entry = pa.struct([("line", pa.int64()), ("words", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in kernels.chunks(batch.column("text"), kernels.EXACT):
                found = measure(chunk)
                line, words, offsets = _line_lists(found, len(chunk))
                prints = _prints(found, len(chunk))
                lists = pa.ListArray.from_arrays(
                    pa.array(offsets, pa.int32()),
                    pa.StructArray.from_arrays(
                        [pa.array(_signed(line)), pa.array(words.astype(np.int64))],
                        fields=list(entry),
                    ),
                )
                names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
                columns = {
                    "id": batch.column("id").slice(chunk.first, len(chunk)),
                    "host": batch.column("host").slice(chunk.first, len(chunk)),
                }
                columns |= {name: pa.array(found[name].astype(np.int64)) for name in names}
                columns |= {"f1": pa.array(_signed(prints[0])), "f2": pa.array(_signed(prints[1]))}
                yield pa.RecordBatch.from_pydict(columns | {"lines": lists})

    return rows.mapInArrow(read, _STATS)


def limited_lines(stats: DataFrame, share_percent: int, least: int) -> DataFrame:
    """own_host, f1, f2 and the lines above the limit (``limited``, an array) of each distinct
    document that has any."""
    distinct = stats.groupBy("own_host", "f1", "f2").agg(F.any_value("lines").alias("lines"))
    distinct = pinned(distinct.withColumn("doc", F.monotonically_increasing_id()), "distinct")
    totals = distinct.groupBy("own_host").agg(F.count(F.lit(1)).alias("of"))
    entries = distinct.select("own_host", "doc", F.inline("lines"))
    shared = entries.groupBy("own_host", "line").agg(F.count(F.lit(1)).alias("on"))
    limits = shared.where(F.col("on") > least).join(totals, "own_host")
    limits = limits.where(F.col("on") * 100 > F.col("of") * share_percent)
    limits = limits.select("own_host", "line")
    # As many as the document has of its own.
    lost = entries.join(limits, ["own_host", "line"]).groupBy("doc").agg(
        F.collect_list("line").alias("limited")
    )
    own = distinct.select("own_host", "f1", "f2", "doc").join(lost, "doc").drop("doc")
    return pinned(own, "limited_lines")


def _printed(rows: DataFrame, own: KeyFilter, passing: bool) -> DataFrame:
    """The rows whose fingerprint passes the filter, with it, or all the others."""
    shared = rows.sparkSession.sparkContext.broadcast(own)  # MAX_BITS / 8 bytes at most

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in kernels.chunks(batch.column("text"), kernels.EXACT):
                one, two = (_signed(x) for x in _prints(normal_lines(chunk), len(chunk)))
                part = batch.slice(chunk.first, len(chunk))
                columns = {name: part.column(name) for name in ("id", "host", "text")}
                columns |= {"f1": pa.array(one), "f2": pa.array(two)}
                keep = pa.array(shared.value.passes(one) == passing)
                yield pa.RecordBatch.from_pydict(columns).filter(keep)

    kind = "id bigint, host string, text string, f1 bigint, f2 bigint"
    return _with_host(rows.mapInArrow(read, kind))


def _cut(rows: DataFrame, lost: DataFrame) -> DataFrame:
    """id, own_host, f1, f2, text without the limited lines, and the words that it lost."""
    kept = ("id", "own_host", "f1", "f2")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed = [], []
            for chunk in kernels.chunks(batch.column("text"), kernels.EXACT):
                found = normal_lines(chunk)
                cuts = np.searchsorted(found["line_doc"], np.arange(len(chunk) + 1))
                signed, n_words = _signed(found["line"]), np.diff(chunk.heads)
                for k in range(len(chunk)):
                    text = batch.column("text")[chunk.first + k].as_py()
                    limited = batch.column("limited")[chunk.first + k].as_py()
                    own = slice(cuts[k], cuts[k + 1])
                    gone = set(found["line_place"][own][np.isin(signed[own], limited or [])].tolist())
                    if gone:
                        text = _without(text, gone)
                    texts.append(text)
                    left = len(text.encode().split()) if gone else n_words[k]
                    removed.append(int(n_words[k] - left))
            columns = {name: batch.column(name) for name in kept}
            columns |= {"text": pa.array(texts, pa.string())}
            yield pa.RecordBatch.from_pydict(columns | {"removed_words": pa.array(removed, pa.int64())})

    joined = rows.join(lost, ["own_host", "f1", "f2"], "left").select(*kept, "text", "limited")
    kind = "id bigint, own_host string, f1 bigint, f2 bigint, text string, removed_words bigint"
    return joined.mapInArrow(read, kind)


def _without(text: str, gone: set[int]) -> str:
    """The text without some of its lines, counted among those that are not empty."""
    out, at = [], 0
    for line in text.split("\n"):
        if not line or at not in gone:
            out.append(line)
        at += line != ""
    return "\n".join(out)


def without_limited_lines(
    docs: DataFrame,
    share_percent: int = SHARE_PERCENT,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """doc_id, text without the lines above the limit, and removed_words, of every document."""
    stats = pinned(_with_host(statistics(docs, id_col, text_col, host_col)), "statistics")
    lost = limited_lines(stats, share_percent, least)
    own = key_filter(lost, "f1")
    rows = _rows(docs, id_col, text_col, host_col)
    near = _cut(_printed(rows, own, True), lost)
    others = _printed(rows, own, False).withColumn("removed_words", F.lit(0).cast("bigint"))
    columns = (F.col("id").alias("doc_id"), "text", "removed_words")
    return near.select(*columns).unionByName(others.select(*columns))


def quality_rules(
    docs: DataFrame,
    share_percent: int = SHARE_PERCENT,
    least: int = LEAST,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
) -> DataFrame:
    """Counts and verdict of each document: doc_id, n_words, word_chars, n_symbols,
    n_dup_lines, n_repeat_words, base_failed, removed_words, kept."""
    stats = pinned(_with_host(statistics(docs, id_col, text_col, host_col)), "statistics")
    lost = limited_lines(stats, share_percent, least)
    rows = _printed(_rows(docs, id_col, text_col, host_col), key_filter(lost, "f1"), True)
    # Documents with the same lines lose the same words.
    verdicts = _cut(rows, lost).where("removed_words > 0").groupBy("own_host", "f1", "f2")
    verdicts = verdicts.agg(F.max("removed_words").alias("removed_words"))
    joined = stats.drop("lines").join(verdicts, ["own_host", "f1", "f2"], "left")
    removed = F.coalesce("removed_words", F.lit(0)).cast("bigint")
    failed = (F.col("n_words") < MIN_WORDS) | (
        F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT
    )
    depleted = removed * 2 > F.col("n_words")
    return joined.select(
        F.col("id").alias("doc_id"),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        failed.alias("base_failed"),
        removed.alias("removed_words"),
        (~failed & ~depleted).alias("kept"),
    )


ORACLE = f"""
WITH parsed AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w
  FROM documents
),
raw_lines AS (
  SELECT r, generate_subscripts(string_split(text, chr(10)), 1) AS k,
    unnest(string_split(text, chr(10))) AS line
  FROM parsed
),
lines AS (
  SELECT r, k, line, len(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+')) AS words,
    translate(array_to_string(regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+'), ' '),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm
  FROM raw_lines
  WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
dups AS (
  SELECT r, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY r
),
windows AS (
  SELECT r, p, a || ' ' || b || ' ' || c AS t FROM (
    SELECT r, unnest(range(1, len(w) - 1)) AS p, unnest(w[1:len(w) - 2]) AS a,
      unnest(w[2:len(w) - 1]) AS b, unnest(w[3:]) AS c
    FROM parsed WHERE len(w) >= 3)
),
again AS (
  SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, t) AS n FROM windows) WHERE n > 1
),
repeats AS (
  SELECT r, count(DISTINCT q) AS n
  FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM again) GROUP BY r
),
prints AS (
  SELECT p.r, p.source, coalesce(string_agg(norm, chr(10) ORDER BY k), '') AS body
  FROM parsed p LEFT JOIN lines l ON p.r = l.r GROUP BY p.r, p.source
),
owners AS (SELECT min(r) AS r, source FROM prints GROUP BY source, body),
of_host AS (SELECT source, count(*) AS n FROM owners GROUP BY source),
common AS (
  SELECT o.source, l.norm
  FROM owners o JOIN (SELECT DISTINCT r, norm FROM lines) l ON o.r = l.r
  JOIN of_host h ON h.source IS NOT DISTINCT FROM o.source
  GROUP BY o.source, l.norm, h.n
  HAVING count(*) > {LEAST} AND count(*) * 100 > h.n * {SHARE_PERCENT}
),
removed AS (
  SELECT l.r, sum(l.words) AS n
  FROM lines l JOIN parsed p ON p.r = l.r
  JOIN common c ON c.source IS NOT DISTINCT FROM p.source AND c.norm = l.norm
  GROUP BY l.r
),
counted AS (
  SELECT p.r, p.doc_id, len(p.w) AS n_words,
    length(array_to_string(p.w, '')) AS word_chars,
    len(regexp_extract_all(p.text, '[#*$%&|<>]')) AS n_symbols,
    coalesce(d.n, 0) AS n_dup_lines, coalesce(t.n, 0) AS n_repeat_words,
    coalesce(m.n, 0) AS removed_words
  FROM parsed p LEFT JOIN dups d ON d.r = p.r LEFT JOIN repeats t ON t.r = p.r
  LEFT JOIN removed m ON m.r = p.r
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
  CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT}) AS base_failed,
  CAST(removed_words AS BIGINT) AS removed_words,
  NOT (n_words < {MIN_WORDS} OR n_repeat_words * 100 > n_words * {MAX_REPEAT_PERCENT})
    AND NOT removed_words * 2 > n_words AS kept
FROM counted
"""
