"""Messages classified by a table of patterns of any size, the first one that fits deciding.

A pattern fits a message that contains it, whatever the case. Every pattern is filed under one of
its own pieces, the one that the fewest patterns have: a piece of 4 characters, or of
one of the greater lengths in GRAMS where the rarest shorter one is that of more than SHARED
patterns (under itself if it is shorter).
A message is looked up by all its pieces of these lengths, and only patterns met this way are
compared with it. So no message meets all patterns, the patterns met do not grow with their number
where longer pieces tell them apart, and no expression grows with their number.

Equal messages are looked up once. The index is broadcast only up to a counted size; the lengths
of pieces beyond it meet messages by a shuffle on the pieces. Only those go there that begin like
some piece of the index, where the beginnings are few enough to be broadcast, and whose bit is
marked in a broadcast table of bits of bounded size.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import shared_folder

GRAM = 4
GRAMS = (GRAM, 6, 8, 12, 16, 24, 32)
SHARED = 4
BROADCAST_PATTERNS = 200_000
BROADCAST_HEADS = 200_000
WORDS = 1 << 18  # of 64 bits, in the table of pieces


def _pieces(chars: Column, length: int) -> Column:
    """All runs of ``length`` characters, given the characters."""
    starts = F.sequence(F.lit(0), F.size(chars) - length)
    runs = F.transform(starts, lambda i: F.concat(F.lit(""), *[F.get(chars, i + k) for k in range(length)]))
    none = F.array().cast("array<string>")
    return F.when(F.size(chars) >= length, runs).otherwise(none)


def _chars(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))


def pattern_index(patterns: DataFrame, grams: tuple[int, ...] = GRAMS) -> DataFrame:
    """``gram``, ``needle``, ``priority``, ``kind``: each different pattern under its rarest piece of
    the least length at which at most SHARED patterns have it, or else of the greatest."""
    shared_folder(patterns.sparkSession)
    needles = (
        patterns.where(F.col("pattern").isNotNull())
        .groupBy(F.lower("pattern").alias("needle"))
        .agg(F.min(F.struct("priority", "kind")).alias("rule"))
        .select("needle", "rule.*", _chars(F.col("needle")).alias("chars"))
    ).checkpoint()
    open_, filed = needles, []
    for at, length in enumerate(grams):
        pieces = F.when(F.size("chars") <= length, F.array("needle")).otherwise(
            F.array_distinct(_pieces(F.col("chars"), length))
        )
        own = open_.select("needle", "priority", "kind", F.explode(pieces).alias("gram"))
        shared = own.groupBy("gram").agg(F.count(F.lit(1)).alias("n"))
        best = F.min(F.struct("n", "gram", "priority", "kind")).alias("first")
        chosen = own.join(shared, "gram").groupBy("needle").agg(best).checkpoint()
        # A longer piece may be rarer, if the pattern has one.
        following = grams[at + 1] if at + 1 < len(grams) else 1 << 31
        longer = (F.col("first.n") > SHARED) & (F.length("needle") >= following)
        filed.append(chosen.where(~longer))
        if not chosen.where(longer).limit(1).count():
            break
        open_ = needles.join(chosen.where(longer).select("needle"), "needle")
    rows = reduce(DataFrame.unionByName, filed)
    return rows.select("first.gram", "needle", "first.priority", "first.kind").checkpoint()


def _grams(spelt: DataFrame, lengths: list[int]) -> DataFrame:
    """The different pieces of these lengths of every text."""
    looked_up = F.array().cast("array<string>")
    for length in lengths:
        looked_up = F.concat(looked_up, _pieces(F.col("chars"), length) if length else F.array(F.lit("")))
    return spelt.select("text", F.explode(F.array_distinct(looked_up)).alias("gram"))


def _likely(grams: DataFrame, index: DataFrame) -> DataFrame:
    """Without most of the pieces that are not in the index."""
    head = F.substring("gram", 1, GRAM)
    heads = index.select(head.alias("head")).distinct().checkpoint()
    if heads.count() <= BROADCAST_HEADS:
        grams = grams.join(F.broadcast(heads), head == heads["head"], "left_semi")
    hashed = F.xxhash64("gram")
    word = F.pmod(hashed, F.lit(WORDS)).alias("word")
    bit = F.expr("shiftleft(1L, CAST(shiftrightunsigned(xxhash64(gram), 58) AS INT))")
    words = index.groupBy(word).agg(F.bit_or(bit).alias("bits"))
    marked = (word == words["word"]) & (words["bits"].bitwiseAND(bit) != 0)
    return grams.join(F.broadcast(words), marked, "left_semi")


def _met(spelt: DataFrame, index: DataFrame, broadcast_patterns: int) -> DataFrame:
    """Texts with the patterns of the index that share a piece with them."""
    length = F.length("gram")
    near, far, total = [], [], 0
    for n, size in index.groupBy(length).count().orderBy("count").collect():  # few: see GRAMS
        total += size
        (near if total <= broadcast_patterns else far).append(n)
    met = _grams(spelt, near).join(F.broadcast(index.where(length.isin(near))), "gram")
    if far:
        rare = index.where(length.isin(far))
        met = met.unionByName(_likely(_grams(spelt, far), rare).join(rare, "gram"))
    return met


def first_matches(
    messages: DataFrame, text: Column, patterns: DataFrame, broadcast_patterns: int = BROADCAST_PATTERNS
) -> DataFrame:
    """``text`` (in lower case), ``priority``, ``kind``: the first pattern of each different
    message that has one. Ties on priority go to the smaller pattern."""
    different = messages.select(F.lower(text).alias("text")).where("text IS NOT NULL").distinct()
    spelt = different.select("text", _chars(F.col("text")).alias("chars"))
    met = _met(spelt, pattern_index(patterns), broadcast_patterns)
    fitting = met.where(F.contains("text", "needle"))
    best = fitting.groupBy("text").agg(F.min(F.struct("priority", "needle", "kind")).alias("best"))
    return best.select("text", "best.priority", "best.kind")


def classify(
    rows: DataFrame,
    message: str,
    patterns: DataFrame,
    default: str,
    name: str = "kind",
    broadcast_patterns: int = BROADCAST_PATTERNS,
) -> DataFrame:
    """The rows with ``name``: the kind of the first pattern their ``message`` contains.

    ``patterns``: priority, pattern, kind. Rows whose message is NULL or fits nothing get
    ``default``; the empty pattern fits every message, a NULL pattern none; repeated rows stay.
    """
    found = first_matches(rows, F.col(message), patterns, broadcast_patterns)
    whole = rows.select(F.struct(*rows.columns).alias("row"), F.lower(message).alias("own"))
    joined = whole.join(found, F.col("own") == F.col("text"), "left")
    return joined.select("row.*", F.coalesce("kind", F.lit(default)).alias(name))
