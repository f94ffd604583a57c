"""Toxicity by maximum-scoring segments of token log-odds.

A token is a word, or its first four, five or six bytes, in lower case. From a bounded sample
of labelled documents every token gets its log-odds between toxic and clean documents under an
informative Dirichlet prior (the counts of both together); tokens whose log-odds are many
standard errors above zero score that much, all others cost a fixed amount. A linear scan over
the scores of a document finds all its maximum-scoring segments. A segment's score is
calibrated by extreme-value statistics: the decay of chance scores follows from the token
frequencies of clean documents, and a score counts as far as it exceeds what a document of that
length reaches by chance. The excesses of all significant segments are added, and a logistic
curve fitted on the sample turns the sum into a probability.

Every document is read whole, and scores depend on its text alone. The sample holds MAX_TRAIN
documents at most, the model MAX_TOKENS tokens.

Defined cases: null and empty texts have no segments and get the lowest score; null ids are
scored like others and count as held out of nothing; a document labelled more than once is toxic if
any of its labels says so; null labels are not labels; without labels of both kinds no token is
known and every score is 0; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.llm import kernels
from plumbline.llm.tables import free_name, marked_rows, pinned, texts

MAX_TRAIN = 30_000
MAX_TOKENS = 20_000
#: Least z, score and toxic documents of a token; the part of the sample that is not used for
#: counting decides between them.
STRICTNESS = ((3.0, 1.0, 2), (3.5, 2.0, 3), (5.0, 2.5, 4))
MAX_SCORE = 6.0
COST = 0.5  # of a token without score
HEADS = (4, 5, 6)
PSEUDO_CLEAN = 20
FOLDS, HELD_OUT = 4, 2
LIMIT = 0.3
_FILTER = 1 << 20


@dataclass
class Model:
    tokens: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes
    scores: np.ndarray = field(default_factory=lambda: np.zeros(0))
    decay: float = 1.0  # of chance scores
    scale: float = 1.0  # chance segments per token
    slope: float = 0.0
    intercept: float = -math.inf
    filter: np.ndarray = field(default_factory=lambda: np.zeros(_FILTER, bool))

    def probability(self, excess: np.ndarray) -> np.ndarray:
        if self.intercept == -math.inf:
            return np.zeros(len(excess))
        logit = self.intercept + self.slope * np.log1p(excess)
        return 1.0 / (1.0 + np.exp(-np.clip(logit, -50, 50)))


def held_out(id_: Column) -> Column:
    """Documents whose labels are not learned from."""
    return F.coalesce(F.crc32(id_.cast("string").cast("binary")) % FOLDS == HELD_OUT, F.lit(False))


def word_tokens(chunk: kernels.Chunk) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(index of the words, token hash) for whole words and for the heads of longer ones."""
    yield np.arange(len(chunk.hashes)), chunk.hashes
    lengths = chunk.ends - chunk.starts
    for n in HEADS:
        at = np.flatnonzero(lengths > n)
        part = kernels.Chunk(0, chunk.data, chunk.offsets, chunk.starts[at], chunk.ends[at], at, at)
        yield at, kernels.head_hashes(part, kernels.ALNUM, n)


def token_counts(sample: DataFrame) -> DataFrame:
    """token, toxic, clean: how many of the sample's documents of each kind have a token."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy(zero_copy_only=False)
            for chunk in kernels.chunks(batch.column("text"), kernels.ALNUM):
                own = label[chunk.first : chunk.first + len(chunk)]
                owner = np.repeat(np.arange(len(chunk)), np.diff(chunk.heads))
                found = list(word_tokens(chunk))
                token = np.concatenate([h for _, h in found])
                doc = np.concatenate([owner[at] for at, _ in found])
                order = np.lexsort((doc, token))
                token, doc = token[order], doc[order]
                fresh = np.ones(len(token), bool)  # once per document
                fresh[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
                token, place = np.unique(token[fresh], return_inverse=True)
                toxic = np.bincount(place, own[doc[fresh]], len(token))
                total = np.bincount(place, minlength=len(token))
                yield pa.RecordBatch.from_pydict(
                    {
                        "token": pa.array(token.view(np.int64)),
                        "toxic": pa.array(toxic.astype(np.int64)),
                        "clean": pa.array((total - toxic).astype(np.int64)),
                    }
                )

    counts = sample.select("text", "toxic").mapInArrow(
        count, "token bigint, toxic bigint, clean bigint"
    )
    return counts.groupBy("token").agg(
        F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")
    )


def log_odds(counts: DataFrame) -> DataFrame:
    """token, score, z, toxic, clean of the tokens that speak for toxic documents."""
    total = counts.agg(F.sum("toxic").alias("t"), F.sum("clean").alias("c")).first()
    n_t, n_c = float(total["t"] or 0), float(total["c"] or 0)
    if not n_t or not n_c:
        return counts.where("false").select(
            "token", F.lit(0.0).alias("score"), F.lit(0.0).alias("z"), "toxic", "clean"
        )
    # The prior weighs as much as the toxic side itself.
    weight = n_t
    prior = (F.col("toxic") + F.col("clean")) * (weight / (n_t + n_c))
    in_t, in_c = F.col("toxic") + prior, F.col("clean") + prior
    score = F.log(in_t / (n_t + weight - in_t)) - F.log(in_c / (n_c + weight - in_c))
    least_z, least_score, least_docs = (min(part) for part in zip(*STRICTNESS))
    scored = counts.where(F.col("toxic") >= least_docs).select(
        "token", score.alias("score"), (score / F.sqrt(1 / in_t + 1 / in_c)).alias("z"), "toxic", "clean"
    )
    return scored.where((F.col("z") >= least_z) & (F.col("score") >= least_score))


def _decay(values: np.ndarray, chances: np.ndarray) -> float:
    """The positive solution x of sum(chance * exp(x * value)) = 1."""
    low, high = 1e-3, 50.0
    for _ in range(60):
        x = (low + high) / 2
        if float((chances * np.exp(np.minimum(x * values, 700))).sum()) > 1:
            high = x
        else:
            low = x
    return (low + high) / 2


def word_scores(chunk: kernels.Chunk, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """(words that score, their scores): the best of a word's tokens."""
    best = np.zeros(len(chunk.hashes))
    for at, hashes in word_tokens(chunk):
        maybe = np.flatnonzero(model.filter[(hashes & np.uint64(_FILTER - 1)).astype(np.int64)])
        if len(maybe) == 0 or len(model.tokens) == 0:
            continue
        place = np.searchsorted(model.tokens, hashes[maybe])
        place = np.minimum(place, len(model.tokens) - 1)
        hit = model.tokens[place] == hashes[maybe]
        np.maximum.at(best, at[maybe[hit]], model.scores[place[hit]])
    words = np.flatnonzero(best > 0)
    return words, best[words]


def segments(places: list[int], scores: list[float], cost: float) -> list[tuple[int, int, float]]:
    """All maximum-scoring segments (first place, last place, score), in one pass.

    ``places`` of positive scores in order; every place between them costs ``cost``.
    """
    found: list[tuple[int, int, float, float]] = []  # first, last, total before, total after
    total, last = 0.0, None
    for place, score in zip(places, scores):
        if last is not None:
            total -= cost * (place - last - 1)
        first, left = place, total
        total += score
        right = total
        # Join with earlier segments while the last one that starts lower also ends lower.
        while True:
            k = len(found) - 1
            while k >= 0 and found[k][2] >= left:
                k -= 1
            if k < 0 or found[k][3] >= right:
                break
            first, left = found[k][0], found[k][2]
            del found[k:]
        found.append((first, place, left, right))
        last = place
    return [(a, b, right - left) for a, b, left, right in found]


def excesses(found: list[tuple[int, int, float]], n: int, model: Model) -> list[float]:
    """How far, in units of chance decay, each segment exceeds a text of ``n`` words' chance."""
    chance = math.log(max(model.scale * n, 1e-9))
    return [max(0.0, model.decay * score - max(chance, 0.0)) for _, _, score in found]


def score_texts(column: pa.Array, model: Model):
    """Per text (sum of excesses, its significant passages (start, end, excess) in bytes)."""
    for chunk in kernels.chunks(column, kernels.ALNUM):
        words, scores = word_scores(chunk, model)
        cuts = np.searchsorted(words, chunk.heads)
        for k in range(len(chunk)):
            a, b = cuts[k], cuts[k + 1]
            if a == b:
                yield 0.0, []
                continue
            n = int(chunk.heads[k + 1] - chunk.heads[k])
            found = segments(words[a:b].tolist(), scores[a:b].tolist(), COST)
            excess = excesses(found, n, model)
            at = chunk.offsets[k]
            shown = [
                (int(chunk.starts[f[0]] - at), int(chunk.ends[f[1]] - at), x)
                for f, x in zip(found, excess)
                if x > 0
            ]
            yield sum(excess), shown


def _logistic(excess: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(slope, intercept) over the logarithm of the excess, by Newton steps with some ridge."""
    design = np.column_stack([np.ones(len(excess)), np.log1p(excess)])
    weights = np.zeros(2)
    ridge = np.diag([1e-3, 1e-2])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (y - p) - ridge @ weights
        hessian = (design * (p * (1 - p))[:, None]).T @ design + ridge
        step = np.clip(np.linalg.solve(hessian, gradient), -1, 1)
        weights += step
        if np.abs(step).max() < 1e-6:
            break
    return float(max(weights[1], 0.0)), float(weights[0])


def sample_of(rows: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """text, toxic of at most about ``most`` labelled documents outside the held-out fold."""
    known = labels.select(
        labels["doc_id"].cast("bigint").alias("id"), labels["toxic"].cast("int").alias("toxic")
    ).where(F.col("toxic").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id")))
    known = known.groupBy("id").agg(F.max("toxic").alias("toxic"))
    share = min(1.0, most / max(known.count(), 1))
    if share < 1:
        place = F.pmod(F.xxhash64("id", F.lit(17)), F.lit(1_000_000))
        known = known.where(place < int(share * 1_000_000))
    own = marked_rows(rows, known, "id").join(known, "id").select("text", "toxic")
    return own.groupBy("text").agg(F.max("toxic").alias("toxic"))  # copies teach nothing new


def train(rows: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> Model:
    """Fits the model on labelled documents (rows: id, text; labels: doc_id, toxic)."""
    sample = pinned(sample_of(rows, labels, most), "toxic_sample")
    # Tokens are weighed on three quarters, the curve is fitted on the rest.
    part = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(4))
    counts = pinned(token_counts(sample.where(part > 0)), "token_counts")
    best = log_odds(counts).orderBy(F.desc("z"), "token").limit(MAX_TOKENS).toPandas()
    words = float(counts.agg(F.sum("clean")).first()[0] or 0)
    models = [
        _fit(best[(best.z >= z) & (best.score >= least) & (best.toxic >= n)], words)
        for z, least, n in STRICTNESS
    ]
    measured = sample.where(part == 0).mapInArrow(
        _measure(models), "excess array<double>, toxic int"
    )
    measured = measured.collect()  # a quarter of the sample
    # Documents without any passage are taken to be clean until a sample says otherwise.
    x = np.array([r["excess"] for r in measured] + [[0.0] * len(models)] * PSEUDO_CLEAN, float)
    y = np.array([r["toxic"] for r in measured] + [0] * PSEUDO_CLEAN, float)
    if not y.any():
        return Model()
    losses = []
    for k, model in enumerate(models):
        model.slope, model.intercept = _logistic(x[:, k], y)
        chance = np.clip(model.probability(x[:, k]), 1e-6, 1 - 1e-6)
        losses.append(-(y * np.log(chance) + (1 - y) * np.log(1 - chance)).mean())
    return models[int(np.argmin(losses))]


def _fit(best: pd.DataFrame, words: float) -> Model:
    """The model of the given tokens; its curve is still to be fitted."""
    if len(best) == 0:
        return Model(intercept=0.0)
    tokens = best["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    scores = np.clip(best["score"].to_numpy(), COST, MAX_SCORE)
    model = Model(tokens[order], scores[order])
    model.filter[(tokens & np.uint64(_FILTER - 1)).astype(np.int64)] = True
    # Chance scores: how often each score comes in clean documents, half a time more for each.
    clean = best["clean"].to_numpy(float)[order] + 0.5
    chances = np.append(clean, max(words - clean.sum(), 1.0)) / max(words, 1.0)
    values = np.append(model.scores, -COST)
    model.decay = min(_decay(values, chances / chances.sum()), 5.0)
    model.scale = float(chances[:-1].sum())
    return model


def _measure(models: list[Model]):
    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                [excess for excess, _ in score_texts(batch.column("text"), model)]
                for model in models
            ]
            yield pa.RecordBatch.from_pydict(
                {
                    "excess": pa.array(list(map(list, zip(*found))), pa.list_(pa.float64())),
                    "toxic": batch.column("toxic"),
                }
            )

    return measure


def scored(
    rows: DataFrame, model: Model, text_col: str, score_col: str, passages_col: str
) -> DataFrame:
    """The rows with two columns more; scored where they lie, without a join."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # MAX_TOKENS tokens at most
    passage = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("excess", pa.float64())])
    added = T.StructType.fromDDL(
        f"{score_col} double, {passages_col} array<struct<start: bigint, end: bigint, excess: double>>"
    )
    schema = T.StructType([*rows.schema.fields, *added.fields])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            text = batch.column(batch.schema.get_field_index(text_col))
            found = list(score_texts(text, own))
            shown = [
                [{"start": a, "end": b, "excess": x} for a, b, x in spans] for _, spans in found
            ]
            chance = own.probability(np.array([x for x, _ in found], float))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(chance), pa.array(shown, pa.list_(passage))],
                [*batch.schema.names, score_col, passages_col],
            )

    return rows.mapInArrow(score, schema)


def toxicity(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, score, predicted, n_passages, passages (start, end, excess; in bytes)."""
    rows = texts(docs, id_col, text_col)
    return scored(rows, train(rows, labels), "text", "_score", "_passages").select(
        F.col("id").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= LIMIT).cast("int").alias("predicted"),
        F.size("_passages").cast("bigint").alias("n_passages"),
        F.col("_passages").alias("passages"),
    )


def clean_documents(docs: DataFrame, labels: DataFrame, limit: float = LIMIT) -> DataFrame:
    """The documents whose score is below ``limit``."""
    model = train(texts(docs, "doc_id", "text"), labels)
    score, passages = free_name(docs, "_score"), free_name(docs, "_passages")
    rows = scored(docs, model, "text", score, passages)
    return rows.where(F.col(score) < limit).select(*docs.columns)
