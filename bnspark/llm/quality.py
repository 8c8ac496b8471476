"""Document quality from positive and unlabelled texts.

A linear model on statistics and hashed words of the whole text is fitted to the non-negative unbiased risk

    prior * R_P(+1) + max(0, R_U(-1) - prior * R_P(-1))

with the logistic loss: R_P are means over texts trusted to be good, R_U over unlabelled texts.  Nothing is learnt
from rows labelled bad.  The class prior is estimated from the same two sets: a first model tells trusted from
unlabelled texts on one half of both; on the other half the share of unlabelled texts above a score, over the share
of trusted ones, bounds the prior, and the bound that is surest to be low is taken (best bin estimation).

What is fitted on is bounded: at most SAMPLE trusted and SAMPLE unlabelled documents, those with the smallest
hashes of their ids.  Each document is then scored where it lies.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bnspark.llm.line_dedup import token_hashes

SAMPLE = 8_000  # most positives, and most unlabelled texts, that are fitted on
STEPS, RATE, RIDGE = 500, 0.02, 5e-3
FIRST_STEPS, LEAST_BIN = 150, 30  # of the first model; trusted texts that a bin for the prior has
THRESHOLD = 0.3
FOLDS = 5
SHAPES = 14
WORDS = 512  # buckets of hashed words, a power of two
WIDTH = 256 + SHAPES + WORDS


def features(text: str | None) -> np.ndarray:
    """Logarithms of the frequencies of bytes and of hashed words, and shapes of words and lines, of the whole
    text."""
    out = np.zeros(WIDTH, np.float32)
    data = (text or "").encode("utf-8", "replace")
    if not data:
        return out
    n = len(data)
    counts = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    out[:256] = np.log1p(counts * (1000.0 / n)) / 4
    words = data.split()
    w = max(len(words), 1)
    distinct = len(set(words))
    again = sum(map(bytes.__eq__, words, words[1:]))
    lines = data.split(b"\n")
    upper, lower = counts[65:91].sum(), counts[97:123].sum()
    digits, high = counts[48:58].sum(), counts[128:].sum()
    marks = n - upper - lower - digits - high - counts[:33].sum()
    hashes = token_hashes(data)[0]
    out[256 + SHAPES :] = np.log1p(np.bincount((hashes >> np.uint64(32)) & np.uint64(WORDS - 1), minlength=WORDS) * (200.0 / len(hashes))) / 4
    out[256 : 256 + SHAPES] = (
        1.0,
        np.log1p(n) / 10,
        np.log1p(w) / 10,
        distinct / w,
        np.log((w + 1) / (distinct + 1)),
        again / w,
        np.sqrt(again / w),
        len(set(lines)) / len(lines),
        min(n / w, 50) / 20,
        upper / n,
        np.sqrt(upper / n),
        marks / n,
        np.sqrt(marks / n),
        digits / n,
    )
    return out


@dataclass(frozen=True)
class Fitted:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _scaled(positive: np.ndarray, unlabelled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    n = len(positive) + len(unlabelled)
    mean = (positive.sum(0, dtype=np.float64) + unlabelled.sum(0, dtype=np.float64)) / n
    square = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (positive, unlabelled)) / n
    scale = np.sqrt(np.maximum(square - mean**2, 0)) + 1e-2
    move, by = mean.astype(np.float32), scale.astype(np.float32)
    return mean, scale, (positive - move) / by, (unlabelled - move) / by


def _descend(p: np.ndarray, u: np.ndarray, prior: float | None, steps: int) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk; where the estimated negative risk is below zero its gradient alone is
    followed upwards.  Without a prior the loss is that of telling p from u, both weighing the same."""
    width = p.shape[1]
    start = prior or 0.5
    w, b = np.zeros(width, np.float32), float(np.log(start / (1 - start)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    for step in range(1, steps + 1):
        sp, su = sigmoid(p @ w + b), sigmoid(u @ w + b)
        # Gradients of the means of log(1 + e^z) over both and of log(1 + e^-z) over the positives.
        gu, gp, up_p = (x.astype(np.float32) for x in (su / len(su), sp / len(sp), (1 - sp) / len(sp)))
        up, down = -np.append(up_p @ p, up_p.sum()), np.append(gu @ u, gu.sum())
        if prior is None:
            grad = up + down
        else:
            negative = -np.log1p(-su + 1e-12).mean() + prior * np.log1p(-sp + 1e-12).mean()
            down -= prior * np.append(gp @ p, gp.sum())
            grad = prior * up + down if negative >= 0 else -down
        grad[:-1] += RIDGE * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad**2
        move = RATE * (1 - step / (steps + 1)) * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1].astype(np.float32), b - float(move[-1])
    return w, b


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from positives and unlabelled alone.  Every other text of
    each serves the model, the rest the estimate: of all scores the one is taken whose bound on the prior, with
    the bound's own uncertainty, is lowest.  Two standard errors are taken off, as a prior that is too high turns
    bad texts into good ones.  Between 0.02 and 0.98; one half where there is too little to tell."""
    if len(positive) < 2 * LEAST_BIN or len(unlabelled) < 2 * LEAST_BIN:
        return 0.5
    mean, scale, p, u = _scaled(positive[::2], unlabelled[::2])
    w, b = _descend(p, u, None, FIRST_STEPS)
    zp, zu = (np.sort(((x - mean.astype(np.float32)) / scale.astype(np.float32)) @ w + b) for x in (positive[1::2], unlabelled[1::2]))
    at = zp[: len(zp) - LEAST_BIN + 1]
    above_p = (len(zp) - np.searchsorted(zp, at)) / len(zp)
    above_u = (len(zu) - np.searchsorted(zu, at)) / len(zu)
    doubt = np.sqrt(np.log(40) / 2 / len(zp)) + np.sqrt(np.log(40) / 2 / len(zu))
    best = np.argmin((above_u + doubt) / above_p)
    share = min(above_u[best] / above_p[best], 1.0)
    return float(np.clip(share - 2 * np.sqrt(share * (1 - share) / len(zu)), 0.02, 0.98))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> Fitted:
    """The model of least non-negative risk.  Without any positive or unlabelled text every score is the prior."""
    if not len(positive) or not len(unlabelled):
        return Fitted(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), float(np.log(prior / (1 - prior))), prior)
    mean, scale, p, u = _scaled(positive, unlabelled)
    w, b = _descend(p, u, prior, STEPS)
    return Fitted(mean, scale, w.astype(np.float64), b, prior)


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % FOLDS


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [features(t.as_py()).tobytes() for t in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=["doc_id", "x"])


def _sampled(docs: DataFrame, ids: DataFrame) -> np.ndarray:
    """Features of the documents with these ids, at most SAMPLE, in the order of the ids' hashes; of rows that
    share an id those that come first as bytes."""
    few = F.broadcast(ids.distinct())
    got = docs.join(few, "doc_id", "left_semi").mapInArrow(_features, "doc_id long, x binary")
    rows = sorted((r[0], bytes(r[2])) for r in got.groupBy(F.xxhash64("doc_id").alias("h"), "doc_id").agg(F.min("x")).collect())
    return np.frombuffer(b"".join([x for _, x in rows]), np.float32).reshape(-1, WIDTH)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Fitted:
    """Fit on the learning folds (crc32 of the doc_id as text, modulo 5, not 0), on at most `sample` trusted and
    `sample` unlabelled documents.  A document whose labels differ is not trusted."""
    order = F.xxhash64("doc_id")
    known = labels.where(fold(F.col("doc_id")) != 0).where("doc_id is not null and quality is not null")
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").alias("quality"))
    trusted = known.where("quality = 1").select("doc_id").orderBy(order, "doc_id").limit(sample)
    rest = docs.where((fold(F.col("doc_id")) != 0) & F.col("doc_id").isNotNull()).select("doc_id").distinct().orderBy(order, "doc_id").limit(sample)
    positive, unlabelled = _sampled(docs, trusted), _sampled(docs, rest)
    return fit(positive, unlabelled, estimated_prior(positive, unlabelled))


def _scorer(model: Fitted) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(1)], np.float64).reshape(-1, WIDTH)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(x))], names=["doc_id", "score"])

    return run


def _filter(model: Fitted, at: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Whole rows as structs, whose field `at` is the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column(0).field(at)], np.float64).reshape(-1, WIDTH)
            yield batch.filter(pa.array(model.score(x) >= THRESHOLD))

    return run


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def quality_scores(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row for each row of docs, repeats included: doc_id, held_out, score, predicted.

    Labels are learnt from the learning folds alone; a document whose labels differ is not trusted.
    Null and empty texts get the score of a text without any byte.  A null doc_id counts as the empty
    text for its fold.  Without labels every score is the prior of one half; an empty table gives no
    rows.  No column but text makes a score."""
    rows = _rows(docs)
    model = train(rows, labels, sample)
    out = rows.mapInArrow(_scorer(model), "doc_id long, score double")
    return out.select(
        "doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The rows of docs, with all their columns and repeats, whose score is at least THRESHOLD.  Null texts are
    scored as empty ones, rows with a null doc_id like any other; an empty table gives no rows, and no name of
    another column matters."""
    model = train(_rows(docs), labels, sample)
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    kept = whole.mapInArrow(_filter(model, docs.columns.index("text")), whole.schema)
    return kept.select(*[F.col("row")[c].alias(c) for c in docs.columns])
