"""Quality classifier: a regularised quadratic discriminant over transformed document statistics.

Each class has a mean and a covariance, shrunk towards the pooled one and towards its own diagonal. A score is the
logistic of the difference of the two log densities (Mahalanobis distance and log determinant, both from Cholesky
factors that are computed once) plus the log prior ratio.

The model is fitted on a bounded sample of labelled rows (``FIT_ROWS``); every document is measured once, when it is
scored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Towards the pooled covariance, and towards the diagonal.
POOL, DIAGONAL = 0.7, 0.05
RIDGE = 1e-3
#: Labelled (doc_id, label) pairs that a model is fitted on, about; all if there are fewer.
FIT_ROWS = 20_000
STATISTICS = ("log_words", "mean_word", "spread_word", "upper", "digit", "symbol", "short_words", "distinct", "repeated_lines", "stops", "line_words")
_NO_LETTERS = bytes(i for i in range(256) if chr(i).isalnum() and i < 128 or i >= 128 or i in b" \t\r\n\x0b\x0c")
_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
_LOWER = bytes(i for i in range(256) if not 97 <= i <= 122)
_DIGIT = bytes(i for i in range(256) if not 48 <= i <= 57)
#: Words (and characters) of typical text that each rate is smoothed with, so that a few words don't look extreme.
WORDS, CHARS = 8.0, 50.0


def _logit(part: float, whole: float, usual: float, weight: float = WORDS) -> float:
    p = (part + usual * weight) / (whole + weight)
    return float(np.log(p / (1.0 - p))) if p < 1 else 10.0


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole UTF-8 text; defined for the empty text too."""
    words = text.split()
    n, size = len(words), len(text)
    lengths = [len(w) for w in words]
    mean = (sum(lengths) + 6.0 * WORDS) / (n + WORDS)
    spread = (sum(x * x for x in lengths) + 48.0 * WORDS) / (n + WORDS) - mean * mean
    symbols = len(text.translate(None, _NO_LETTERS))
    upper, lower = len(text.translate(None, _UPPER)), len(text.translate(None, _LOWER))
    digits = len(text.translate(None, _DIGIT))
    lines = text.split(b"\n")
    stops = text.count(b". ") + text.count(b".\n") + text.endswith(b".")
    short = sum(1 for x in lengths if x <= 3)
    return [
        float(np.log(n + WORDS)),
        float(np.log(mean)),
        float(np.log1p(max(0.0, spread))),
        _logit(upper, upper + lower, 0.03, CHARS),
        _logit(digits, size, 0.004, CHARS),
        _logit(symbols, size, 0.03, CHARS),
        _logit(short, n, 0.3),
        float(np.log((len(set(words)) + WORDS) / np.sqrt(n + WORDS))),
        _logit(len(lines) - len(set(lines)), len(lines), 0.02),
        _logit(min(stops, n), n, 0.1),
        float(np.log((n + WORDS) / (len(lines) + 1.0))),
    ]


def _matrix(column: pa.Array) -> np.ndarray:
    texts = column.cast(pa.large_binary()).to_pylist()
    return np.array([statistics(t or b"") for t in texts], dtype=np.float64).reshape(-1, len(STATISTICS))


@dataclass
class Discriminant:
    """Means, inverse Cholesky factors, log determinants and log priors of both classes."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_prior: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        out = []
        for k in (0, 1):
            z = (x - self.means[k]) @ self.whiten[k].T
            out.append(self.log_prior[k] - 0.5 * (np.einsum("ij,ij->i", z, z) + self.log_det[k]))
        return 1.0 / (1.0 + np.exp(-np.clip(out[1] - out[0], -500, 500)))


def _discriminant(counts: np.ndarray, sums: np.ndarray, products: np.ndarray, pool: float, diagonal: float) -> Discriminant:
    d = sums.shape[1]
    means, covariances = np.zeros((2, d)), np.zeros((2, d, d))
    for k in (0, 1):
        if counts[k]:
            means[k] = sums[k] / counts[k]
            covariances[k] = products[k] / counts[k] - np.outer(means[k], means[k])
    pooled = (counts[0] * covariances[0] + counts[1] * covariances[1]) / max(1.0, counts.sum())
    whiten, log_det = [], []
    for k in (0, 1):
        c = (1 - pool) * covariances[k] + pool * pooled
        c = (1 - diagonal) * c + diagonal * np.diag(np.diag(c)) + RIDGE * np.eye(d)
        factor = np.linalg.cholesky(c)
        whiten.append(np.linalg.inv(factor))
        log_det.append(2 * np.log(np.diag(factor)).sum())
    prior = np.log((counts + 1.0) / (counts.sum() + 2.0))
    return Discriminant(means, np.array(whiten), np.array(log_det), prior)


def learnable(doc_id: str = "doc_id"):
    """Rows whose labels may be learnt from: crc32 of the id as text, modulo 3, is not 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3 != 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, pool: float = POOL, diagonal: float = DIAGONAL, rows: int = FIT_ROWS) -> Discriminant:
    """Fit on the labelled rows of ``docs`` (``doc_id, text``) that ``learnable`` admits, about ``rows`` of them.

    The sample takes (doc_id, label) pairs by a hash of the id, and counts a pair as often as it is labelled, so it is
    small enough to be sent to the texts, whatever the labels. Each task sums its rows to two sets of moments, and the
    sums are added: what reaches the driver does not grow with the input. Null labels are left out. Where a class has
    no rows the scores rest on the prior and the pooled covariance.
    """
    d = len(STATISTICS)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.filter(learnable() & F.col("quality").isin(0, 1)).groupBy("doc_id", "quality").agg(F.count("*").alias("weight"))
    share = rows / max(1, known.count())
    sample = known.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 31)) < int(min(1.0, share) * (1 << 31)))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x, y = _matrix(batch.column(2)), batch.column(0).to_numpy()
            w = batch.column(1).to_numpy().astype(float)
            for k in (0, 1):
                own, weight = x[y == k], w[y == k]
                total[k] += np.concatenate([[weight.sum()], weight @ own, ((own.T * weight) @ own).ravel()])
        for k in (0, 1):
            if total[k, 0]:
                slots = np.arange(total.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(slots.size, k, np.int32)), pa.array(slots), pa.array(total[k])], names=["k", "slot", "v"])

    met = texts.join(F.broadcast(sample), "doc_id").select("quality", "weight", "text")  # about `rows` small rows
    sums = met.mapInArrow(run, "k int, slot int, v double").groupBy("k", "slot").agg(F.sum("v").alias("v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in sums.collect():  # 2 * (1 + d + d * d) rows
        total[r.k, r.slot] = r.v
    return _discriminant(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), pool, diagonal)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs`` (``doc_id, text``; others are not read).

    Null and empty texts get the score of the empty text's statistics; a null doc_id is scored and not held out;
    repeated rows are each scored, and count as often as they are labelled when fitting.
    """
    model = fit(docs, labels)

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.score(_matrix(batch.column(1))))], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = rows.mapInArrow(run, "doc_id long, score double")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the classifier accepts (score of 0.5 or more), columns as given; texts stay where they are."""
    model = fit(docs, labels)
    at = docs.columns.index("text")

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                yield batch.filter(pa.array(model.score(_matrix(batch.column(at))) >= 0.5))

    return docs.mapInArrow(run, docs.schema)
