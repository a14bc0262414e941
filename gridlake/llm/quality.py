"""A quality classifier by positive-unlabelled learning.

A linear model minimises the non-negative unbiased risk  pi R+(P) + max(0, R-(U) - pi R-(P))  over trusted positives P, unlabelled text U
and a class prior pi, with the logistic loss. pi is estimated from P and U alone: the smallest ratio of U's to P's share above a
score, over all scores of a first model that tells P from U.

Features of a whole text: shares of pairs of byte classes, of hashed words and of hashed byte trigrams, how well it compresses, its length. They come from one pass in vectorised
Python; only the samples for the fit (``max_positive`` and ``max_unlabelled`` rows, chosen by a hash of the id) reach the driver, and
their sizes do not grow with the corpus. Scoring is one pass over all texts without a shuffle.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .minhash import _mix, word_hashes
from .packing import slices

MAX_POSITIVE = 4_000
MAX_UNLABELLED = 8_000
#: A text is rejected under this score.
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """A class for each byte: kinds of characters, and each common sign by itself."""
    table = np.zeros(256, np.int64)
    table[128:] = 1
    table[97:123] = 2
    table[65:91] = 3
    table[48:58] = 4
    for i, signs in enumerate((" ", "\t\n\r", ".", ",;:", "'\"`", "()[]{}<>", "!", "?", "|", "#$%&*@", "/\\_-+=~^")):
        table[[ord(c) for c in signs]] = 5 + i
    return table


CLASSES = _classes()
N = 16
#: Buckets of hashed words (A-Z count as a-z) and of hashed byte trigrams.
WORDS, GRAMS = 512, 256
PLAIN = N * N + 4
WIDTH = PLAIN + WORDS + GRAMS
#: How far a hashed feature counts beside a plain one: they are many, and each sees few texts.
HASHED = np.where(np.arange(WIDTH) < PLAIN, 1, 0.1).astype(np.float32)


def _shares(bucket: np.ndarray, size: int) -> np.ndarray:
    return np.sqrt(np.bincount(bucket, minlength=size) / max(1, len(bucket)))


def features(texts: list[bytes]) -> np.ndarray:
    """One row per text; every byte counts."""
    out = np.zeros((len(texts), WIDTH), np.float32)
    for row, t in zip(out, texts):
        n = len(t)
        if n:
            b = np.frombuffer(t, np.uint8)
            c = CLASSES[b]
            row[: N * N] = _shares(c[:-1] * N + c[1:], N * N)
            words = t.split()
            w = max(1, len(words))
            row[N * N : PLAIN] = (len(zlib.compress(t, 1)) / (n + 32), np.log1p(n) / 12, sum(map(bytes.__eq__, words[1:], words)) / w, len(set(words)) / w)
            row[PLAIN : PLAIN + WORDS] = _shares((word_hashes(b)[0] % np.uint64(WORDS)).astype(np.int64), WORDS)
            u = b.astype(np.uint64)
            grams = _mix(u[:-2] << np.uint64(16) | u[1:-1] << np.uint64(8) | u[2:])
            row[PLAIN + WORDS :] = _shares((grams % np.uint64(GRAMS)).astype(np.int64), GRAMS)
    return out


def _frame(docs: DataFrame, text: str) -> DataFrame:
    return docs.select("doc_id", F.col(text).alias("text"))


def _sample(docs: DataFrame, text: str) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            x = features([(t or "").encode() for t in batch.column("text").to_pylist()])
            yield pa.RecordBatch.from_arrays([pa.array([r.astype("<f2").tobytes() for r in x], pa.binary())], ["x"])

    rows = _frame(docs, text).mapInArrow(run, "x binary").toArrow().column("x").to_pylist()
    # The order of the rows depends on the tasks; sorting makes the fit repeatable.
    rows.sort()
    return np.frombuffer(b"".join(rows), "<f2").astype(np.float32).reshape(-1, WIDTH)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _adam(grad, width: int, steps: int, rate: float = 0.05) -> np.ndarray:
    w, m, v = np.zeros(width, np.float32), np.zeros(width, np.float32), np.zeros(width, np.float32)
    for t in range(1, steps + 1):
        g = grad(w).astype(np.float32)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - np.float32(rate) * (m / np.float32(1 - 0.9**t)) / (np.sqrt(v / np.float32(1 - 0.999**t)) + np.float32(1e-8))
    return w


def estimate_prior(pos: np.ndarray, unl: np.ndarray, steps: int = 150) -> float:
    """Share of positives in U: the least U(A) / P(A) over the sets A above a score that hold at least 40 % of P.

    The scores are out of sample: each half of the rows is scored by a model of the other half."""
    sp, su = np.zeros(len(pos)), np.zeros(len(unl))
    for k in (0, 1):
        p, u = pos[k::2], unl[k::2]

        def grad(w: np.ndarray) -> np.ndarray:
            return -p.T @ (1 - _sigmoid(p @ w)) / len(p) + u.T @ _sigmoid(u @ w) / len(u) + 1e-4 * w

        w = _adam(grad, pos.shape[1], steps)
        sp[1 - k :: 2], su[1 - k :: 2] = pos[1 - k :: 2] @ w, unl[1 - k :: 2] @ w
    cuts = np.quantile(sp, np.linspace(0, 0.6, 121))
    above_p = np.array([(sp >= c).mean() for c in cuts])
    above_u = np.array([(su >= c).mean() for c in cuts])
    return float(np.clip((above_u / above_p).min(), 0.05, 0.98))


def fit_pu(pos: np.ndarray, unl: np.ndarray, prior: float | None = None, steps: int = 400, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights (features standardised inside, so they apply to plain features with a trailing 1) and the prior."""
    k, n = pos.shape[1], len(pos) + len(unl)
    mean = (pos.sum(0, np.float64) + unl.sum(0, np.float64)) / n
    square = sum(np.einsum("ij,ij->j", x, x, dtype=np.float64) for x in (pos, unl)) / n
    scale = np.sqrt(np.maximum(square - mean * mean, 0)) + 1e-3
    if k == WIDTH:
        scale = scale / HASHED

    def one(x: np.ndarray) -> np.ndarray:
        """Standardised, with a trailing 1; made in place, as the driver holds these."""
        out = np.ones((len(x), k + 1), np.float32)
        np.divide(x - mean.astype(np.float32), scale.astype(np.float32), out=out[:, :k])
        np.clip(out[:, :k], -8, 8, out=out[:, :k])
        return out

    p, u = one(pos), one(unl)
    pi = estimate_prior(p, u) if prior is None else prior

    def grad(w: np.ndarray) -> np.ndarray:
        zp, zu = p @ w, u @ w
        sp, su = _sigmoid(zp), _sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - pi * np.logaddexp(0, zp).mean()
        part = u.T @ su / len(u) - pi * (p.T @ sp) / len(p)
        plus = -pi * (p.T @ (1 - sp)) / len(p)
        # A negative part of the risk under zero is overfitting: step back instead of following it.
        return (plus + part if negative >= 0 else -part) + decay * w

    return np.concatenate([_adam(grad, p.shape[1], steps), mean, scale]), pi


def score_features(x: np.ndarray, model: np.ndarray) -> np.ndarray:
    k = x.shape[1]
    w, mean, scale = model[: k + 1], model[k + 1 : 2 * k + 1], model[2 * k + 1 :]
    return _sigmoid(np.clip((x - mean) / scale, -8, 8) @ w[:k] + w[k])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> np.ndarray | None:
    """A model from documents that ``labels`` marks 1 and unlabelled ones, held-out ids left out of both.

    None if there are no documents or fewer than two positive labels to learn from; an error if there are, but the sample found no text of them.
    """
    ids = labels.filter((F.col("quality") == 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id").distinct()

    def some(rows: DataFrame, n: int, most: int) -> DataFrame:
        """About ``most`` of ``n`` rows at most, by 62 bits of a hash of the id."""
        return rows.filter(F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(1 << 62)) < (1 << 62) * min(most, n) // max(1, n))

    rest = _frame(docs, text).filter(~held_out(F.col("doc_id")))
    n_ids, n_rest = ids.count(), rest.count()
    if n_ids < 2 or n_rest < 2:
        return None
    # At most max_positive ids, so the broadcast has a bound.
    pos = _sample(_frame(docs, text).join(F.broadcast(some(ids, n_ids, max_positive)), "doc_id", "left_semi"), text="text")
    unl = _sample(some(rest, n_rest, max_unlabelled), text="text")
    if not len(pos) or not len(unl):
        raise ValueError(f"no text found to learn from: {len(pos)} of {n_ids} positive and {len(unl)} of {n_rest} unlabelled documents")
    return None if len(pos) < 2 or len(unl) < 2 else fit_pu(pos, unl)[0]


def score(docs: DataFrame, model: np.ndarray | None, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """All columns of ``docs`` and, under ``names``, its score (0 to 1) and prediction (1 from ``threshold`` on); only the text is scored.

    A null or empty text has the score of all-zero features. Without a model every score is 0.5. Columns of ``docs`` with one of the names are replaced. An empty
    table gives an empty result.
    """
    others = [c for c in docs.columns if c not in names]
    schema = docs.select(others).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            x = features([(t or "").encode() for t in batch.column(text).to_pylist()])
            s = np.full(len(x), 0.5) if model is None else score_features(x, model)
            cols = [batch.column(c) for c in others] + [pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32), pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, [*others, *names])

    return docs.select(others).mapInArrow(run, schema.add(names[0], "double").add(names[1], "integer"))
