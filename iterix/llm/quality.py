"""Quality classifier by positive-unlabelled learning.

Training minimises the non-negative unbiased risk (Kiryo et al. 2017)

    pi * R_p(+) + max(0, R_u(-) - pi * R_p(-))

of a small network over text statistics, with the logistic loss: R_p over trusted
positives (label 1), R_u over unlabelled documents (their labels, if any, unused).
When the second term goes negative, its gradient is reversed, which keeps the model
from explaining unlabelled positives away. The class prior pi is estimated from positives
and unlabelled documents alone (Garg et al. 2021): a network that tells the two apart is
trained on one half of both, and on the other half the share of unlabelled documents above
a score, over that of positives, is least where the best bin is pure. No label 0 is read.

The statistics describe form, not topic: shares of symbols, capitals, digits, bars and
repeated words and lines, word lengths, entropy. All come from whole texts, in one
pass of numpy over Arrow batches; no language, source or id goes in.

Bounds, as parameters, on what the fit reads: at most `sample` positives and `sample`
unlabelled rows, of the lowest id hashes; only their statistics are sorted and gathered.
Every row is scored.

Defined cases: null and empty texts get the score of their (all zero) statistics; a very
long text is measured by itself; labels of 0, null or other values are not positives, and
neither is an id with other labels beside 1; samples with equal hashes go by id and then by
statistics, so ties do not depend on the order of rows; without a positive, all scores are
`default_prior`; repeated rows repeat; an empty table gives no row; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from iterix.llm import _text
from iterix.llm._links import kept_rows
from iterix.llm.language_id import held_out
from iterix.session import ship

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&<>@^~=+_{}[]\\/"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LOWER = np.zeros(256, bool)
_LOWER[97:123] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
N_FEATURES = 19
#: Bytes of texts measured at once: the work arrays take many times as much.
_CHUNK = 1 << 18


def statistics(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """One row of statistics for each document of a chunk."""
    n = len(off) - 1
    size = np.diff(off).astype(float)
    out = np.zeros((n, N_FEATURES), np.float64)
    if not len(raw):
        return out

    def total(mask: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (sums[off[1:]] - sums[off[:-1]]).astype(float)

    words, starts = _text.word_hashes(raw, off)
    doc = _text.word_docs(starts, off)
    n_words = np.bincount(doc, minlength=n).astype(float)
    w, b = np.maximum(n_words, 1), np.maximum(size, 1)
    salt = doc.astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
    again = _text.occurrence(_text.mix(words + salt)) > 0
    follows = np.zeros(len(words), bool)
    follows[1:] = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
    shingle, of = _windows(words, doc, 3)
    same = _text.occurrence(_text.mix(shingle + of.astype(np.uint64) * np.uint64(0xA0761D6478BD642F))) > 0
    symbol, upper, lower, space = _SYMBOL[raw], _UPPER[raw], _LOWER[raw], _text.SPACE[raw]
    bang, bar = raw == 33, raw == 124
    # a symbol or mark that ends a run of letters; a capital within a word
    letter = upper | lower | (raw >= 128)
    tail = np.zeros(len(raw), bool)
    tail[1:] = symbol[1:] & letter[:-1]
    loud = np.zeros(len(raw), bool)
    loud[1:] = upper[1:] & upper[:-1]
    heads = off[:-1][size > 0]  # what came before is another text
    tail[heads] = loud[heads] = False
    stop = (raw == 46) | (raw == 44)
    lines = total(raw == 10)
    per = [total(symbol), total(upper), total(lower), total(_DIGIT[raw]), total(bang), total(bar), total(raw >= 128), total(space), total(tail), total(loud), total(stop)]
    columns = [
        np.log1p(n_words) / 10,
        per[0] / w, per[1] / b * 10, per[2] / b, per[3] / b * 10, per[4] / w, per[5] / w, per[6] / b, per[8] / w, per[9] / w, per[10] / w,
        np.bincount(doc, weights=again, minlength=n) / w,
        np.bincount(doc, weights=follows, minlength=n) / w,
        np.bincount(of, weights=same, minlength=n) / w,
        lines / w * 10,
        (b - per[7]) / w / 10,
        np.sqrt(np.bincount(doc, weights=follows, minlength=n)) / 10,
        np.sqrt(np.bincount(of, weights=same, minlength=n)) / 10,
        np.sqrt(per[4] + per[5] + per[0]) / 10,
    ]
    out[:] = np.stack(columns, axis=1)
    out[size == 0] = 0
    return np.round(np.minimum(out, 10), 9)  # alike in every batch


def _windows(words: np.ndarray, doc: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    if len(words) < width:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    m = len(words) - width + 1
    h = np.zeros(m, np.uint64)
    for k in range(width):
        h += words[k : k + m] * np.uint64(2 * k + 0x9E3779B1)
    whole = doc[:m] == doc[width - 1 :]
    return h[whole], doc[:m][whole]


def batch_statistics(column: pa.Array) -> np.ndarray:
    raw, off = _text.utf8(column)
    parts = [statistics(r, o) for _, _, r, o in _text.chunks(raw, off, _CHUNK)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES))


@dataclass(frozen=True)
class QualityConfig:
    sample: int = 8000
    hidden: int = 24
    epochs: int = 60
    batch: int = 512
    rate: float = 0.01
    decay: float = 1e-4
    default_prior: float = 0.8
    seed: int = 3


@dataclass
class QualityModel:
    prior: float
    mean: np.ndarray
    scale: np.ndarray
    layers: list[tuple[np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.layers:
            return np.full(len(x), self.prior)
        (w1, b1), (w2, b2) = self.layers
        h = np.tanh(np.clip((x - self.mean) / self.scale, -8, 8) @ w1 + b1)
        return 1 / (1 + np.exp(-np.clip(h @ w2 + b2, -30, 30)))


def train(positive: np.ndarray, unlabelled: np.ndarray, prior: float, cfg: QualityConfig = QualityConfig(), naive: bool = False) -> QualityModel:
    """Adam on the non-negative risk; naive: on the plain one of positives against unlabelled."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(prior, np.zeros(N_FEATURES), np.ones(N_FEATURES), [])
    g = np.random.default_rng(cfg.seed)
    mean, scale = unlabelled.mean(0), unlabelled.std(0) + 1e-3
    p, u = (np.clip((x - mean) / scale, -8, 8) for x in (positive, unlabelled))
    theta = [g.normal(0, 1 / np.sqrt(N_FEATURES), (N_FEATURES, cfg.hidden)), np.zeros(cfg.hidden), g.normal(0, 1 / np.sqrt(cfg.hidden), cfg.hidden), np.zeros(())]
    m, v, step = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta], 0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for epoch in range(cfg.epochs):
        rate = cfg.rate * (1 - epoch / cfg.epochs) + 1e-4
        order = g.permutation(len(u))
        for i in range(0, len(u), cfg.batch):
            xu, xp = u[order[i : i + cfg.batch]], p[g.integers(0, len(p), cfg.batch)]
            x = np.concatenate([xp, xu])
            h = np.tanh(x @ theta[0] + theta[1])
            z = h @ theta[2] + theta[3]
            zp, zu = z[: len(xp)], z[len(xp) :]
            negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            if naive:
                dz = np.concatenate([(sigmoid(zp) - 1) / len(xp), sigmoid(zu) / len(xu)])
            elif negative >= 0:
                dz = np.concatenate([prior * (sigmoid(zp) - 1 - sigmoid(zp)) / len(xp), sigmoid(zu) / len(xu)])
            else:  # step back along the negative part
                dz = np.concatenate([prior * sigmoid(zp) / len(xp), -sigmoid(zu) / len(xu)])
            dh = dz[:, None] * theta[2] * (1 - h * h)
            grads = [x.T @ dh, dh.sum(0), h.T @ dz, dz.sum()]
            step += 1
            for k, d in enumerate(grads):
                d = d + cfg.decay * theta[k]
                m[k] = 0.9 * m[k] + 0.1 * d
                v[k] = 0.999 * v[k] + 0.001 * d * d
                theta[k] = theta[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return QualityModel(prior, mean, scale, [(theta[0], theta[1]), (theta[2], theta[3])])


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, cfg: QualityConfig = QualityConfig()) -> float:
    """The share of positives among the unlabelled, by the best bin of a classifier of positives against unlabelled."""
    if min(len(positive), len(unlabelled)) < 40:
        return cfg.default_prior
    model = train(positive[::2], unlabelled[::2], 0.5, replace(cfg, epochs=cfg.epochs // 2), naive=True)
    p, u = (np.sort(model.score(x[1::2]))[::-1] for x in (positive, unlabelled))
    error = np.sqrt(np.log(4 / 0.1) / 2) * (len(u) ** -0.5 + len(p) ** -0.5)  # of both shares, by Dvoretzky, Kiefer and Wolfowitz
    cut = np.unique(p)
    above = lambda x: 1 - np.searchsorted(x[::-1], cut, "left") / len(x)
    share_p, share_u = above(p), above(u)
    best = int(np.argmin((share_u + error) / np.maximum(share_p, 1e-9)))
    return float(np.clip(share_u[best] / share_p[best], 0.01, 0.99))


def _lowest(rows: DataFrame, n: int, salt: str) -> np.ndarray:
    """Statistics of the n rows of the lowest id hash. A hash threshold comes first, so that few texts are read; only numbers are sorted."""
    h = F.xxhash64(F.col("doc_id"), F.lit(salt))
    whole = rows.count()
    if whole > 2 * n:
        rows = rows.where(h < int(-(2**63) + 2.0 * n / whole * 2**64))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(batch_statistics(batch.column(2)).tolist(), pa.list_(pa.float64()))], ["h", "doc_id", "x"])

    measured = rows.select(h.alias("h"), "doc_id", "text").mapInArrow(measure, "h long, doc_id long, x array<double>")
    found = [r["x"] for r in measured.orderBy("h", "doc_id", "x").limit(n).collect()]
    return np.array(found, float).reshape(-1, N_FEATURES)


def fit(docs: DataFrame, labels: DataFrame, cfg: QualityConfig = QualityConfig()) -> QualityModel:
    """A model from docs (doc_id, text) and the labels (doc_id, quality) of rows outside the held-out fold."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where("doc_id is not null").where(~held_out(5, 0))
    trusted = known.groupBy("doc_id").agg(F.min(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good")).where("good").select("doc_id")
    p = trusted.count()
    h = F.xxhash64(F.col("doc_id"), F.lit("positive"))
    if p > 2 * cfg.sample:  # only ids that the sample can hold go into the join
        trusted = trusted.where(h < int(-(2**63) + 2.0 * cfg.sample / p * 2**64))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    positive = _lowest(rows.join(trusted, "doc_id", "left_semi"), cfg.sample, "positive")
    unlabelled = _lowest(rows.where(~held_out(5, 0)), cfg.sample, "unlabelled")
    return train(positive, unlabelled, estimate_prior(positive, unlabelled, cfg), cfg)


def score(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs (doc_id, text)."""

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = model.score(batch_statistics(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(5, 0), F.lit(False)).alias("held_out"), F.col("text").cast("string").alias("text"))
    return given.mapInArrow(rate, "doc_id long, held_out boolean, score double, predicted int")


def accepted(docs: DataFrame, model: QualityModel, threshold: float = 0.3) -> DataFrame:
    """The rows of docs (text, ...) that score the threshold or more."""
    return kept_rows(docs, lambda texts: (model.score(batch_statistics(texts)) >= threshold).tolist())


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = ship(spark).read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
