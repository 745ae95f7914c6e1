"""A quality classifier from positive and unlabelled texts.

Trusted positives are documents labelled 1; the unlabelled are web texts at large, good ones among them. The model, a logistic one on measures of the
text, minimises the non-negative unbiased risk: prior * loss on positives as such, plus what the unlabelled lose as negatives beyond
the positives' share of that, but no less than nothing. The class prior is estimated from labels where both kinds are marked, else by how high
held-back positives score in a positive-against-unlabelled model. Both samples are bounded; all documents are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from proofloom.llm import words
from proofloom.llm.shared import find_package


@dataclass(frozen=True)
class QualityModel:
    #: Rows, about, of trusted positives and of unlabelled texts that the model is fitted on.
    sample_rows: int = 8000
    steps: int = 1500
    rate: float = 0.05
    decay: float = 1e-4


_SIGNS = [b"#*$%&|<>", b"!?", b".", b",;:", b"\"'()[]{}", b"\n", b"0123456789"]


def _kinds() -> np.ndarray:
    out = np.zeros((4 + len(_SIGNS), 256), np.uint8)
    out[0, 65:91] = 1
    out[1, 97:123] = 1
    out[2, 128:] = 1
    out[3, [32, *range(9, 14)]] = 1
    for i, s in enumerate(_SIGNS):
        out[4 + i, list(s)] = 1
    return out


_KINDS = _kinds()


def measures(column: pa.Array) -> np.ndarray:
    """A row of measures for each text; null and empty texts have zeros but for the constant."""
    out = []
    for _, _, data, off in words.pieces(column):
        size = np.maximum(np.diff(off), 1)[:, None]
        shares = np.stack([np.diff(np.append(0, np.cumsum(k[data], dtype=np.int64))[off]) for k in _KINDS], axis=1) / size
        s, e, n = words.bounds(data, off)
        h = words.hashes(data, s, e)
        at = words.row_slices(n)
        per = lambda x: np.diff(np.append(0, np.cumsum(x, dtype=np.float64))[at]) / np.maximum(n, 1)  # noqa: E731,B023
        row = np.repeat(np.arange(len(n)), n)
        order = np.lexsort((h, row))
        new = np.ones(len(h), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        length = (e - s).astype(np.float64)
        first, last = data[s] if len(s) else data[:0], data[e - 1] if len(s) else data[:0]
        letter = (_KINDS[0] | _KINDS[1] | _KINDS[2]).astype(bool)
        parts = [per(new), np.sqrt(per(new) * n), per(same), per(length), np.sqrt(np.maximum(per(length**2) - per(length) ** 2, 0)), per(length > 20), per(_KINDS[0][first]), per(~letter[last]), per(_KINDS[4][last]), per(_KINDS[5][last])]
        x = np.column_stack([shares, *parts, np.log1p(n)])
        out.append(np.where(n[:, None] > 0, x, 0))
    return np.concatenate(out) if out else np.zeros((0, len(_KINDS) + 11))


def _design(x: np.ndarray, centre: np.ndarray, spread: np.ndarray) -> np.ndarray:
    z = np.clip((x - centre) / spread, -6, 6)
    return np.hstack([np.ones((len(z), 1)), z, z * z - 1])


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, cfg: QualityModel) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(weights, centre, spread) that minimise the non-negative unbiased risk with logistic loss."""
    both = np.vstack([positive, unlabelled])
    centre, spread = both.mean(0), both.std(0) + 1e-6
    p, u = _design(positive, centre, spread), _design(unlabelled, centre, spread)
    w = np.zeros(p.shape[1])
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, cfg.steps + 1):
        sp, su = 1 / (1 + np.exp(-np.clip(p @ w, -30, 30))), 1 / (1 + np.exp(-np.clip(u @ w, -30, 30)))
        as_positive = p.T @ (sp - 1) / len(p)
        as_negative = u.T @ su / len(u) - prior * (p.T @ sp) / len(p)
        rest = -np.log1p(-np.minimum(su, 1 - 1e-12)).mean() + prior * np.log1p(-np.minimum(sp, 1 - 1e-12)).mean()
        grad = prior * as_positive + as_negative if rest >= 0 else -as_negative  # below nothing, go back up
        grad = grad + cfg.decay * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - cfg.rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w, centre, spread


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray, cfg: QualityModel) -> float:
    """Share of positives among the unlabelled: mean odds of a positive-against-unlabelled model over the odds of held-back positives."""
    w, centre, spread = fit(positive[::2], unlabelled, 0.5, cfg)
    score = lambda x: 1 / (1 + np.exp(-np.clip(_design(x, centre, spread) @ w, -30, 30)))
    return float(np.clip(np.mean(score(unlabelled)) / max(np.mean(score(positive[1::2] if len(positive) > 1 else positive)), 1e-6), 0.05, 0.95))


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("kind"), pa.array(list(measures(batch.column("text"))), pa.list_(pa.float64()))], ["kind", "x"])


def _scored(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    w, centre, spread = model
    for batch in batches:
        x = measures(batch.column("text"))
        score = 1 / (1 + np.exp(-np.clip(_design(x, centre, spread) @ w, -30, 30)))
        yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(score)], [*batch.drop_columns(["text"]).schema.names, "score"])


def _bounded(df: DataFrame, rows: int, *by: str | Column) -> DataFrame:
    """About rows rows: those whose hash of 60 bits is low. by tells all rows apart, so their number is binomial: twice as many are never drawn."""
    n = df.count()
    return df.where(F.shiftrightunsigned(F.xxhash64(*by), 4) < F.lit(rows * (1 << 60) // n)) if n > rows else df


def learn(docs: DataFrame, labels: DataFrame, cfg: QualityModel):
    """The model, from bounded samples of docs labelled 1 and of all docs; labels (doc_id, quality) are those that may be learned from."""
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    ones, zeros = known.agg(F.coalesce(F.sum("quality"), F.lit(0)), F.coalesce(F.sum(1 - F.col("quality")), F.lit(0))).first()
    trusted = _bounded(known.where("quality = 1"), cfg.sample_rows, "doc_id", F.lit(1)).select("doc_id")
    trusted = docs.join(trusted, "doc_id").groupBy("doc_id").agg(F.max("text").alias("text"))
    web = _bounded(docs.withColumn("__row", F.monotonically_increasing_id()), cfg.sample_rows, "doc_id", "__row", F.lit(2))  # rows alike are drawn apart
    sample = trusted.select(F.lit(1).alias("kind"), "doc_id", "text").union(web.select(F.lit(0), "doc_id", "text"))
    sample = sample.orderBy("kind", "doc_id", "text").select("kind", "text")
    found = sample.mapInArrow(words.tidied(_measured), "kind int, x array<double>").collect()
    positive, unlabelled = (np.array([r.x for r in found if r.kind == k]).reshape(-1, len(_KINDS) + 11) for k in (1, 0))
    if not len(positive) or not len(unlabelled):
        width = len(_KINDS) + 11
        return np.zeros(1 + 2 * width), np.zeros(width), np.ones(width)
    prior = ones / (ones + zeros) if zeros else estimate_prior(positive, unlabelled, cfg)
    return fit(positive, unlabelled, float(np.clip(prior, 0.05, 0.95)), cfg)


def score_quality(docs: DataFrame, labels: DataFrame, cfg: QualityModel | None = None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs (doc_id, text).

    Labels of rows whose crc32(doc_id as text) mod 3 is 1 are held out: never learned from. A document with several labels has the lowest.
    Null and empty texts are scored like all others; without labels every score is 0.5. Rows that repeat a doc_id are scored each, and the
    greatest of their texts is the trusted one. Unlabelled rows are drawn by their place in the table, so a table in other files is another sample. Rows without doc_id are scored and never trusted. Other columns are ignored. Empty in, empty out.
    """
    cfg = cfg or QualityModel()
    spark = docs.sparkSession
    find_package(spark)
    docs = docs.select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    model = learn(docs, labels.select("doc_id", "quality").where(~held_out), cfg)
    rows = docs.select("doc_id", held_out.alias("held_out"), "text").mapInArrow(words.tidied(_scored, model=model), "doc_id long, held_out boolean, score double")
    return rows.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))
