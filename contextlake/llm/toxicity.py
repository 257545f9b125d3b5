"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

A text's features are the hashes of its distinct words and of their first five
bytes.  One weight vector serves all thresholds: P(grade > j) is the logistic
function of (weights . features - threshold j), with ordered thresholds.  The
result is the expected grade.  Grades come from the toxic label: 0 not toxic;
toxic texts are mild (1) or severe (2) as they hold at most, or more than, the
usual number of features that are typical of toxic texts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextlake.llm import scratch, textbuf

BITS = 18
GRADES = 3
#: Labelled rows of either label that the fit looks at; the lowest hashes of the id.
SAMPLE = 6000
#: A feature is typical if it is that many times as frequent in toxic texts.
LIFT = 8.0

_GAP = np.ones(256, dtype=bool)
_GAP[0x30:0x3A] = _GAP[0x61:0x7B] = _GAP[0x80:] = False


def features(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text of a block."""
    data = textbuf.lower(data)
    starts, ends, row = textbuf.words(data, offsets, _GAP)
    words = textbuf.word_hashes(data, starts, ends)
    heads = textbuf.mix(textbuf.word_hashes(data, starts, np.minimum(ends, starts + 5)) ^ np.uint64(0x5851F42D4C957F2D))
    shift = np.uint64(64 - BITS)
    first = np.searchsorted(row, np.arange(len(offsets)))
    both = (words >> shift).astype(np.int32), (heads >> shift).astype(np.int32)
    return [np.unique(np.concatenate([b[i:j] for b in both])) for i, j in zip(first[:-1], first[1:], strict=True)]


def _featured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, j, data, offsets in textbuf.blocks(batch.column(1)):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([f.tobytes() for f in features(data, offsets)], pa.binary())], ["toxic", "f"])


def _logistic(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Model:
    """``weights`` and ordered ``cuts`` (grades - 1 of them)."""

    def __init__(self, weights: np.ndarray, cuts: np.ndarray):
        self.weights, self.cuts = weights, cuts

    def above(self, f: np.ndarray) -> np.ndarray:
        """P(grade > j) for every threshold j."""
        return _logistic(self.weights[f].sum() - self.cuts)


def fit(rows: list[tuple[int, np.ndarray]], epochs: int = 10, rate: float = 0.5, sparse: float = 5.0, smooth: float = 0.1, seed: int = 5) -> Model:
    """Maximum likelihood over (grade, features) by the follow-the-regularised-
    leader rule: ``sparse`` (L1) leaves the weights of chance features at zero.
    No rows give grade 0."""
    cuts = np.array([2.0, 4.0])
    if not rows:
        return Model(np.zeros(1 << BITS), cuts + 40)
    pulls, squares, cut_squares = np.zeros(1 << BITS), np.zeros(1 << BITS), np.ones(GRADES - 1)

    def weights_of(f: np.ndarray | slice) -> np.ndarray:
        pull = pulls[f]
        return np.where(np.abs(pull) <= sparse, 0.0, -(pull - np.sign(pull) * sparse) / ((1 + np.sqrt(squares[f])) / rate + smooth))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in rng.permutation(len(rows)):
            grade, f = rows[r]
            w = weights_of(f)
            z = w.sum()
            # P(grade) = P(> grade - 1) - P(> grade); s and t are the densities at its two thresholds
            upper = _logistic(z - cuts[grade - 1]) if grade else 1.0
            lower = _logistic(z - cuts[grade]) if grade < GRADES - 1 else 0.0
            p = max(upper - lower, 1e-9)
            s = upper * (1 - upper) / p
            t = lower * (1 - lower) / p
            g = t - s  # derivative of the loss by z
            before = squares[f]
            squares[f] = before + g * g
            pulls[f] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / rate * w
            for j, d in ((grade - 1, s), (grade, -t)):
                if 0 <= j < GRADES - 1:
                    cut_squares[j] += d * d
                    cuts[j] -= 0.3 * d / np.sqrt(cut_squares[j])
            cuts[1] = max(cuts[1], cuts[0] + 0.1)
    return Model(weights_of(slice(None)), cuts)


def _graded(batches: Iterable[pa.RecordBatch], weights: np.ndarray, cuts: np.ndarray) -> Iterator[pa.RecordBatch]:
    model = Model(weights, cuts)
    for batch in batches:
        for i, j, data, offsets in textbuf.blocks(batch.column(1)):
            above = np.array([model.above(f) for f in features(data, offsets)]).reshape(j - i, -1)
            grade = (above > 0.5).sum(axis=1)
            columns = [pa.array(above.sum(axis=1)), pa.array(grade.astype(np.int32)), pa.array(above[:, 0]), pa.array(above[:, 0] > 0.5)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *columns], ["id", "severity", "grade", "score", "toxic"])


def graded(rows: list[tuple[bool, np.ndarray]]) -> list[tuple[int, np.ndarray]]:
    """Severity grades of labelled texts."""
    count = np.zeros((2, 1 << BITS))
    total = np.zeros(2)
    for toxic, f in rows:
        count[int(toxic), f] += 1
        total[int(toxic)] += 1
    share = (count + 0.5) / (total[:, None] + 1)
    typical = (share[1] > LIFT * share[0]) & (count[1] >= 5)
    hits = [int(typical[f].sum()) for toxic, f in rows if toxic]
    usual = float(np.median(hits)) if hits else 0.0
    return [((1 + (int(typical[f].sum()) > usual)) if toxic else 0, f) for toxic, f in rows]


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on at most ``sample`` documents of either label.

    Labels without a document id or a value don't count; of a document's labels
    the toxic one does.
    """
    known = labels.filter("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    known = scratch.table(known, "labels")
    parts = [known.filter(F.col("toxic") == flag).orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id").limit(sample) for flag in (False, True)]
    chosen = scratch.table(parts[0].unionByName(parts[1]), "sample")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")  # at most 2 * sample ids
    found = rows.select("toxic", "text").mapInArrow(_featured, "toxic boolean, f binary").collect()
    ordered = sorted(((bool(r.toxic), r.f) for r in found))
    return fit(graded([(toxic, np.frombuffer(f, np.int32)) for toxic, f in ordered]))


def grade(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, severity 0 to 2, grade, score = P(grade > 0), toxic) of every row.

    A null text is empty and has no features: it gets what the thresholds say.
    Repeated rows and null ids are rows like others; other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    out = texts.mapInArrow(partial(_graded, weights=model.weights, cuts=model.cuts), "id long, severity double, grade int, score double, toxic boolean")
    return out.withColumnRenamed("id", id_col)
