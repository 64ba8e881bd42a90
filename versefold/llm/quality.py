"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One vector of weights over hashed byte trigrams and word shapes (repetition of the word before, or length) gives each text a place on a line; ordered thresholds on that line give
the probabilities of the grades, P(grade <= k) = logistic(threshold k - place). Selection goes by the expected grade
or by the probability of a grade or more.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_sample, map_batches, slices, table, utf8, words
from .toxicity import held_out

#: The training sample: so many documents of each grade at most, the first by a hash of the id.
MOST, BITS, STEPS, RATE, RIDGE = 2000, 18, 360, 0.6, 1e-4
#: Bytes of the sample's texts at most.
MOST_BYTES = 32 << 20
#: Places for words by length and repetition; so many trigrams (a fifth as many words) of no weight are added to each text.
SHAPES, FEW = 32, 100
#: Added to each feature's spread before it is scaled, so that rare trigrams, which a repetitive text is full of, don't outweigh all.
DAMP = 6e-2


def places(data: np.ndarray) -> np.ndarray:
    """The hashed trigram that starts at each byte but the last two."""
    x = data.astype(np.uint32)
    code = (x[:-2] << 16 | x[1:-1] << 8 | x[2:]) * np.uint32(2654435761)
    return (code >> np.uint32(32 - BITS)).astype(np.int64)


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word, a place beyond the trigrams': one for all that repeat the word before, else by its length; and n + 1 word offsets."""
    starts, ends, hashes, row = words(data, offsets)
    again = np.zeros(len(hashes), np.int64)
    again[1:] = hashes[1:] == hashes[:-1]
    inner = row[:-1][row[:-1] < len(hashes)]
    again[inner] = 0
    return (1 << BITS) + np.where(again, 0, np.minimum(ends - starts, SHAPES - 1)), row


def averages(values: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """For each text the mean value of its trigrams and that of its words, drawn to 0 where there are few."""
    total = np.zeros(max(len(data) - 1, 1))
    if len(data) > 2:
        np.cumsum(values[places(data)], out=total[1:])
    n = np.maximum(np.diff(offsets) - 2, 0)
    lo = np.minimum(offsets[:-1], len(total) - 1)
    hi = np.where(n > 0, np.minimum(offsets[:-1] + n, len(total) - 1), lo)
    shape, row = shapes(data, offsets)
    by_word = np.r_[0.0, np.cumsum(values[shape])]
    return (total[hi] - total[lo]) / (n + FEW) + (by_word[row[1:]] - by_word[row[:-1]]) / (np.diff(row) + FEW // 5)


@dataclass
class Model:
    weights: np.ndarray
    thresholds: np.ndarray

    def tails(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """P(grade > k) for each text and threshold."""
        place = np.concatenate([averages(self.weights, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]) for lo, hi in slices(offsets)] or [np.zeros(0)])
        return 1 / (1 + np.exp(-np.clip(place[:, None] - self.thresholds[None, :], -40, 40)))


@dataclass
class Sample:
    """Graded texts as counts of features: for each entry its text, its feature and its value; for each text its grade and weight."""

    row: np.ndarray
    column: np.ndarray
    value: np.ndarray
    grade: np.ndarray
    weight: np.ndarray
    n_grades: int

    def loss(self, w: np.ndarray, cuts: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The weighted negative log-likelihood with its ridge, and its slopes. cuts: the first threshold, then the gaps between them."""
        y, n = self.grade, self.n_grades
        edge = np.r_[-40.0, np.cumsum(cuts), 40.0]
        place = np.bincount(self.row, weights=self.value * w[self.column], minlength=len(y))
        hi, lo = (1 / (1 + np.exp(-np.clip(edge[y + d] - place, -40, 40))) for d in (1, 0))
        p = np.maximum(hi - lo, 1e-9)
        up, down = hi * (1 - hi) / p * self.weight, lo * (1 - lo) / p * self.weight
        d_edge = np.zeros(n + 1)
        np.add.at(d_edge, y + 1, -up)
        np.add.at(d_edge, y, down)
        d_cuts = np.cumsum(d_edge[1:-1][::-1])[::-1]
        d_w = np.bincount(self.column, weights=self.value * (up - down)[self.row], minlength=len(w)) + RIDGE * w
        return float(-(self.weight * np.log(p)).sum() + RIDGE / 2 * (w * w).sum()), d_w, d_cuts

    def fitted(self, n_features: int, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
        """Weights and cuts, by so many steps of a size that adapts to each slope's mean and spread."""
        now = [np.zeros(n_features), np.r_[0.0, np.ones(self.n_grades - 2)]]
        mean, square = ([np.zeros_like(x) for x in now] for _ in range(2))
        for step in range(1, steps + 1):
            for x, m, v, d, rate in zip(now, mean, square, self.loss(*now)[1:], (RATE / 6, RATE / 3), strict=True):
                m += 0.1 * (d - m)
                v += 0.01 * (d * d - v)
                x -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            now[1][1:] = np.maximum(now[1][1:], 1e-3)  # thresholds stay in order
        return now[0], now[1]


def counted(texts: list[str], grades: list[int], n_grades: int) -> tuple[Sample, np.ndarray, np.ndarray]:
    """A sample, the places of its features, and what their values were divided by. Grades are weighted to equal shares."""
    index, value, row = [], [], []
    for i, t in enumerate(texts):
        data = np.frombuffer(t.encode(), np.uint8)
        for p, few in ((places(data) if len(data) > 2 else np.zeros(0, np.int64), FEW), (shapes(data, np.array([0, len(data)]))[0], FEW // 5)):
            k, c = np.unique(p, return_counts=True)
            index.append(k)
            value.append(c / (len(p) + few))
            row.append(np.full(len(k), i))
    index, value, row = (np.concatenate(x) for x in (index, value, row))
    used, column = np.unique(index, return_inverse=True)
    y = np.array(grades)
    share = np.bincount(y, minlength=n_grades)
    spread = np.sqrt(np.bincount(column, weights=value * value, minlength=len(used)) / len(texts)) + DAMP
    return Sample(row, column, value / spread[column], y, (1 / np.maximum(share, 1))[y] / (share > 0).sum(), n_grades), used, spread


def train(texts: list[str], grades: list[int], n_grades: int) -> Model:
    """Fit one vector of weights and n_grades - 1 ordered thresholds. Without two grades, all texts get the one there is."""
    if len(set(grades)) < 2:
        top = max(grades, default=n_grades - 1)
        return Model(np.zeros((1 << BITS) + SHAPES), np.array([-5.0 if k < top else 5.0 for k in range(n_grades - 1)]))
    sample, used, spread = counted(texts, grades, n_grades)
    w, cuts = sample.fitted(len(used))
    weights = np.zeros((1 << BITS) + SHAPES)
    weights[used] = w / spread
    return Model(weights, np.cumsum(cuts))


#: Grades that the labels give: 0 poor, 1 good. The regression takes any number of them.
N_GRADES = 2


def graded(labels: DataFrame) -> DataFrame:
    """(doc_id, grade): the labels' quality, and nothing else; of an id's several labels the least grade counts, labels with nulls don't."""
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").between(0, N_GRADES - 1))
    return rows.groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("grade"))


def fit(docs: DataFrame, grades: DataFrame, n_grades: int = N_GRADES, most: int = MOST, most_bytes: int = MOST_BYTES) -> Model:
    """Train on graded documents that aren't held out (crc32 of the id modulo 4 is 2): the ids of `most` of each grade at most, the first by a hash of the id, and most_bytes of their texts."""
    rows = grades.where(~held_out(F.col("doc_id")))
    some = None
    for g in range(n_grades):
        part = rows.where(F.col("grade") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
        some = part if some is None else some.unionByName(part)
    found = bounded_sample(docs, some, most_bytes)
    return train([r["t"] for r in found], [r["grade"] for r in found], n_grades)


def rate(docs: DataFrame, model: Model, least: int = 1, keep_from: float = 0.5, text: str = "text") -> DataFrame:
    """docs with expected_grade, tail_probability (of grade `least` or more), grade (the likeliest) and keep (tail_probability >= keep_from).

    Null and empty texts are placed at 0 on the line, and short ones near it; whole texts count, however long. Rows with
    equal texts get equal values. Columns of these names are replaced, others pass through.
    """

    def fn(batch: pa.RecordBatch) -> dict:
        tails = model.tails(*utf8(batch.column(text).cast(pa.string())))
        tail = tails[:, least - 1]
        each = -np.diff(np.c_[np.ones(len(tails)), tails, np.zeros(len(tails))], axis=1)
        return {"expected_grade": pa.array(tails.sum(1)), "tail_probability": pa.array(tail.copy()), "grade": pa.array(each.argmax(1).astype(np.int32)), "keep": pa.array(tail >= keep_from)}

    return map_batches(docs, fn, [T.StructField("expected_grade", T.DoubleType()), T.StructField("tail_probability", T.DoubleType()), T.StructField("grade", T.IntegerType()), T.StructField("keep", T.BooleanType())])


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, graded(table(spark, sf_dir, "labels")))
    return rate(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "expected_grade", "tail_probability", "grade", "keep")
