"""Operator 6: toxicity by a character n-gram linear classifier scaled by naive Bayes log-count ratios.

Features are the 4- to 6-character n-grams of a text's distinct lower-case words (between blanks, so beginnings and
ends of words count as such), hashed; a feature's value is the number of distinct words that hold it. Each is scaled
by its naive Bayes log-count ratio between the toxic and the other training rows, and logistic regression is fitted
to the scaled values. Features whose ratio is small or that few rows have are left out.

Training takes a bounded sample of the labelled rows of the training folds: the ``SAMPLE`` ids with the smallest hash
(a few hundred kilobytes, joined by broadcast, so documents aren't shuffled). N-grams are made and counted by
the executors; the driver gets the counts (at most 2**BITS) and the sample's few kept features. Scoring reads every
whole text once.

Defined cases: null text counts as empty; an empty text gets the score of the intercept; a doc_id with several labels
is toxic if one says so, and null labels don't count; of rows repeated with one labelled doc_id the one with the smallest
hash of its text is learnt from, so the sample never has more rows than ids; without rows of both kinds there is nothing to tell apart and
every score is the share of toxic rows (0 without labels); repeated rows are rows of the result each; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chargrams import WordTable, grams
from .common import documents, fold, held, materialize, release, slices, whole_text

SIZES = (4, 5, 6)
BITS = 19
SAMPLE = 12_000
FOLDS = 5
#: Smoothing of counts, rows that must have a feature, least log-count ratio, weight penalty, steps and their length.
SMOOTHING, LEAST_ROWS, LEAST_RATIO, PENALTY, STEPS, RATE = 1.0, 5, 1.0, 0.03, 60, 0.05
WORDS = re.compile(r"\w+")


@dataclass
class Classifier:
    """``weights`` by hashed n-gram (naive Bayes ratio times fitted weight), and the intercept."""

    weights: np.ndarray
    intercept: float

    def rate(self, words: list[str]) -> np.ndarray:
        h, owner = grams(words, SIZES, BITS)
        return np.bincount(owner, weights=self.weights[h], minlength=len(words)) if words else np.zeros(0)

    def score(self, texts: list[str], table: WordTable) -> list[float]:
        found, rows = table.look_up([set(WORDS.findall(t.lower())) for t in texts])
        # fsum: the same for any order of the words
        return [sigmoid(self.intercept + math.fsum(rows[at].tolist())) for at in found]


def sigmoid(z: float) -> float:
    return 1 / (1 + math.exp(-z)) if z >= 0 else math.exp(z) / (1 + math.exp(z))


def features(text: str) -> tuple[np.ndarray, np.ndarray]:
    words = sorted(set(WORDS.findall(text.lower())))
    return np.unique(grams(words, SIZES, BITS)[0], return_counts=True) if words else (np.zeros(0, np.int64),) * 2


def flat(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The features of all rows of a batch, their values, and what ``column`` has beside each."""
    sizes = pc.list_value_length(batch.column("f")).to_numpy(zero_copy_only=False)
    f, n = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("f", "n"))
    return f, n, np.repeat(batch.column(column).to_numpy(zero_copy_only=False), sizes)


#: Rows of counts that a task hands on at once.
COUNTS = 1 << 16


def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's features: the sum of their values in toxic rows and in others, and the number of rows."""
    sums = np.zeros((3, 1 << BITS), np.int64)
    for batch in batches:
        f, n, label = flat(batch, "label")
        for total, weights in zip(sums, (n * label, n * (1 - label), None), strict=True):
            total += np.bincount(f, weights, 1 << BITS).astype(np.int64)
    used = np.nonzero(sums[2])[0]
    for at in range(0, len(used), COUNTS):
        part = used[at : at + COUNTS]
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), *(pa.array(total[part]) for total in sums)], ["f", "p", "q", "rows"])


def only(batches: Iterator[pa.RecordBatch], kept: np.ndarray) -> Iterator[pa.RecordBatch]:
    """doc_id, f and n of the features that are kept."""
    for batch in batches:
        f, n, ids = flat(batch, "doc_id")
        here = kept[f]
        yield pa.RecordBatch.from_arrays([pa.array(ids[here]), pa.array(f[here]), pa.array(n[here])], ["doc_id", "f", "n"])


def fit(labels: np.ndarray, row: np.ndarray, feature: np.ndarray, count: np.ndarray, ratio: np.ndarray) -> Classifier:
    """Logistic regression on the scaled values, by adaptive gradient steps over all rows."""
    used, column = np.unique(feature, return_inverse=True)
    x = (count * ratio[feature]).astype(np.float64)
    share = labels.mean()
    w, b = np.zeros(len(used)), math.log(share / (1 - share))
    past, past_b = np.full(len(used), 1e-8), 1e-8
    for _ in range(STEPS):
        z = b + np.bincount(row, weights=x * w[column], minlength=len(labels))
        off = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - labels) / len(labels)
        g = np.bincount(column, weights=x * off[row], minlength=len(used)) + PENALTY * w
        past += g * g
        w -= RATE * g / np.sqrt(past)
        past_b += off.sum() ** 2
        b -= RATE * off.sum() / math.sqrt(past_b)
    weights = np.zeros(len(ratio), np.float32)
    weights[used] = w * ratio[used]
    return Classifier(weights, b)


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE, folds: int = FOLDS) -> Classifier:
    """Fit on ``sample`` labelled rows at most, of folds other than 0."""
    marked = labels.select(F.col("doc_id").cast("long").alias("sample_id"), F.col(label).cast("int").alias("label")).dropna()
    chosen = marked.groupBy("sample_id").agg(F.max("label").alias("label")).filter(fold("sample_id", folds) != 0)
    chosen = chosen.orderBy(F.xxhash64("sample_id"), "sample_id").limit(sample)
    # `sample` ids at most, whatever the tables' size; of an id's rows one, chosen on the map side first
    rows = whole_text(docs).join(F.broadcast(chosen), F.col("doc_id") == F.col("sample_id")).select("doc_id", "text", "label")
    rows = rows.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("first")).select("doc_id", F.col("first.text").alias("text"), "label")

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            for i, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "label")), strict=True):
                f, n = features(text)
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([y], pa.int32()), pa.array([f.astype(np.int32)], pa.list_(pa.int32())), pa.array([n.astype(np.int32)], pa.list_(pa.int32()))], ["doc_id", "label", "f", "n"])

    spark = docs.sparkSession
    spread_rows, _ = materialize(rows.mapInArrow(spread, "doc_id long, label int, f array<int>, n array<int>"), "toxicity-sample")
    totals = {y: n for y, n in spread_rows.groupBy("label").count().collect()}
    if len(totals) < 2:
        return Classifier(np.zeros(1 << BITS, np.float32), {0: -1000.0, 1: 1000.0}.get(next(iter(totals), 0), -1000.0))
    counts = spread_rows.mapInArrow(count, "f int, p long, q long, rows long").groupBy("f").agg(*(F.sum(c).alias(c) for c in ("p", "q", "rows")))
    table = counts.filter(F.col("rows") >= LEAST_ROWS).toArrow().to_pandas()  # at most 2**BITS rows
    p, q, ratio = table["p"].to_numpy(float), table["q"].to_numpy(float), np.zeros(1 << BITS)
    size = 1 << BITS
    log = np.log((p + SMOOTHING) / (p.sum() + SMOOTHING * size)) - np.log((q + SMOOTHING) / (q.sum() + SMOOTHING * size))
    keep = np.abs(log) >= LEAST_RATIO
    ratio[table["f"].to_numpy()[keep]] = log[keep]
    shared = spark.sparkContext.broadcast(ratio != 0)
    small = spread_rows.mapInArrow(lambda batches: only(batches, shared.value), "doc_id long, f int, n int").toArrow().to_pandas()  # kept features of the sample's rows
    ids = spread_rows.select("doc_id", "label").toArrow().to_pandas()
    ids = ids.sort_values("doc_id").reset_index(drop=True)
    row = ids["doc_id"].searchsorted(small["doc_id"]).astype(np.int64)
    order = np.lexsort((small["f"].to_numpy(), row))
    return fit(ids["label"].to_numpy(float), row[order], small["f"].to_numpy(np.int64)[order], small["n"].to_numpy(float)[order], ratio)


def toxicity(docs: DataFrame, model: Classifier) -> DataFrame:
    """doc_id, score and predicted of every row."""
    name = uuid.uuid4().hex  # of this model's words in the workers
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = worker_table(name, model.rate)
        for batch in slices(batches):
            scores = model.score(batch.column("text").to_pylist(), table)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32())], ["doc_id", "score", "predicted"])

    return whole_text(docs).mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Classifier) -> DataFrame:
    """The rows of ``docs`` that the model doesn't call toxic, with all their columns; one pass, without a shuffle."""
    name = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        table = worker_table(name, model.rate)
        for batch in batches:
            for part in slices([pa.RecordBatch.from_arrays([batch.column(place), pa.array(np.arange(batch.num_rows))], ["text", "row"])]):
                clean = [s < 0.5 for s in model.score([t or "" for t in part.column("text").to_pylist()], table)]
                yield batch.slice(part.column("row")[0].as_py(), part.num_rows).filter(pa.array(clean))

    return docs.mapInArrow(run, docs.schema)


def worker_table(name: str, rate) -> WordTable:
    """A worker keeps the words of one model from task to task."""
    return held(("words", name), lambda: WordTable(rate))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    scored = toxicity(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored.select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "score", "predicted")
