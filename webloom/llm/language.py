"""Operator 7: language identification by multilingual mixture inference.

A language is a distribution over the hashed 1- to 4-character n-grams of words, counted over every training row. A
document is a mixture: each of its words comes from one of its languages. Expectation-maximisation estimates the
proportions from the words' n-gram likelihoods. The set of languages is chosen by penalised likelihood: starting from
all, the language with the smallest proportion goes as long as the log-likelihood falls by less than the penalty
for one language (half the log of the number of words, times ``STRICTNESS``). The prediction is the language with the
largest proportion, and its proportion is the score.

Counting sends one row for each task, language and n-gram hash to the shuffle; the model has at most 2**BITS numbers a
language. EM runs over a batch of documents at once, in numpy.

Defined cases: a null text, or one without a letter (Unicode categories L*; number signs are none), is `und` with score 0; without training rows every text is `und`;
ties go to the language whose name comes first; repeated rows are rows of the result each; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .chargrams import RATED, WordTable, grams
from .common import documents, fold, slices
from .toxicity import worker_table

SIZES = (1, 2, 3, 4)
BITS = 17
FOLDS = 5
SMOOTHING = 0.5
STEPS = 8
STRICTNESS = 4.0

#: Numbers that are no decimal digits (fractions, superscripts, Roman numerals); all lie below this code point.
_OTHER_NUMBERS = "".join(c for c in map(chr, range(0x20000)) if unicodedata.category(c) in ("No", "Nl"))
#: Runs of letters (Unicode categories L*): what is alphanumeric less the numbers.
WORDS = re.compile(rf"[^\W\d_{_OTHER_NUMBERS}]+")
#: Runs that may hold such numbers; a pattern that doesn't name them takes a sixth of the time.
_RUNS = re.compile(r"[^\W\d_]+")


def count_words(text: str) -> Counter:
    """How often each of the :data:`WORDS` is in the lower-cased text; only runs that aren't all letters are cut by that pattern."""
    counts = Counter(_RUNS.findall(text.lower()))
    for run in [r for r in counts if not r.isalpha()]:
        times = counts.pop(run)
        for word in WORDS.findall(run):
            counts[word] += times
    return counts


@dataclass
class Languages:
    names: list[str]
    logs: np.ndarray  # n-gram hash x language: log-likelihood

    def rate(self, words: list[str]) -> np.ndarray:
        h, owner = grams(words, SIZES, BITS)
        out = np.zeros((len(words), len(self.names)), np.float32)
        for k in range(len(self.names)):
            out[:, k] = np.bincount(owner, weights=self.logs[h, k], minlength=len(words)) if len(words) else 0
        return out


def mixtures(logs: np.ndarray, weight: np.ndarray, starts: np.ndarray, allowed: np.ndarray, steps: int = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihood of each document over its allowed languages.

    ``logs``: rows of words x languages, those of document d from ``starts[d]`` on; ``weight``: occurrences of a word.
    """
    sizes = np.diff(np.append(starts, len(logs)))
    peak = logs.max(axis=1, keepdims=True)
    likely = np.exp(logs - peak)
    total = np.add.reduceat(weight, starts)
    share = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        joint = likely * np.repeat(share, sizes, axis=0)
        joint *= (weight / np.maximum(joint.sum(axis=1), 1e-300))[:, None]
        share = np.add.reduceat(joint, starts, axis=0) / total[:, None]
    mixed = (likely * np.repeat(share, sizes, axis=0)).sum(axis=1)
    fit = np.add.reduceat(weight * (np.log(np.maximum(mixed, 1e-300)) + peak[:, 0]), starts)
    return share, fit


def choose(logs: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Proportions under the chosen set of languages, one row a document."""
    n, k = len(starts), logs.shape[1]
    allowed = np.ones((n, k), bool)
    share, fit = mixtures(logs, weight, starts, allowed)
    price = STRICTNESS * 0.5 * np.log(np.maximum(np.add.reduceat(weight, starts), 2))
    open_ = np.full(n, k > 1)
    sizes = np.diff(np.append(starts, len(logs)))
    while open_.any():
        at = np.nonzero(open_)[0]
        rows = np.repeat(open_, sizes)
        fewer = allowed[at].copy()
        # of equal proportions the last language goes first
        least = k - 1 - np.where(fewer, share[at], np.inf)[:, ::-1].argmin(axis=1)
        fewer[np.arange(len(at)), least] = False
        new_starts = np.concatenate([[0], np.cumsum(sizes[at])[:-1]])
        new_share, new_fit = mixtures(logs[rows], weight[rows], new_starts, fewer)
        better = new_fit >= fit[at] - price[at]
        done = at[better]
        allowed[done], share[done], fit[done] = fewer[better], new_share[better], new_fit[better]
        open_[at[~better]] = False
        open_ &= allowed.sum(axis=1) > 1
    return share


def train(docs: DataFrame, folds: int = FOLDS) -> Languages:
    """Count n-grams over all rows of folds other than 0 that have a language."""
    rows = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce("text", F.lit("")).alias("text")).filter(F.col("lang").isNotNull() & (fold("doc_id", folds) != 0))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(1 << BITS, np.int64))
        for batch in slices(batches, 2048, 8 << 20):
            words: dict[str, Counter] = defaultdict(Counter)
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                words[lang].update(count_words(text))
            for lang, counts in words.items():
                known, times = list(counts), np.fromiter(counts.values(), np.float64, len(counts))
                for a in range(0, len(known), RATED):
                    h, owner = grams(known[a : a + RATED], SIZES, BITS)
                    held[lang] += np.bincount(h, weights=times[a : a + RATED][owner], minlength=1 << BITS).astype(np.int64)
        for lang, n in held.items():
            at = np.nonzero(n)[0]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "gram", "n"])

    # at most 2**BITS rows a language
    table = rows.mapInArrow(count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    names = sorted(table["lang"].unique())
    counts = np.zeros((1 << BITS, len(names)))
    for k, name in enumerate(names):
        own = table[table["lang"] == name]
        counts[own["gram"].to_numpy(), k] = own["n"].to_numpy()
    return Languages(names, (np.log(counts + SMOOTHING) - np.log(counts.sum(axis=0) + SMOOTHING * len(counts))).astype(np.float32))


def identify_texts(model: Languages, texts: list[str | None], table: WordTable) -> tuple[list[str], list[float], list[list[tuple[str, float]]]]:
    """Prediction, score and the chosen languages with their proportions of each text."""
    counted = [count_words(t) if t else Counter() for t in texts]
    if not model.names:
        counted = [Counter()] * len(texts)
    some = [i for i, c in enumerate(counted) if c]
    preds, scores, mixes = ["und"] * len(texts), [0.0] * len(texts), [[] for _ in texts]
    if some:
        found, rows = table.look_up([list(counted[i]) for i in some])
        sizes = [len(f) for f in found]
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        weight = np.concatenate([np.fromiter(counted[i].values(), np.float64, len(counted[i])) for i in some])
        share = choose(rows[np.concatenate(found)].astype(np.float64), weight, starts)
        for i, s in zip(some, share, strict=True):
            best = int(s.argmax())
            preds[i], scores[i] = model.names[best], min(1.0, float(s[best]))
            mixes[i] = sorted(((model.names[k], float(s[k])) for k in np.nonzero(s > 0)[0]), key=lambda x: -x[1])
    return preds, scores, mixes


def identify(docs: DataFrame, model: Languages, mixture: bool = False) -> DataFrame:
    """doc_id, lang_pred, score of every row and, on request, the mixture as an array of (lang, share)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    name = uuid.uuid4().hex
    schema = "doc_id long, lang_pred string, score double" + ", mixture array<struct<lang: string, share: double>>" * mixture
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        table = worker_table(name, held.rate)
        for batch in slices(batches):
            preds, scores, mixes = identify_texts(held, batch.column("text").to_pylist(), table)
            columns = [batch.column("doc_id"), pa.array(preds, pa.string()), pa.array(scores, pa.float64())]
            if mixture:
                columns.append(pa.array([[{"lang": a, "share": b} for a, b in m] for m in mixes], kind))
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score", "mixture"][: len(columns)])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return identify(docs, train(docs)).select("doc_id", (fold("doc_id", FOLDS) == 0).alias("held_out"), "lang_pred", "score")
