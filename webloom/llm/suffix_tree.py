"""Operator 9: language-model scores by a probabilistic suffix tree, beside a unigram baseline.

Texts are lower-cased (A-Z) and cut into words at ASCII white space; an end token follows. The tree's symbols are these
tokens; contexts are the up to ``DEPTH`` tokens before a symbol, the beginning of the text (written as an end token)
included.

Tree. The root is the baseline's distribution, in which all unknown tokens are one symbol. A context of k tokens that
occurs twice or more is tested against the longest kept context that it ends in: with n(c) occurrences, n(c, w) of them
before w, r of them before symbols met only once there, and a shorter distribution P', its own is

    P(w | c) = (n(c, w) [if 2 or more] + (SHRINK + r) P'(w)) / (n(c) + SHRINK)

and it is kept if the log-likelihood ratio of its occurrences, P against P' (n(c) times their divergence, singly met
symbols counted at their discount), is ``LEAST_GAIN`` nats or more. So the tree grows with the corpus, by no share or
cap. A position is scored by the longest kept context before it.

Nothing of the tree is on the driver or held whole anywhere. A task deals its documents, whatever they hold, to buckets
of about ``BUCKET_TOKENS`` tokens, which are kept as numbers of their distinct tokens and these tokens' hashes. A bucket
asks once for each of its distinct tokens, then, length by length, once for each of its distinct contexts and n-grams:
questions carry the bucket's own training counts and go to parts by the context's hash; a part sums them over all
buckets, tests its contexts, and sends back verdicts and counts. An n-gram is asked for only where its parts, known by
then, occur twice or more. The next symbols of a very common context are spread over several parts; each sends its share
of the test, and the bucket adds them. Contexts and n-grams are named by 64-bit hashes with 32 bits for the symbol, so
counts may be too large where hashes collide; tokens are counted as they are.

Defined cases: null text counts as empty: the end token alone; with no training rows every count is 0 and no context is
kept; repeated rows are rows of the result each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, fold, materialize, slices, whole_text
from .dealt import END, PARCEL, PARCEL_ROWS, by_part, packed, part_of, unpacked, words

DEPTH = 2
#: By length of the context: weight of the shorter context's distribution, as a number of occurrences.
SHRINK = (200.0, 1.0)
#: A context is kept if its occurrences are so much likelier (in nats, all together) than under the shorter one.
LEAST_GAIN = 1.0
#: A verdict.
KEPT = 2.0**999
FOLDS, HELD_OUT = 7, 2
BUCKET_TOKENS = 2_000_000
#: By these the parts are sized: a part sums the tokens, or the n-grams, of so many questions, about.
PART_TOKENS, PART_GRAMS = 200_000, 2_000_000
#: Occurrences from which a context's next symbols are spread over several parts.
SPLIT = 200_000
#: Steps a power of ten in which a probability is handed to the part that tests a context.
STEPS = 16
#: Odd multipliers that mix hashes.
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
#: A question: of slices of contexts the hash (as differences), the occurrences and the number of n-grams; of n-grams the symbol, the training count and P' in steps.
QUESTION = ("<u8", "<i8", "<i4", "<u4", "<i4", "u1")
#: An answer: of slices the verdict or a share of the gain and the occurrences of n-grams met twice or more; of n-grams the count (0 if below 2).
ANSWER = ("<f8", "<i8", "<i8")
#: What is kept of a bucket: its tokens by number, the words of each text, and the hashes by number (as differences).
STATE = ("<u4", "<u4", "<u8")
#: Rows of questions and answers, and of what is kept of buckets (part -1).
MESSAGES = "part int, bucket long, data binary"
GATHERED = MESSAGES + ", doc_id array<long>, held array<boolean>, state binary"


# ---- counts ----


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    h = a * np.uint64(MIX[0]) + b * np.uint64(MIX[1])
    h ^= h >> np.uint64(29)
    h *= np.uint64(MIX[2])
    return h ^ h >> np.uint64(32)


def token_hash(token: bytes) -> int:
    return xxhash.xxh64_intdigest(token, 42)


def in_order(keys: np.ndarray, most: int) -> np.ndarray:
    """The stable order of keys of 0 to ``most``: a plain sort, which is several times faster, where a key and its place fit into 64 bits."""
    bits = len(keys).bit_length()
    if int(most).bit_length() + bits > 64:
        return np.argsort(keys, kind="stable")
    both = keys.astype(np.uint64)
    both <<= np.uint64(bits)
    both |= np.arange(len(keys), dtype=np.uint64)
    both.sort()
    both &= np.uint64((1 << bits) - 1)
    return both.view(np.int64)


def distinct(keys: np.ndarray, most: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct keys, a place of each, and which of them each key is; ``most``: the largest that a key can be, if that is known."""
    order = np.argsort(keys) if most is None else in_order(keys, most)
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    inverse = np.empty(len(keys), np.int32)
    inverse[order] = np.cumsum(new, dtype=np.int32) - 1
    return ordered[new], order[new], inverse


def in_steps(p: np.ndarray) -> np.ndarray:
    return np.clip(np.round(-STEPS * np.log10(p)), 0, 255).astype(np.uint8)


def tested(gain: np.ndarray, rest: np.ndarray, n: np.ndarray, shrink: float) -> np.ndarray:
    """Whether contexts are kept: by the gain of the n-grams met twice or more, and the occurrences before all others."""
    return gain + rest * np.log((shrink + rest) / (n + shrink)) >= LEAST_GAIN


def sum_grams(messages: list[bytes], shrink: float) -> list[bytes]:
    """Answers of a part to the questions of all buckets: counts are summed, and each slice's share of its context's gain."""
    got = [unpacked(m, *QUESTION) for m in messages]
    hashes = [np.cumsum(g[0], dtype=np.uint64) for g in got]
    slices_, place, slice_at = distinct(np.concatenate(hashes))
    total = np.concatenate([g[1] for g in got])[place]
    owner = np.repeat(slice_at, np.concatenate([g[2] for g in got]))
    symbol, n, steps = (np.concatenate([g[k] for g in got]) for k in (3, 4, 5))
    sizes = [(len(g[1]), len(g[3])) for g in got]
    del got
    grams, first, inverse = distinct(mixed(slices_[owner], symbol.astype(np.uint64)))
    n = np.bincount(inverse, weights=n, minlength=len(grams)).astype(np.int64)
    n[n < 2] = 0
    own, p = owner[first], 10.0 ** (-steps[first].astype(np.float64) / STEPS)
    gain = np.bincount(own, weights=n * np.log((n + shrink * p) / ((total[own] + shrink) * p)), minlength=len(slices_))
    often = np.bincount(own, weights=n, minlength=len(slices_)).astype(np.int64)
    # a context in one slice is tested here: the verdict is a number that no share of a gain comes near, and packs to nothing
    verdict = np.where(tested(gain, np.maximum(0, total - often), total, shrink), KEPT, -KEPT)
    gain = np.where(total < SPLIT, verdict, gain)
    out, s, g = [], 0, 0
    for n_slices, n_grams in sizes:
        mine = slice_at[s : s + n_slices]
        out.append(packed(gain[mine], often[mine], n[inverse[g : g + n_grams]]))
        s, g = s + n_slices, g + n_grams
    return out


# ---- buckets ----


@dataclass
class Level:
    """What is known of each position at one length of contexts: the n-gram that ends there (-1: none that occurs twice), and P."""

    gram: np.ndarray
    gram_hash: np.ndarray  # by n-gram
    gram_n: np.ndarray
    p: np.ndarray
    kept: int = 0


def gather(batches: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    """A task's documents as buckets: of each what is kept of it, and for each part of the tokens the distinct ones and
    how often they are in the bucket's training texts.
    """
    task, places, pack = TaskContext.get().partitionId(), itertools.count(), zstandard.ZstdCompressor(level=1).compress

    def bucket(ids: list, held: list, sizes: list, found: list, index: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        known = list(index)
        hashes = np.fromiter(map(token_hash, known), np.uint64, len(known))
        # in the order of the hash; the rare equal ones by the token
        order = np.argsort(hashes)
        if (hashes[order][1:] == hashes[order][:-1]).any():
            order = np.array(sorted(range(len(known)), key=lambda k: (int(hashes[k]), known[k])))
        hashes = hashes[order]
        place = np.empty(len(known), np.uint32)
        place[order] = np.arange(len(known))
        symbols, lengths = place[np.concatenate(found)], np.array(sizes, np.uint32)
        own = np.bincount(symbols[np.repeat(~np.array(held, bool), lengths)], minlength=len(known))
        own[place[0]] = len(held) - sum(held)  # the ends
        name = task << 32 | next(places)
        part, at = np.unique(part_of(hashes, parts), return_index=True)
        for k, a, b in zip(part.tolist(), at.tolist(), [*at[1:].tolist(), len(known)], strict=True):
            yield gathered(k, name, packed(np.frombuffer(pack(END.join([known[w] for w in order[a:b].tolist()])), np.uint8), own[a:b]))
        yield gathered(-1, name, None, ids, held, packed(symbols, lengths, np.diff(hashes, prepend=np.uint64(0))))

    def empty() -> tuple[list, list, list, list, dict[bytes, int]]:
        index: dict[bytes, int] = defaultdict(itertools.count().__next__)
        index[b""]  # the end
        return [], [], [], [], index

    now, tokens = empty(), 0
    for batch in slices(batches, PARCEL_ROWS, PARCEL):
        texts = [words(t) for t in batch.column("text").to_pylist()]
        ids, held, sizes, found, index = now
        ids += batch.column("doc_id").to_pylist()
        held += batch.column("held").to_pylist()
        sizes += map(len, texts)
        found.append(np.fromiter(map(index.__getitem__, itertools.chain.from_iterable(texts)), "<u4"))
        tokens += len(texts) + len(found[-1])
        if tokens >= BUCKET_TOKENS:
            yield from bucket(*now)
            now, tokens = empty(), 0
    if tokens:
        yield from bucket(*now)


def gathered(part: int, bucket: int, data: bytes | None, ids: list | None = None, held: list | None = None, state: bytes | None = None) -> pa.RecordBatch:
    types = {"part": pa.int32(), "bucket": pa.int64(), "data": pa.binary(), "doc_id": pa.list_(pa.int64()), "held": pa.list_(pa.bool_()), "state": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((part, bucket, data, ids, held, state), types.values(), strict=True)], list(types))


def messages(key: object, made: Iterator[tuple[int, bytes]]) -> pa.Table:
    """Rows (part, bucket, data) of a bucket's questions."""
    made = list(made)
    return pa.table({"part": pa.array([p for p, _ in made], pa.int32()), "bucket": pa.array([key] * len(made), pa.int64()), "data": pa.array([d for _, d in made], pa.binary())})


@dataclass
class Level:
    """What is known of each position at one length of contexts: the n-gram that ends there (-1: none that occurs twice), and P."""

    gram: np.ndarray
    gram_hash: Callable[[], np.ndarray]  # by n-gram
    gram_n: np.ndarray
    p: np.ndarray
    kept: int = 0


class Bucket:
    """The documents of a bucket as one row of symbols: each is its words' numbers between two of the end.

    Everything here follows from what is kept and the answers alone, so a question can be made again to read its answer.
    """

    def __init__(self, held: pa.Table, parts: int, gram_parts: int):
        self.parts, self.gram_parts = parts, gram_parts
        found, sizes, hashes = unpacked(held.column("state")[0].as_py(), *STATE)
        self.word_hash = np.cumsum(hashes, dtype=np.uint64)
        self.end = int(np.searchsorted(self.word_hash, np.uint64(token_hash(b""))))
        self.doc_ids = held.column("doc_id")[0].as_py()
        sizes = sizes.astype(np.int64) + 2
        self.ends = np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.symbols = np.full(int(sizes.sum()), self.end, np.int32)
        inner = np.ones(len(self.symbols), bool)
        inner[self.starts] = inner[self.ends - 1] = False
        self.symbols[inner] = found
        self.scored = np.ones(len(self.symbols), bool)
        self.scored[self.starts] = False
        self.training = np.repeat(~np.array(held.column("held")[0].as_py(), bool), sizes)

    def root(self, answers: dict[int, bytes], total: int, distinct: int) -> Level:
        """The baseline: the tokens' counts and probabilities."""
        self.counts = np.concatenate([unpacked(answers[part], "<i8")[0] for part in np.unique(part_of(self.word_hash, self.parts)).tolist()])
        p = (self.counts + 1) / (total + (distinct + 1))
        return Level(np.where(self.counts >= 2, np.arange(len(p), dtype=np.int32), np.int32(-1))[self.symbols], lambda: self.word_hash, self.counts, p[self.symbols])

    def question(self, lower: Level) -> Question:
        """What the bucket has to know of contexts one token longer than those of ``lower``."""
        here = np.full(len(self.symbols), -1, np.int32)
        here[1:] = lower.gram[:-1]
        at = np.nonzero(self.scored & (here >= 0))[0].astype(np.int32)
        here, known = here[at], lower.gram[at] >= 0
        words_ = len(self.word_hash)
        key = here[known] * np.int64(words_)
        key += self.symbols[at[known]]
        grams, first, inverse = distinct(key, len(lower.gram_n) * words_)
        del key
        there = np.zeros(len(lower.gram_n), bool)
        there[here] = True
        contexts, context_at = np.nonzero(there)[0], (np.cumsum(there, dtype=np.int32) - np.int32(1))[here]
        n = lower.gram_n[contexts]
        slices = 1 + n // SPLIT
        offset = np.cumsum(slices) - slices
        group_context = np.repeat(np.arange(len(contexts)), slices)
        piece = np.arange(len(group_context)) - offset[group_context]
        hashes = mixed(lower.gram_hash()[contexts[group_context]], piece.astype(np.uint64))
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        symbol = (self.word_hash >> np.uint64(32)).astype(np.uint32)[grams % words_]
        owner = np.searchsorted(contexts, grams // words_)
        if len(order) == len(contexts):  # n-grams lie by context: they are moved as blocks
            lens = np.bincount(owner, minlength=len(contexts))
            begin, lens = (np.cumsum(lens) - lens)[order], lens[order]
            by_group = np.repeat(begin - (np.cumsum(lens) - lens), lens) + np.arange(len(grams))
        else:
            group = rank[offset[owner] + symbol % slices[owner]]
            by_group = in_order(group, len(order))
            lens = np.bincount(group, minlength=len(order))
        return Question(self, lower, at, contexts, context_at, known, inverse, group_context[order], hashes[order], n, lens, by_group, symbol, first, owner)


@dataclass
class Question:
    """Contexts (in slices, sorted by hash) and n-grams (by slice) that a bucket asks for."""

    bucket: Bucket
    lower: Level
    at: np.ndarray  # positions that have a context
    contexts: np.ndarray  # n-grams of the level below
    context_at: np.ndarray  # which of them, by position
    known: np.ndarray  # whether their symbol may be known there
    inverse: np.ndarray  # n-gram of those positions
    context: np.ndarray  # by slice
    hashes: np.ndarray
    n: np.ndarray  # by context
    sizes: np.ndarray  # n-grams of a slice
    by_group: np.ndarray  # n-grams in the slices' order
    symbol: np.ndarray  # by n-gram
    first: np.ndarray  # a place among the positions whose symbol may be known
    owner: np.ndarray  # context of an n-gram

    def cuts(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Parts, and where the slices and n-grams of each begin."""
        parts, slices = np.unique(part_of(self.hashes, self.bucket.gram_parts), return_index=True)
        slices = np.append(slices, len(self.hashes))
        return parts, slices, np.concatenate([[0], np.cumsum(self.sizes)])[slices]

    def messages(self) -> Iterator[tuple[int, bytes]]:
        places = self.at[self.known]
        count = np.bincount(self.inverse[self.bucket.training[places]], minlength=len(self.owner)).astype(np.int32)
        steps = in_steps(self.lower.p[places[self.first]])
        parts, s, g = self.cuts()
        for k, part in enumerate(parts.tolist()):
            mine, grams = slice(s[k], s[k + 1]), self.by_group[g[k] : g[k + 1]]
            yield part, packed(np.diff(self.hashes[mine], prepend=np.uint64(0)), self.n[self.context[mine]], self.sizes[mine].astype(np.int32), self.symbol[grams], count[grams], steps[grams])

    def answered(self, answers: dict[int, bytes], shrink: float) -> Level:
        """The level of these contexts, from the answers of all parts."""
        got = [unpacked(answers[part], *ANSWER) for part in self.cuts()[0].tolist()]
        gain, often, n = (np.concatenate([np.zeros(0, t), *(g[k] for g in got)]) for k, t in enumerate(ANSWER))
        del got
        n_contexts = len(self.n)
        gains = np.bincount(self.context, weights=gain, minlength=n_contexts)  # of all slices
        rest = np.maximum(0, self.n - np.bincount(self.context, weights=often, minlength=n_contexts))
        kept = np.where(np.abs(gains) == KEPT, gains > 0, tested(gains, rest, self.n, shrink))
        gram_n = np.zeros(len(n), np.int64)
        gram_n[self.by_group] = n
        p = self.lower.p.copy()
        met = np.zeros(len(self.at))
        met[self.known] = gram_n[self.inverse]
        # a context that isn't kept leaves P as it is
        c = self.context_at
        changed = np.nonzero(kept[c])[0]
        c, place = c[changed], self.at[changed]
        p[place] = (met[changed] + (shrink + rest)[c] * p[place]) / (self.n + shrink)[c]
        gram = np.full(len(p), -1, np.int32)
        gram[self.at[self.known]] = np.where(gram_n >= 2, np.arange(len(gram_n), dtype=np.int32), np.int32(-1))[self.inverse]
        lower, above, symbol = self.lower.gram_hash, self.contexts[self.owner], self.symbol
        return Level(gram, lambda: mixed(lower()[above], symbol.astype(np.uint64)), gram_n, p, int(kept.sum()))


# ---- scores ----


def lm_scores(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT, depth: int = DEPTH, shrink: tuple[float, ...] = SHRINK) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; ``shrink`` has a weight for each length of contexts."""
    rows = whole_text(docs).select("doc_id", (fold("doc_id", folds) == held_out).alias("held"), "text")
    size = (rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0) // 6  # tokens, about
    parts, gram_parts = 1 + size // (10 * PART_TOKENS), 1 + size // PART_GRAMS
    stored, _ = materialize(rows.mapInArrow(lambda batches: gather(batches, parts), GATHERED), "buckets")
    buckets = max(1, stored.filter("part < 0").count())
    dealt = stored.filter("part < 0").select("bucket", "doc_id", "held", "state").repartition(buckets, "bucket")

    def count_tokens(key: tuple, table: pa.Table) -> pa.Table:
        """Counts over all buckets, and one row more with the part's occurrences and known tokens."""
        total: dict[bytes, int] = defaultdict(int)
        asked = []
        for data in table.column("data").to_pylist():
            joined, own = unpacked(data, "u1", "<i8")
            asked.append(zstandard.ZstdDecompressor().decompress(joined.tobytes()).split(END))
            for word, n in zip(asked[-1], own.tolist(), strict=True):
                total[word] += n
        found = [packed(np.fromiter(map(total.__getitem__, words_), "<i8", len(words_))) for words_ in asked]
        none = [None] * len(found)
        columns = [[*table.column("part").to_pylist(), key[0].as_py()], [*table.column("bucket").to_pylist(), -1], [*found, None], [*none, sum(total.values())], [*none, sum(n > 0 for n in total.values())]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()], strict=True)], ["part", "bucket", "data", "n", "v"])

    asked = stored.filter("part >= 0").select("part", "bucket", "data")
    counted, _ = materialize(asked.groupBy("part").applyInArrow(count_tokens, MESSAGES + ", n long, v long"), "answers-0")
    n, v = counted.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("v"), F.lit(0))).first()
    floor = math.log10(n + (v + 1))

    def level(bucket: Bucket, right: pa.Table, k: int) -> Level:
        """What answers say of contexts of up to k tokens."""
        of = [by_part(right.filter(pc.equal(right.column("level"), j))) for j in range(k + 1)]
        found = bucket.root(of[0], n, v)
        for j in range(1, k + 1):
            found = bucket.question(found).answered(of[j], shrink[j - 1])
        return found

    def asker(k: int):
        def ask(left: pa.Table, right: pa.Table) -> pa.Table:
            bucket = Bucket(left, parts, gram_parts)
            return messages(left.column("bucket")[0].as_py(), bucket.question(level(bucket, right, k - 1)).messages())

        return ask

    def summer(k: int):
        def sums(key: tuple, table: pa.Table) -> pa.Table:
            return pa.table([table.column("part"), table.column("bucket"), pa.array(sum_grams(table.column("data").to_pylist(), shrink[k - 1]), pa.binary())], ["part", "bucket", "data"])

        return sums

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = Bucket(left, parts, gram_parts)
        p = np.log10(level(bucket, right, depth).p)
        known = bucket.counts[bucket.symbols] > 0
        base = np.log10(bucket.counts + 1.0)[bucket.symbols]
        spans = list(zip((bucket.starts + 1).tolist(), bucket.ends.tolist(), strict=True))
        n_known = np.diff(np.concatenate([[0], np.cumsum(known & bucket.scored)])[np.append(bucket.starts, len(known))])
        columns = [bucket.doc_ids, [b - a for a, b in spans], n_known, [math.fsum(base[a:b].tolist()) - (b - a) * floor for a, b in spans], [math.fsum(p[a:b].tolist()) for a, b in spans]]
        return pa.table([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.float64()] * 2, strict=True)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    def with_answers(answers: list[DataFrame]):
        return dealt.groupBy("bucket").cogroup(reduce(DataFrame.unionByName, answers).repartition(buckets, "bucket").groupBy("bucket"))

    def stored_level(df: DataFrame, k: int) -> DataFrame:
        """The answers are kept, since all later levels read them; the questions go with the shuffles that carried them."""
        return materialize(df, f"answers-{k}")[0].withColumn("level", F.lit(k))

    answers = [counted.filter("bucket >= 0").select("part", "bucket", "data", F.lit(0).alias("level"))]
    for k in range(1, depth + 1):
        asked = with_answers(answers).applyInArrow(asker(k), MESSAGES)
        answers.append(stored_level(asked.groupBy("part").applyInArrow(summer(k), MESSAGES), k))
    scored = with_answers(answers).applyInArrow(score, "doc_id long, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", (fold("doc_id", folds) == held_out).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op9_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(documents(spark, sf_dir))
