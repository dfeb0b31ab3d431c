"""Operator 1: best-fit packing by exact-complement hashing.

Every document's ids (with the end id) become pieces of at most ``capacity`` tokens; only longer documents are cut,
their first piece taking what is left over. Which pieces share a sequence depends on lengths alone, so the packing is
made on the histogram of lengths, which has ``capacity`` entries however many documents there are:

* an index from sums to single lengths, pairs and triples gives what fills a gap exactly; it is kept in step with the
  counts (a length that is used up leaves it), and a combination is used as many times as the counts allow;
* where nothing fills a gap exactly, the longest length that fits is placed (best fit) and the rest of the gap is
  looked up again.

A combination used t times is one row for each of its places: a range of ranks of that length, the first sequence and
the offset. Pieces are ranked within their length (in salted groups, so that one very common length is no single
group) and find their sequence by that range.

Defined cases: null text counts as empty (one piece holding the end id); repeated rows are packed each; ties in the
rank are broken by all other columns but the ids, so only equal rows can swap; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, materialize, slices, whole_text
from .tokens import byte_bpe

CAPACITY = 1024
END_ID = 2
#: Pieces in a salted group of one length: a share of all, but at least and at most so many, about.
RANKED_SHARE, RANKED_LEAST, RANKED_TOGETHER = 1000, 250, 100_000


class Complements:
    """Available lengths, and an index from a sum to the lengths, pairs and triples of lengths that make it.

    ``pairs[s, a]`` says that a length a and a length s - a (at least a) are there; ``triples[s, x]`` that a length x is
    there and some pair makes s - x. Entries go when the last piece of a length is used, so a look-up meets only what
    the counts allow; what the sequence under construction holds already is taken off there.
    """

    def __init__(self, counts: np.ndarray):
        self.counts = counts
        n = len(counts)
        sums, smaller = np.arange(n)[:, None], np.arange(n)[None, :]
        there = counts > 0
        there[0] = False
        other = sums - smaller
        self.pairs = (smaller <= other) & there[smaller] & there[np.maximum(other, 0)]
        self.made_by = self.pairs.sum(axis=1)  # pairs that make each sum
        self.triples = (other > 0) & there[smaller] & (self.made_by[np.maximum(other, 0)] > 0)

    def use(self, held: dict[int, int], times: int) -> None:
        """Take pieces away, and out of the index those lengths of which none is left."""
        for length, n in held.items():
            self.counts[length] -= n * times
            if self.counts[length] == 0:
                self._gone(length)

    def _gone(self, length: int) -> None:
        n = len(self.counts)
        partner = np.arange(1, n - length)
        sums, smaller = length + partner, np.minimum(length, partner)
        self.made_by[sums] -= self.pairs[sums, smaller]
        changed = sums[self.pairs[sums, smaller]]
        self.pairs[sums, smaller] = False
        self.triples[:, length] = False
        for s in changed[self.made_by[changed] == 0].tolist():  # no pair makes this sum any more
            first = np.arange(n - s)
            self.triples[s + first, first] = False

    def free(self, length: int | np.ndarray, held: dict[int, int]) -> np.ndarray:
        """How many pieces of the lengths the sequence under construction could still take."""
        free = self.counts[length].copy()
        for x, n in held.items():
            free = free - n * (length == x)
        return free

    def single(self, gap: int, held: dict[int, int]) -> tuple[int, ...] | None:
        return (gap,) if self.free(gap, held) > 0 else None

    def pair(self, gap: int, held: dict[int, int]) -> tuple[int, ...] | None:
        """The pair of lengths with this sum that can be used most often."""
        a = np.nonzero(self.pairs[gap])[0]
        if not len(a):
            return None
        uses = np.where(a == gap - a, self.free(a, held) // 2, np.minimum(self.free(a, held), self.free(gap - a, held)))
        best = int(uses.argmax())
        return (gap - int(a[best]), int(a[best])) if uses[best] > 0 else None

    def triple(self, gap: int, held: dict[int, int]) -> tuple[int, ...] | None:
        """A length, the longest first, and a pair that fills what it leaves."""
        for first in np.nonzero(self.triples[gap])[0][::-1].tolist():
            if self.free(first, held) > 0:
                rest = self.pair(gap - first, held | {first: held.get(first, 0) + 1})
                if rest:
                    return first, *rest
        return None

    def fill(self, gap: int, held: dict[int, int]) -> tuple[int, ...] | None:
        return self.single(gap, held) or self.pair(gap, held) or self.triple(gap, held)

    def longest(self, gap: int, held: dict[int, int]) -> tuple[int, ...] | None:
        """Best fit: the longest length that goes in."""
        fits = np.nonzero(self.free(np.arange(gap + 1), held) > 0)[0]
        return (int(fits[-1]),) if len(fits) and fits[-1] > 0 else None


def combinations(counts: np.ndarray) -> list[tuple[tuple[int, ...], int]]:
    """Combinations of lengths and how often each is used; ``counts[n]`` pieces have length n, capacity is the last n."""
    index = Complements(np.array(counts, dtype=np.int64))
    capacity, left, out = len(counts) - 1, index.counts, []
    for length in range(capacity, 0, -1):
        while left[length] > 0:
            items, gap = [length], capacity - length
            held = {length: 1}
            # best fit where nothing fills the gap exactly, then the rest of the gap again
            while gap and (found := index.fill(gap, held) or index.longest(gap, held)):
                for x in found:
                    items.append(x)
                    held[x] = held.get(x, 0) + 1
                    gap -= x
            times = int(min(left[x] // n for x, n in held.items()))
            index.use(held, times)
            out.append((tuple(items), times))
    return out


def places(counts: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, rank after the last, first sequence, offset); at most a few for each length."""
    rows, used, sequence = [], np.zeros(len(counts), np.int64), 0
    for items, times in combinations(counts):
        offset = 0
        for x in items:
            rows.append((x, int(used[x]), int(used[x]) + times, sequence, offset))
            used[x] += times
            offset += x
        sequence += times
    return rows


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: doc_id, piece, start, length, ids_crc32 and, on request, the ids (little-endian, 32 bits each)."""
    end = np.array([end_id], "<u4").tobytes()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe(path)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode(batch.column("text").to_pylist()), strict=True):
                ids += end
                n = len(ids) // 4
                bounds = [0, *range(n % capacity or capacity, n + 1, capacity)] if n > capacity else [0, n]
                for k, (a, b) in enumerate(zip(bounds, bounds[1:], strict=False)):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc_id, k, a, b - a, zlib.crc32(part)) + (part,) * with_ids)
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()][: 5 + with_ids]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names[: 5 + with_ids])

    return whole_text(docs).mapInArrow(cut, schema)


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give each row of ``cut`` (doc_id, piece, length and any others) a sequence_id and an offset. Reads it twice."""
    spark = cut.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for length, n in cut.groupBy("length").count().collect():  # as many rows as there are lengths
        counts[length] = n
    schema = "length long, rank_from long, rank_to long, sequence_from long, offset long"
    plan = spark.createDataFrame(places(counts), schema)
    together = min(RANKED_TOGETHER, max(RANKED_LEAST, int(counts.sum()) // RANKED_SHARE))
    groups = int(max(1, -(-counts.max() // together)))
    total = ["doc_id", "piece", *(c for c in cut.columns if c not in ("doc_id", "piece", "length", "ids"))]
    salted = cut.withColumn("salt", F.pmod(F.xxhash64(*total), F.lit(groups)).cast("int"))
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    first = salted.groupBy("length", "salt").count().select("length", "salt", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    order = Window.partitionBy("length", "salt").orderBy(*total)
    ranked = salted.withColumn("rank", F.row_number().over(order) - 1)
    if groups > 1:
        ranked = ranked.join(first, ["length", "salt"]).withColumn("rank", F.col("rank") + F.col("first")).drop("first")
    within = (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to"))
    on = [ranked["length"] == plan["length"], within]
    kept = [ranked[c] for c in cut.columns]
    # plan: a few rows for each of `capacity` lengths, whatever the input's size
    return ranked.join(F.broadcast(plan), on).select(*kept, (F.col("sequence_from") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), plan["offset"])


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents with their places. Texts are encoded once; the pieces are kept in the shared folder."""
    cut, _ = materialize(pieces(docs, path, capacity, end_id, with_ids), "pieces")
    return pack(cut, capacity)


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))
