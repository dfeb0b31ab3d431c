"""Operator 5: SimHash near-duplicates by Golay-code fuzzy hashing.

A document's fingerprint has bit b set when more than half of its shingles' XXH64 hashes have it. Fingerprints link
at ``MAX_BITS`` = 3 or fewer differing bits; the result is the connected components of those links.

Candidates. The 64 bits make three segments of 22, 21 and 21 bits, each read as a word of the binary Golay code
[23, 12, 7]. Every 23-bit word lies within 3 bits of exactly one codeword, and two words one bit apart share the
codeword of either among the (at most 6) codewords within 4 bits of the other. Three errors over three segments leave
two segments with at most one error each (pigeonhole), so two linked fingerprints agree on a key of two codeword
indices for at least one of the three pairs of segments. Each fingerprint gives one *home* key a pair (its own
codewords) and up to 36 *near* keys; a home key that equals a near key makes a candidate, which is verified on all
64 bits. One fingerprint's home keys are among its near keys, so a bucket holds each fingerprint once.

Size. Only distinct fingerprints are keyed, so copies cost nothing. A bucket gives the edges of a spanning forest of
its links, never all pairs. A bucket of over ``TILE`` fingerprints isn't held by one task: its rows are cut into tiles
and each pair of tiles is compared by a task of its own, which is exact. Components come from rounds of large-star and
small-star over the distinct fingerprints, each round's table written to the shared folder.

Near copies of texts by a similarity of their shingles are in :mod:`webloom.llm.near_copies`, which starts from these links.

Defined cases: null text counts as empty; texts without words have fingerprint 0 and link like any other; with fewer
words than a shingle holds, the whole sequence is one shingle; rows repeated are rows of the result each; a
null doc_id gets a row, but names no component unless the component has no other; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, remove, slices, whole_text

SHINGLE = 3
MAX_BITS = 3
SEED = 42
#: Fixed value: the generator x^11+x^9+x^7+x^6+x^5+x+1 of the Golay code.
GENERATOR = 0b101011100011
#: Bits of the segments, lowest first.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
TILE = 2048
#: Hashes counted at once.
COUNTED = 1 << 16


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    # of bytes, lower touches A-Z alone and split cuts at [\x20\x09-\x0D]
    words = text.encode().lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    h = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for a in range(0, n, COUNTED):
        part = words[a : min(n, a + COUNTED) + shingle - 1]
        grams = [b" ".join(g) for g in zip(*(part[k:] for k in range(shingle)), strict=False)] if len(words) >= shingle else [b" ".join(words)]
        hashes = np.fromiter([h(g, SEED) for g in grams], np.uint64, len(grams))
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, the text's length n and hash, and fp, the fingerprint as a signed 64-bit integer."""

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 4096, 16 << 20):
            fps = np.fromiter((fingerprint(t, shingle) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n"), batch.column("hash"), pa.array(fps.view(np.int64))], ["doc_id", "n", "hash", "fp"])

    rows = whole_text(docs).select("doc_id", "text", F.length("text").alias("n"), F.xxhash64("text").alias("hash"))
    return rows.mapInArrow(compute, "doc_id long, n int, hash long, fp long")


def _syndromes(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials on division by the generator."""
    rest = words.copy()
    for bit in range(22, 10, -1):
        rest ^= np.where(rest >> bit & 1, GENERATOR << (bit - 11), 0)
    return rest


def _patterns() -> np.ndarray:
    """For each syndrome the error patterns of at most 4 bits that have it: the lightest first, unused places are -1."""
    one = _syndromes(1 << np.arange(23, dtype=np.int64))
    bits = 1 << np.arange(23, dtype=np.int64)
    found: list[list[int]] = [[] for _ in range(2048)]
    from itertools import combinations

    for weight in range(5):
        for chosen in combinations(range(23), weight):
            s = 0
            for c in chosen:
                s ^= int(one[c])
            if weight < 4 or found[s][0].bit_count() == 3:
                found[s].append(sum(int(bits[c]) for c in chosen))
    table = np.full((2048, 6), -1, np.int64)
    for s, patterns in enumerate(found):
        table[s, : len(patterns)] = patterns
    return table


_TABLE: list[np.ndarray] = []


def codewords(words: np.ndarray) -> np.ndarray:
    """Indices (12 bits) of the codewords near each 23-bit word: its own first, then those at 4 bits; -1 fills up."""
    if not _TABLE:
        _TABLE.append(_patterns())
    patterns = _TABLE[0][_syndromes(words)]
    return np.where(patterns < 0, -1, (words[:, None] ^ patterns) >> 11)


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, position in ``fps`` and home flag of every key of the fingerprints."""
    unsigned = fps.view(np.uint64)
    near = [codewords(((unsigned >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.int64)) for at, n in SEGMENTS]
    out = []
    for pair, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        key = (near[a][:, :, None] << 12 | near[b][:, None, :]) | pair << 24
        valid = (near[a][:, :, None] >= 0) & (near[b][:, None, :] >= 0)
        row, x, y = np.nonzero(valid)
        out.append((key[row, x, y], row, (x == 0) & (y == 0)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def forest(fps: np.ndarray, nodes: np.ndarray, first: int | None = None, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Edges that connect what the links among ``fps`` connect, the closest pairs first; one less than nodes at most.

    With ``first``, only links between the first so many and the rest count. ``nodes`` names the rows.
    """
    bits = fps.view(np.uint64)
    if first is None and len(fps) <= 512:  # most buckets hold no link at all
        close = np.bitwise_count(bits[:, None] ^ bits) <= max_bits
        np.fill_diagonal(close, False)
        some = close.any(axis=1)
        if not some.any():
            return []
        fps, bits, nodes = fps[some], bits[some], nodes[some]
    label, edges = np.arange(len(fps)), []
    for most in sorted({*range(MAX_BITS, max_bits, 3), max_bits}):
        for i in range(len(fps) if first is None else first):
            start = max(i + 1, first or 0)
            linked = np.nonzero(np.bitwise_count(bits[start:] ^ bits[i]) <= most)[0] + start
            if not len(linked):
                continue
            other, at = np.unique(label[linked], return_index=True)
            new = other != label[i]
            if new.any():
                edges += [(int(nodes[i]), int(nodes[j])) for j in linked[at[new]].tolist()]
                joined = np.append(other[new], label[i])
                label[np.isin(label, joined)] = joined.min()
                if len(edges) == len(fps) - 1:
                    return edges
    return edges


def links(nodes: DataFrame, max_bits: int = MAX_BITS, tile: int = TILE) -> DataFrame:
    """Edges u, v between rows (node, fps) some of whose fingerprints share a key and differ in ``max_bits`` at most.

    They connect what all such pairs connect: pairs within 3 bits share a key that is home for one of them, so buckets
    without a home key are passed over.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):
                part = batch.slice(a, 2048)
                node = part.column("node").to_numpy(zero_copy_only=False)
                tables = part.column("fps").flatten().to_numpy(zero_copy_only=False).reshape(len(node), -1)
                for q in range(tables.shape[1]):
                    fps = np.ascontiguousarray(tables[:, q])
                    key, row, home = keys(fps)
                    key += 3 * q << 24
                    yield pa.RecordBatch.from_arrays([pa.array(key.astype(np.int32)), pa.array(fps[row]), pa.array(node[row]), pa.array(home)], ["key", "fp", "node", "home"])

    names = ["u", "v", "fp", "key", "tile", "tiles"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()]

    def rows(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)], names)

    def of_tile(key: int, node: np.ndarray, fp: np.ndarray, number: int) -> list[tuple]:
        return [(n, None, f, key, number, None) for n, f in zip(node.tolist(), fp.tolist(), strict=True)]

    def small(key: np.ndarray, fp: np.ndarray, node: np.ndarray, home: np.ndarray) -> list[tuple]:
        """Edges of whole buckets; one with a single row has no candidate."""
        if not len(key):
            return []
        at = np.nonzero(np.concatenate([[True], key[1:] != key[:-1]]))[0]
        sizes = np.diff(np.concatenate([at, [len(key)]]))
        live = (sizes > 1) & (np.add.reduceat(home.astype(np.int64), at) > 0)
        two = at[live & (sizes == 2)]
        close = two[np.bitwise_count(fp[two].view(np.uint64) ^ fp[two + 1].view(np.uint64)) <= max_bits]
        out = list(zip(node[close].tolist(), node[close + 1].tolist(), strict=True))
        for s, n in zip(at[live & (sizes > 2)].tolist(), sizes[live & (sizes > 2)].tolist(), strict=True):
            out += forest(fp[s : s + n], node[s : s + n], max_bits=max_bits)
        return [(u, v, None, None, None, None) for u, v in out]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by key and node, so that buckets of one group choose the same edges. Small buckets give edges; rows of a large one come out with their tile, and a row that counts the tiles."""
        held = [np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)]
        passed = 0  # tiles of the held key that have gone out
        for batch in batches:
            key, fp, node, home = (np.concatenate([h, batch.column(c).to_numpy(zero_copy_only=False)]) for h, c in zip(held, ("key", "fp", "node", "home"), strict=True))
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1], "left"))
            if passed and last > 0:  # the held large bucket ends in this batch
                end = int(np.searchsorted(key, key[0], "right"))
                yield rows([*of_tile(int(key[0]), node[:end], fp[:end], passed), (None, None, None, int(key[0]), None, passed + 1)])
                key, fp, node, home, last, passed = key[end:], fp[end:], node[end:], home[end:], last - end, 0
            # a large bucket may also lie whole within the batch
            at = np.nonzero(np.concatenate([[True], key[1:last] != key[: last - 1]]))[0] if last else np.zeros(0, np.int64)
            sizes = np.diff(np.concatenate([at, [last]]))
            keep = np.ones(last, bool)
            for s, n in zip(at[sizes > tile].tolist(), sizes[sizes > tile].tolist(), strict=True):
                keep[s : s + n] = False
                for k in range(-(-n // tile)):
                    a, b = s + k * tile, s + min(n, (k + 1) * tile)
                    yield rows(of_tile(int(key[s]), node[a:b], fp[a:b], k))
                yield rows([(None, None, None, int(key[s]), None, -(-n // tile))])
            if found := small(key[:last][keep], fp[:last][keep], node[:last][keep], home[:last][keep]):
                yield rows(found)
            key, fp, node, home = key[last:], fp[last:], node[last:], home[last:]
            while len(key) > tile:  # of the last bucket only what its last tile needs is held
                yield rows(of_tile(int(key[0]), node[:tile], fp[:tile], passed))
                key, fp, node, home, passed = key[tile:], fp[tile:], node[tile:], home[tile:], passed + 1
            held = [key, fp, node, home]
        if passed:
            yield rows([*of_tile(int(held[0][0]), held[2], held[1], passed), (None, None, None, int(held[0][0]), None, passed + 1)])
        elif found := small(*held):
            yield rows(found)

    def tiles(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b = int(pdf["a"].iloc[0]), int(pdf["b"].iloc[0])
        pdf = pdf.sort_values("tile", kind="stable")
        first = None if a == b else int((pdf["tile"] == a).sum())
        found = forest(pdf["fp"].to_numpy(np.int64), pdf["u"].to_numpy(np.int64), first, max_bits)
        return pd.DataFrame(found, columns=["u", "v"]).astype("int64")

    spread_keys = nodes.select("node", "fps").mapInArrow(spread, "key int, fp long, node long, home boolean")
    compared, _ = materialize(
        spread_keys.repartition("key").sortWithinPartitions("key", "node").mapInArrow(compare, "u long, v long, fp long, key int, tile int, tiles int"), "simhash-links"
    )
    found = compared.filter("v IS NOT NULL").select("u", "v")
    large, counts = compared.filter("tile IS NOT NULL").select("u", "fp", "key", "tile"), compared.filter("tiles IS NOT NULL").select("key", "tiles")
    if not counts.isEmpty():
        other = F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))
        paired = large.join(counts, "key").withColumn("other", other).select("u", "fp", "tile", "key", F.least("tile", "other").alias("a"), F.greatest("tile", "other").alias("b"))
        found = found.union(paired.groupBy("key", "a", "b").applyInPandas(tiles, "u long, v long"))
    return found.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def components(edges: DataFrame, label: str = "components", rows: int | None = None) -> DataFrame:
    """node and root (the smallest node of its component) for every node of ``edges`` (u, v); rounds of large-star and small-star.

    ``rows``: at least as many as ``edges`` has, if known; a round never has more edges than the one before.
    """
    spark = edges.sparkSession
    table, path = materialize(edges.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).filter("u <> v"), label, rows)
    while True:
        # large-star: every neighbour above a node is hung on the least of the node and its neighbours
        both = table.union(table.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("u"), "v").distinct()
        # small-star: the neighbours below a node, and the node, are hung on the least of them
        lowest = large.groupBy("v").agg(F.min("u").alias("m"))
        small = large.join(lowest, "v")
        nxt = small.select(F.col("m").alias("u"), "v").union(small.filter("u <> m").select(F.col("m").alias("u"), F.col("u").alias("v"))).distinct()
        nxt, nxt_path = materialize(nxt, label, rows)
        # done when every edge hangs a node that hangs nothing on its only parent
        parents = nxt.groupBy("v").agg(F.count("*").alias("n"))
        inner = nxt.select(F.col("u").alias("v")).distinct().join(nxt.select("v"), "v", "left_semi").isEmpty()
        done = inner and parents.filter("n > 1").isEmpty()
        remove(spark, path)
        table, path = nxt, nxt_path
        if done:
            return table.select(F.col("v").alias("node"), F.col("u").alias("root"))


def classes(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, n, hash, fp, root (the component's smallest fingerprint) and component_id of every row."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the keys find links of up to 3 bits")
    fps, _ = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct, _ = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "distinct-fingerprints")
    edges, _ = materialize(links(distinct.select(F.col("fp").alias("node"), F.array("fp").alias("fps")), max_bits), "simhash-edges")
    roots = components(edges, rows=edges.count())
    rooted = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    named = rooted.join(least, "root").select(F.col("fp").alias("class_fp"), "root", "component_id")
    return fps.join(named, fps["fp"] == named["class_fp"]).drop("class_fp")


def simhash_components(docs: DataFrame, shingle: int = SHINGLE, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint and component_id of every row."""
    return classes(docs, shingle, max_bits).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(documents(spark, sf_dir))
