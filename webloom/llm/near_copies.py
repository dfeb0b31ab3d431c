"""Near copies by SimHash: texts whose sets of five-word shingles have a similarity of 0.8 or more.

Candidates come from two sources, and every one of them is decided on the whole sets of 64-bit shingle hashes:

* SimHash: fingerprints of the distinct shingles that differ in 3 bits or fewer, found by the Golay keys of
  :mod:`webloom.llm.simhash`. They connect most close copies at once.
* A prefix filter, because fingerprints promise nothing at 0.8: in any one order of all shingles such a pair shares one
  among the first fifth of either, so no pair is missed. The order is by the number of texts that hold a shingle, counted
  over all texts, rare ones first; shingles of one text alone are no keys. What many texts share comes last, so
  passages that many documents quote are keys only of texts that are hardly more than such passages.

Only verified pairs connect, and pairs that are connected already aren't compared. First the fingerprints' links and
each key's neighbours (in an order of its own) are verified. Of what is then left, the rows of a key that could still be
similar to one of another component (by sizes and by the places of the key) are compared in numpy, in groups of bounded
size: a key of over ``TILE`` rows is cut into tiles, and each pair of tiles is a group. A group gives a spanning forest.

Counting. Texts are dealt in parcels to buckets; a bucket asks once for each of its distinct shingles how many texts hold
it (48 bits of the hash; where those collide a shingle looks more common than it is, alike for all texts).

Defined cases: as for :mod:`webloom.llm.simhash`; a text without words is similar to none; texts that differ in case or
white space alone are similar.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, whole_text
from .dealt import MESSAGES, by_part, deal, lines, messages, packed, part_of, unpacked
from .simhash import COUNTED, SEED, components, links

SHINGLE, SIMILARITY = 5, 0.8
#: What rounding may take from a bound.
SLACK = 1e-6
#: Characters of a bucket, shingles that one part counts, bits that are cut off there.
BUCKET, PART, CUT = 12_000_000, 4_000_000, 16
#: Rows of a key that one group compares; rows of small keys that share a group; rows of a key that one window orders.
TILE, GROUPED, ORDERED = 2048, 20_000, 100_000


def shingle_set(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """Hashes of the distinct shingles, sorted; none without words."""
    h, found = xxhash.xxh64_intdigest, [np.zeros(0, np.uint64)]
    for a in range(0, max(1, len(words) - shingle + 1) if words else 0, COUNTED):
        part = words[a : a + COUNTED + shingle - 1]
        grams = {b" ".join(g) for g in zip(*(part[k:] for k in range(shingle)), strict=False)} if len(words) >= shingle else {b" ".join(words)}
        found.append(np.fromiter([h(g, SEED) for g in grams], np.uint64, len(grams)))
    return np.unique(np.concatenate(found))


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if set in over half of the hashes; as a signed integer."""
    counts = np.zeros(64, np.int64)
    for a in range(0, len(hashes), COUNTED):
        counts += np.unpackbits(hashes[a : a + COUNTED].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), "little", signed=True)


def prefix(hashes: np.ndarray, often: np.ndarray, least: float = SIMILARITY) -> np.ndarray:
    """Places of the hashes that come first in the order of how often they are, then of the hash.

    Two sets of similarity ``least`` share at least that part of either, so they can't miss each other in the rest.
    """
    n = len(hashes)
    return np.lexsort((hashes, often))[: n - math.ceil(least * n - SLACK) + 1] if n else np.zeros(0, np.int64)


def _parts_of(cut: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of sorted cut hashes, and where each begins."""
    found, at = np.unique(part_of(cut << np.uint64(CUT), parts), return_index=True)
    return found, np.append(at, len(cut))


def shared_shingles(rows: DataFrame, least: float) -> DataFrame:
    """node, size, fp, keys, places and shingles of each text with a shingle in its prefix that another text holds too.

    ``rows``: node, text. ``places`` are those of the keys in the text's order.
    """
    total = rows.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    buckets, parts = 1 + total // BUCKET, 1 + total // (5 * PART)
    dealt = deal(rows, buckets)

    def ask(key: tuple, table: pa.Table) -> pa.Table:
        cut, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *(shingle_set(w) for w in lines(table))]) >> np.uint64(CUT), return_counts=True)
        found, at = _parts_of(cut, parts)
        return messages(key[0].as_py(), ((p, packed(np.diff(cut[a:b], prepend=np.uint64(0)), n[a:b].astype(np.int32))) for p, a, b in zip(found.tolist(), at, at[1:], strict=False)))

    def count(key: tuple, table: pa.Table) -> pa.Table:
        got = [unpacked(d, "<u8", "<i4") for d in table.column("data").to_pylist()]
        cut = [np.cumsum(steps, dtype=np.uint64) for steps, _ in got]
        _, inverse = np.unique(np.concatenate(cut), return_inverse=True)
        n = np.bincount(inverse, weights=np.concatenate([n for _, n in got])).astype(np.int64)[inverse]
        ends = np.cumsum([len(c) for c in cut])
        data = [packed(n[e - len(c) : e]) for e, c in zip(ends, cut, strict=True)]
        return pa.table({"part": table.column("part"), "bucket": table.column("bucket"), "data": pa.array(data, pa.binary())})

    kind = pa.schema([("node", pa.binary()), ("size", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("shingles", pa.list_(pa.int64()))])

    def choose(left: pa.Table, right: pa.Table) -> pa.Table:
        sets, answers, out = [shingle_set(w) for w in lines(left)], by_part(right), []
        cut, inverse = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]) >> np.uint64(CUT), return_inverse=True)
        often = np.concatenate([np.zeros(0, np.int64), *(unpacked(answers[p], "<i8")[0] for p in _parts_of(cut, parts)[0].tolist())])[inverse]
        nodes, end = [n for ns in left.column("node").to_pylist() for n in ns], 0
        for node, own in zip(nodes, sets, strict=True):
            end += len(own)
            n = often[end - len(own) : end]
            first = prefix(own, n, least)
            places = np.nonzero(n[first] > 1)[0]
            if len(places):
                out.append((node, len(own), fingerprint(own), own[first[places]].view(np.int64), places.astype(np.int32), own.view(np.int64)))
        return pa.table([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * 6, kind, strict=True)], schema=kind)

    asked = dealt.groupBy("bucket").applyInArrow(ask, MESSAGES)
    answers = asked.groupBy("part").applyInArrow(count, MESSAGES)
    chosen = dealt.groupBy("bucket").cogroup(answers.groupBy("bucket")).applyInArrow(choose, "node binary, size int, fp long, keys array<long>, places array<int>, shingles array<long>")
    return materialize(chosen, "shared-shingles")[0]


def similar_pairs(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (u, v) whose sets (node, shingles) have a similarity of ``least`` or more."""
    both = pairs.join(sets.select(F.col("node").alias("u"), F.col("shingles").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("shingles").alias("b")), "v")
    shared = F.size(F.array_intersect("a", "b"))
    return both.filter(shared / (F.size("a") + F.size("b") - shared) >= least).select("u", "v")


def pair(u: str, v: str) -> list[Column]:
    return [F.least(u, v).alias("u"), F.greatest(u, v).alias("v")]


def first_candidates(sets: DataFrame, keyed: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v): texts whose fingerprints are equal or linked, and neighbours among the rows of a key."""
    first = sets.groupBy("fp").agg(F.min("node").alias("first"))
    same = sets.join(first, "fp").filter("node <> first").select(*pair("node", "first"))
    linked = links(first.select(F.col("fp").alias("node"), F.array("fp").alias("fps")))
    named = linked.join(first.select(F.col("fp").alias("u"), F.col("first").alias("x")), "u").join(first.select(F.col("fp").alias("v"), F.col("first").alias("y")), "v")
    # each key has an order of its own, so a text meets others at each of its keys; a common key is ordered in pieces
    pieces = keyed.groupBy("key").agg((F.floor(F.count("*") / ORDERED) + 1).alias("pieces"))
    beside = Window.partitionBy("key", "piece").orderBy(F.xxhash64("key", "node"), "node")
    row = F.struct("node", "size", "at")
    near = keyed.join(pieces, "key").withColumn("piece", F.pmod(F.xxhash64("node", "key"), F.col("pieces"))).select(row.alias("x"), F.lag(row).over(beside).alias("y"))
    near = near.filter("y IS NOT NULL").filter(possible("x", "y", least)).select(*pair("x.node", "y.node"))
    return same.union(named.select(*pair("x", "y"))).union(near).distinct()


def possible(x: str, y: str, least: float) -> Column:
    """Whether the sizes, and the places of a shared shingle, allow the similarity."""
    size, other = F.col(f"{x}.size"), F.col(f"{y}.size")
    return F.least(size - F.col(f"{x}.at"), other - F.col(f"{y}.at")) >= least / (1 + least) * (size + other) - SLACK


def segments(keys: np.ndarray) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of a sorted array."""
    at = np.append(np.nonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))[0], len(keys)) if len(keys) else np.zeros(1, np.int64)
    return zip(at.tolist(), at[1:].tolist(), strict=False)


def open_partners(i: np.ndarray, root: np.ndarray, size: np.ndarray, at: np.ndarray, tile: np.ndarray, across: bool, least: float) -> np.ndarray:
    """Which rows could be similar to each row of ``i``: of another component, of sizes and places that allow it; ``across``: of the other tile."""
    a = i[:, None]
    ok = (root[a] != root) & (np.minimum(size[a] - at[a], size - at) >= least / (1 + least) * (size[a] + size) - SLACK)
    return ok & (tile[a] != tile) if across else ok


def other_edges(keyed: DataFrame, roots: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Verified pairs (u, v) that connect what all similar pairs between components connect."""
    rooted, _ = materialize(keyed.join(roots, "node", "left").select("key", "node", "size", "at", F.coalesce("root", "node").alias("root")), "rooted-shingles")
    mixed = rooted.groupBy("key").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count("*").alias("n")).filter("a <> b").select("key", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"))
    rows = rooted.join(mixed, "key").withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))).withColumns({"a": F.least("tile", "other"), "b": F.greatest("tile", "other")})
    groups = 1 + rooted.count() // GROUPED
    # small keys share groups; a pair of tiles of a large key is a group of its own
    rows = rows.withColumn("g", F.when(F.col("tiles") == 1, F.pmod("key", F.lit(groups))).otherwise(F.xxhash64("key", "a", "b")))
    group = ["g", "a", "b", "tiles"]

    def columns(table: pa.Table) -> tuple[pa.Table, dict[str, np.ndarray]]:
        table = table.sort_by([("key", "ascending"), ("node", "ascending")])
        out = {c: table.column(c).to_numpy() for c in ("key", "size", "at", "tile")}
        _, out["root"] = np.unique(np.array(table.column("root").to_pylist(), object), return_inverse=True)
        return table, out

    def flag(table: pa.Table) -> pa.Table:
        """The rows of a group that could be similar to any other."""
        table, c = columns(table)
        across, keep = table.column("a")[0].as_py() != table.column("b")[0].as_py(), np.zeros(table.num_rows, bool)
        for s, e in segments(c["key"]):
            part = [c[name][s:e] for name in ("root", "size", "at", "tile")]
            for k in range(0, e - s, 256):
                i = np.arange(k, min(e - s, k + 256))
                keep[s + i] = open_partners(i, *part, across, least).any(axis=1)
        return table.filter(pa.array(keep)).select(["g", "a", "b", "tiles", "key", "node", "size", "at", "root", "tile"])

    def verify(table: pa.Table) -> pa.Table:
        table, c = columns(table)
        across, out = table.column("a")[0].as_py() != table.column("b")[0].as_py(), []
        nodes = table.column("node").to_pylist()
        found = table.column("shingles").combine_chunks()
        flat, bounds = found.flatten().to_numpy(), found.offsets.to_numpy()
        bounds = bounds - bounds[0]
        root = c["root"].copy()
        for s, e in segments(c["key"]):
            for i in range(s, e - 1):
                js = np.nonzero(open_partners(np.array([0]), root[i:e], c["size"][i:e], c["at"][i:e], c["tile"][i:e], across, least)[0])[0] + i
                if not len(js):
                    continue
                own = np.sort(flat[bounds[i] : bounds[i + 1]])
                sizes = bounds[js + 1] - bounds[js]
                them = np.concatenate([flat[bounds[j] : bounds[j + 1]] for j in js])
                where = np.minimum(np.searchsorted(own, them), len(own) - 1)
                shared = np.add.reduceat((own[where] == them).astype(np.int64), np.cumsum(sizes) - sizes)
                for j in js[shared / (len(own) + sizes - shared) >= least].tolist():
                    if root[j] != root[i]:
                        out.append((nodes[i], nodes[j]))
                        root[root == root[j]] = root[i]
        return pa.table([pa.array(x, pa.binary()) for x in (zip(*out, strict=True) if out else ([], []))], ["u", "v"])

    schema = "g long, a int, b int, tiles int, key long, node binary, size int, at int, root binary, tile int"
    flagged, _ = materialize(rows.select(*group, "key", "node", "size", "at", "root", "tile").groupBy(*group).applyInArrow(flag, schema), "open-shingles")
    return flagged.join(sets.select("node", "shingles"), "node").groupBy(*group).applyInArrow(verify, "u binary, v binary")


def similar_groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, n, node (128 bits of the text's hash) and root of every row: rows whose texts are connected by pairs of similarity ``least`` or more share a root."""
    rows = whole_text(docs).select("doc_id", F.length("text").alias("n"), F.unhex(F.md5(F.col("text").cast("binary"))).alias("node"), "text")
    sets = shared_shingles(rows.select("node", "text"), least).dropDuplicates(["node"])
    sets, _ = materialize(sets, "shingle-sets")
    keyed = sets.select("node", "size", F.explode(F.arrays_zip("keys", "places")).alias("k")).select(F.col("k.keys").alias("key"), "node", "size", F.col("k.places").alias("at"))
    edges, _ = materialize(similar_pairs(first_candidates(sets, keyed, least), sets, least), "similar-pairs")
    roots = components(edges, rows=edges.count())
    more, _ = materialize(other_edges(keyed, roots, sets, least), "other-pairs")
    edges = edges.union(more)
    roots = components(edges, rows=edges.count())
    named = roots.select(F.col("node").alias("_node"), "root")
    return rows.select("doc_id", "n", "node").join(named, F.col("node") == F.col("_node"), "left").select("doc_id", "n", "node", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of each group of similar texts the row with the longest, then the smallest doc_id stays, with all columns of ``docs``.

    The row that stays is found by an aggregate over ids and lengths alone; the texts are shuffled once, to be filtered.
    Of rows repeated with one doc_id and one text one stays.
    """
    best = F.max(F.struct("n", F.col("doc_id").isNotNull().alias("known"), (-F.col("doc_id")).alias("minus_id"), "node"))
    ranked = similar_groups(docs, least).groupBy("root").agg(best.alias("best"))
    # ids as text, an empty one for null: the join and the ranking then need one and the same distribution of the rows
    stay = ranked.select(F.coalesce((-F.col("best.minus_id")).cast("string"), F.lit("")).alias("_row_id"), F.col("best.node").alias("_row_node"))
    keyed = docs.withColumns({"_row_id": F.coalesce(F.col("doc_id").cast("long").cast("string"), F.lit("")), "_row_node": F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))})
    order = Window.partitionBy("_row_id", "_row_node").orderBy("_row_node")
    return keyed.join(stay, ["_row_id", "_row_node"], "left_semi").withColumn("_nth", F.row_number().over(order)).filter("_nth = 1").select(docs.columns)
