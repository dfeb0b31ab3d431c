"""Texts dealt to buckets in compressed parcels, and questions that buckets ask of parts.

What a bucket wants to know of its distinct keys (tokens, n-grams, shingles) it asks once for each: its sorted keys go,
as one compressed row a part, to the part that sums such questions over all buckets, and one row with the answers in
the order of the keys comes back. A bucket makes its question again to read the answer, so keys are never sent back.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import release, slices

#: Rows and bytes of text of a parcel.
PARCEL_ROWS, PARCEL = 2048, 1 << 20
END = b"\n"


def words(text: str) -> list[bytes]:
    """bytes.lower touches A-Z alone, bytes.split cuts at [\\x20\\x09-\\x0D]."""
    return text.encode().lower().split()


def joined(texts: list[list[bytes]]) -> bytes:
    """Texts' words, compressed as they are; :func:`lines` reads them."""
    return zstandard.ZstdCompressor(level=3).compress(END.join([b" ".join(t) for t in texts]))


def parcels(rows: DataFrame, buckets: int, pack: Callable[[list[list[bytes]]], bytes] = joined) -> DataFrame:
    """Rows with ``text`` as parcels: bucket, an array for each other column, and ``blob``, what ``pack`` makes of the texts' words.

    A parcel goes to a bucket by its place in its task, whatever it holds, so no key or group of copies makes a large
    bucket. ``rows`` should come from stored tables, so that a task that runs again makes the same parcels.
    """
    others = [f for f in rows.schema if f.name != "text"]
    schema = ", ".join(["bucket int", *(f"{f.name} array<{f.dataType.simpleString()}>" for f in others), "blob binary"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        task = TaskContext.get().partitionId()
        for place, batch in enumerate(slices(batches, PARCEL_ROWS, PARCEL)):
            blob = pack([words(t) for t in batch.column("text").to_pylist()])
            bucket = xxhash.xxh64_intdigest(f"{task}:{place}") % buckets
            whole = pa.array([0, batch.num_rows], pa.int32())
            columns = [pa.array([bucket], pa.int32()), *(pa.ListArray.from_arrays(whole, batch.column(f.name)) for f in others), pa.array([blob], pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["bucket", *(f.name for f in others), "blob"])

    return rows.mapInArrow(run, schema)


def deal(rows: DataFrame, buckets: int) -> DataFrame:
    return parcels(rows, buckets).repartition(buckets, "bucket")


def lines(table: pa.Table) -> Iterator[list[bytes]]:
    """The words of each text of a bucket's parcels, in order."""
    unpack = zstandard.ZstdDecompressor().decompress
    for blob in table.column("blob"):
        for line in unpack(blob.as_py()).split(END):
            yield line.split(b" ") if line else []


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays by byte planes, compressed; their types are known to whoever reads them."""
    planes = [np.ascontiguousarray(a).view(np.uint8).reshape(len(a), a.dtype.itemsize).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join([np.array([len(a) for a in arrays], "<i8").tobytes(), *planes]))


def unpacked(data: bytes, *types: str) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    at, out = 8 * len(types), []
    for n, t in zip(raw[:at].view("<i8").tolist(), map(np.dtype, types), strict=True):
        out.append(np.ascontiguousarray(raw[at : at + n * t.itemsize].reshape(t.itemsize, n).T).view(t).ravel())
        at += n * t.itemsize
    return out


def part_of(hashes: np.ndarray, parts: int) -> np.ndarray:
    """Parts in the order of the hashes (unsigned, 64 bits)."""
    return ((hashes >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)


def messages(key: object, made: Iterator[tuple[int, bytes]]) -> pa.Table:
    """Rows (part, bucket, data) of a bucket's questions."""
    made = list(made)
    return pa.table({"part": pa.array([p for p, _ in made], pa.int32()), "bucket": pa.array([key] * len(made), pa.int32()), "data": pa.array([d for _, d in made], pa.binary())})


MESSAGES = "part int, bucket int, data binary"


def by_part(table: pa.Table) -> dict[int, bytes]:
    return dict(zip(table.column("part").to_pylist(), table.column("data").to_pylist(), strict=True))
