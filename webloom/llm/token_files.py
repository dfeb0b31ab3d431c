"""Operator 2: token ids in files of bit planes.

The ids of all documents, in ascending doc_id order, are cut into blocks of ``BLOCK`` ids. A block is transposed into
bit planes (all lowest bits, all second bits, ... as many as its largest id needs), each plane is compressed with
zstandard by itself, and an index gives the place of every block and of every document.

A file, little-endian:

    magic | planes of block 0 | planes of block 1 | ... | compressed index | index length (8 bytes) | magic

    index: number of blocks, planes and documents (8 bytes each); for each block: ids, planes; the planes' compressed
    sizes; for each document: doc_id, known flag (0 for a null doc_id), number of ids

Documents are dealt by ranges of doc_id, sorted within a range, and each task writes one file below the shared folder
under a name of its own attempt. The list of files that Spark keeps comes from the attempts that succeeded, so a task
that is run again can't add ids twice. Writing and reading hold one block at a time.

Defined cases: null text counts as empty (the end id alone); a null doc_id comes first; rows repeated with
one doc_id are all written, in the order of their text's hash; an empty table writes no file and gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, shared_path, slices, whole_text
from .tokens import byte_bpe

MAGIC = b"WLPLANE1"
BLOCK = 1 << 16
LEVEL = 3
END_ID = 2
#: Tasks that read files at most; with more files each task reads several.
READ_TASKS = 50_000


def to_planes(ids: np.ndarray) -> list[bytes]:
    """The bit planes of a block of unsigned 32-bit ids, lowest first; none if all are 0."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    return [np.packbits((ids >> np.uint32(b)).astype(np.uint8) & 1).tobytes() for b in range(width)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    ids = np.zeros(n, np.uint32)
    for b, plane in enumerate(planes):
        ids |= np.unpackbits(np.frombuffer(plane, np.uint8), count=n).astype(np.uint32) << np.uint32(b)
    return ids


class PlaneWriter:
    """Writes one file, a block at a time, to anything that has ``write``."""

    def __init__(self, out, block: int = BLOCK, level: int = LEVEL):
        self.out, self.block = out, block
        self.zstd = zstandard.ZstdCompressor(level=level)
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self.blocks: list[tuple[int, int]] = []
        self.sizes: list[int] = []
        self.docs: list[tuple[int, int, int]] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, int(doc_id is not None), len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            ids = np.concatenate(self.waiting)
            whole = len(ids) // self.block * self.block
            for a in range(0, whole, self.block):
                self._put(ids[a : a + self.block])
            self.waiting, self.held = [ids[whole:].copy()], len(ids) - whole

    def _put(self, ids: np.ndarray) -> None:
        planes = [self.zstd.compress(p) for p in to_planes(ids)]
        for p in planes:
            self.out.write(p)
        self.blocks.append((len(ids), len(planes)))
        self.sizes += [len(p) for p in planes]

    def close(self) -> None:
        if self.held:
            self._put(np.concatenate(self.waiting))
        parts = [(len(self.blocks), len(self.sizes), len(self.docs)), np.array(self.blocks, "<i8"), np.array(self.sizes, "<i8"), np.array(self.docs, "<i8")]
        index = self.zstd.compress(struct.pack("<3q", *parts[0]) + b"".join(p.tobytes() for p in parts[1:]))
        self.out.write(index + struct.pack("<q", len(index)) + MAGIC)


class PlaneReader:
    """Reads a file that allows ``seek``: any range of ids by the index, or document by document."""

    def __init__(self, source):
        self.source = source
        self.zstd = zstandard.ZstdDecompressor()
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a file of bit planes")
        source.seek(-len(MAGIC) - 8, 2)
        (length,) = struct.unpack("<q", source.read(8))
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("the file ends early")
        source.seek(-len(MAGIC) - 8 - length, 2)
        raw = self.zstd.decompress(source.read(length))
        blocks, sizes, docs = struct.unpack("<3q", raw[:24])
        rest = np.frombuffer(raw, "<i8", offset=24)
        self.blocks = rest[: 2 * blocks].reshape(-1, 2)
        self.sizes = rest[2 * blocks : 2 * blocks + sizes]
        self.docs = rest[2 * blocks + sizes :].reshape(docs, 3)
        self.plane_at = np.concatenate([[0], np.cumsum(self.blocks[:, 1])])
        self.byte_at = len(MAGIC) + np.concatenate([[0], np.cumsum(self.sizes)])
        self.id_at = np.concatenate([[0], np.cumsum(self.blocks[:, 0])])

    def block(self, k: int) -> np.ndarray:
        a, b = int(self.plane_at[k]), int(self.plane_at[k + 1])
        self.source.seek(int(self.byte_at[a]))
        data = self.source.read(int(self.byte_at[b] - self.byte_at[a]))
        cuts = self.byte_at[a : b + 1] - self.byte_at[a]
        return from_planes([self.zstd.decompress(data[x:y]) for x, y in zip(cuts, cuts[1:], strict=False)], int(self.blocks[k, 0]))

    def ids(self, start: int, n: int) -> np.ndarray:
        first = int(np.searchsorted(self.id_at, start, "right")) - 1
        last = int(np.searchsorted(self.id_at, start + n, "left"))
        if n == 0:
            return np.zeros(0, np.uint32)
        held = np.concatenate([self.block(k) for k in range(first, last)])
        return held[start - self.id_at[first] :][:n]

    def documents(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """doc_id, place of the first id in this file, ids; each block is read once."""
        held, at, k, place = np.zeros(0, np.uint32), 0, 0, 0
        for doc_id, known, n in self.docs.tolist():
            parts, need = [], n
            while need:
                if at == len(held):
                    held, at, k = self.block(k), 0, k + 1
                got = held[at : at + need]
                parts.append(got)
                at, need = at + len(got), need - len(got)
            yield (doc_id if known else None), place, (parts[0] if len(parts) == 1 else np.concatenate([np.zeros(0, np.uint32), *parts]))
            place += n


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI or an absolute path; Hadoop also writes file:/x for file:///x."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


def write_token_files(docs: DataFrame, path: str, end_id: int = END_ID, block: int = BLOCK) -> DataFrame:
    """Write the ids of all documents; gives a row a file: path, n_docs, n_tokens, first_id and start.

    ``start`` counts the ids of all files before it.
    """
    spark = docs.sparkSession
    folder = shared_path(spark, "token-files")
    end = np.array([end_id], "<u4").tobytes()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer = stream = name = None
        bpe = byte_bpe(path)
        for batch in slices(batches):
            if writer is None:
                system, top = opened(folder)
                system.create_dir(top, recursive=True)
                name = f"ids-{uuid.uuid4().hex}.planes"  # of this attempt alone
                stream = system.open_output_stream(f"{top}/{name}")
                writer = PlaneWriter(stream, block)
            for doc_id, ids in zip(batch.column("doc_id").to_pylist(), bpe.encode(batch.column("text").to_pylist()), strict=True):
                writer.add(doc_id, np.frombuffer(ids + end, "<u4"))
        if writer is not None:
            writer.close()
            stream.close()
            first, known, _ = writer.docs[0]
            row = {"path": f"{folder}/{name}", "n_docs": len(writer.docs), "n_tokens": sum(d[2] for d in writer.docs), "first_id": first if known else None}
            yield pa.RecordBatch.from_pylist([row], pa.schema([("path", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("first_id", pa.int64())]))

    ordered = whole_text(docs).repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    schema = "path string, n_docs long, n_tokens long, first_id long"
    # the names of the files alone, one row a task, as any committer gathers them; running the plan again would write again
    files = spark.createDataFrame(ordered.mapInArrow(write, schema).collect(), schema)
    # one row a file, however many documents
    before = Window.orderBy(F.col("first_id").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def read_token_files(files: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files' bytes; a task reads whole files."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])
        for batch in batches:
            for row in batch.to_pylist():
                system, name = opened(row["path"])
                with system.open_input_file(name) as source:
                    rows = [(d, row["start"] + place, len(ids), zlib.crc32(ids.tobytes())) for d, place, ids in PlaneReader(source).documents()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    # files are of like sizes: dealt in turn over a fixed number of partitions, which adaptive execution leaves alone
    tasks = max(1, min(READ_TASKS, files.count()))
    return files.select("path", "start").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_token_files(write_token_files(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))
