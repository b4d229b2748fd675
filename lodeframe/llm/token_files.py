"""Token ids in binary files of independent zstandard frames with a trailing seek table.

File layout: frames of 32-bit little-endian ids, each at most FRAME ids or one document; an index frame holding, for each
document, its id, number of ids and frame; then a skippable frame with the seek table of the public zstandard
seekable format: for each frame its compressed size, decompressed size and checksum (low 32 bits of XXH64, seed 0,
of the content), then the number of frames, a descriptor byte and the magic number. Any zstandard decoder can read
the file through; a reader that wants some documents seeks to their frames alone.
"""

from __future__ import annotations

import os
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, parts
from .tokens import encoder

# Fixed values of the zstandard seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80

FRAME, END, PER_FILE, LEVEL = 65536, 1, 4096, 3
CHUNKS = 1_200_000  # chunks whose ids a worker keeps
INDEX = np.dtype([("doc_id", "<i8"), ("known", "<i4"), ("frame", "<u4"), ("n", "<u8")])


class Corrupt(ValueError):
    """A frame whose content doesn't fit its checksum, or a file without a seek table."""


class Writer:
    """Writes documents to a binary file object in the order given."""

    def __init__(self, out, frame: int = FRAME, level: int = LEVEL):
        self.out, self.frame = out, frame
        self.zip = zstandard.ZstdCompressor(level=level)
        self.table: list[tuple[int, int, int]] = []
        self.docs: list[tuple[int, int, int, int]] = []
        self.held: list[bytes] = []
        self.n = self.total = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.n + len(ids) > self.frame:
            self._flush()
        self.docs.append((doc_id or 0, doc_id is not None, len(self.table), len(ids)))
        self.held.append(ids.astype("<u4").tobytes())
        self.n += len(ids)
        self.total += len(ids)

    def _put(self, raw: bytes) -> None:
        small = self.zip.compress(raw)
        self.out.write(small)
        self.table.append((len(small), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.held:
            self._put(b"".join(self.held))
            self.held, self.n = [], 0

    def close(self) -> None:
        self._flush()
        self._put(np.array(self.docs, dtype=INDEX).tobytes())
        body = b"".join(struct.pack("<III", *x) for x in self.table) + struct.pack("<IBI", len(self.table), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.out.write(struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body)


class Reader:
    """Reads a file by its seek table; only the frames that hold what is asked for are decompressed."""

    def __init__(self, file, size: int):
        self.file = file
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE_MAGIC or not flags & CHECKSUM_FLAG:
            raise Corrupt("no seek table")
        file.seek(size - 9 - 12 * n)
        self.table = np.frombuffer(file.read(12 * n), dtype="<u4").reshape(-1, 3).astype(np.int64)
        self.at = np.concatenate([[0], np.cumsum(self.table[:, 0])])
        self.unzip = zstandard.ZstdDecompressor()
        self.index = np.frombuffer(self.content(n - 1), dtype=INDEX)
        self.total = int(self.index["n"].sum())

    def content(self, k: int) -> bytes:
        self.file.seek(int(self.at[k]))
        raw = self.unzip.decompress(self.file.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.table[k, 2]:
            raise Corrupt(f"frame {k}")
        return raw

    def documents(self, wanted: set[int] | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the documents before it in this file, ids), in file order; all, or those wanted."""
        held, raw, pos, start = -1, np.empty(0, "<u4"), 0, 0
        for doc, known, frame, n in self.index.tolist():
            if frame != held:
                held, pos, raw = frame, 0, None
            if wanted is None or (known and doc in wanted):
                if raw is None:
                    raw = np.frombuffer(self.content(frame), dtype="<u4")
                yield doc if known else None, start, raw[pos : pos + n]
            pos += n
            start += n


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write(docs: DataFrame, path: str, tokenizer: str, end: int = END, per_file: int = PER_FILE) -> list[tuple[str, int]]:
    """Writes the ids of every row to files under ``path`` in ascending doc_id order; returns (file, ids) in order.

    A null text is empty: its end id alone is written. Null ids come first, rows that repeat an id go by text. An
    empty table gives no files. A task writes under a name of its own and renames at its end, so
    tasks that run twice leave one whole file. Only one row per file reaches the driver.
    """
    n = parts(docs.count(), per_file)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, filesystem, writer = encoder(tokenizer, CHUNKS), None, None
        for b in batches:
            for at in range(0, b.num_rows, 256):  # few texts at a time as Python strings
                ids, texts = b.column(0)[at : at + 256].to_pylist(), [t or "" for t in b.column(1)[at : at + 256].to_pylist()]
                if writer is None:
                    filesystem, base = _fs(path)
                    filesystem.create_dir(base, recursive=True)
                    final = f"{base}/part-{TaskContext.get().partitionId():06d}.zst"
                    mine = f"{base}/.{uuid.uuid4().hex}"
                    out = filesystem.open_output_stream(mine)
                    writer = Writer(out)
                for doc, found in zip(ids, enc.encode(texts), strict=True):
                    writer.add(doc, np.append(found, np.uint32(end)))
        if writer is not None:
            writer.close()
            out.close()
            filesystem.move(mine, final)
            yield pa.RecordBatch.from_arrays([pa.array([os.path.basename(final)]), pa.array([writer.total], pa.int64())], ["file", "ids"])

    order = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return sorted((f"{path}/{r['file']}", r["ids"]) for r in order.mapInArrow(run, "file string, ids long").collect())


def read(spark: SparkSession, files: list[tuple[str, int]]) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) for each document of ``files``, as ``write`` returned them."""
    base, rows = 0, []
    for name, n in files:
        rows.append((name, base))
        base += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, base in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                filesystem, at = _fs(name)
                with filesystem.open_input_file(at) as f:
                    got = [(d, base + s, len(x), zlib.crc32(x.tobytes())) for d, s, x in Reader(f, f.size()).documents()]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in got], pa.int64()) for k in range(4)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    listed = spark.createDataFrame(rows, "file string, base long").repartition(max(1, len(rows)))
    return listed.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, end: int = END) -> DataFrame:
    """Writes the files to the shared folder and reads every document back from them."""
    spark = docs.sparkSession
    return read(spark, write(docs, fresh(spark, "token-files"), tokenizer, end))
