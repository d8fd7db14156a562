"""Operator 1: token ids in binary shards of independent zstandard frames.

A shard is a file in Zstandard's seekable format, version 0.1: data frames (each with its own content checksum), a
skippable frame with the document index, and a skippable frame with the seek table: compressed size, size and checksum
(the low 32 bits of the content's XXH64) of every frame. The index is an entry of the table too, of size 0, as the format
hides other frames from readers of the content. A reader that wants some documents fetches the two tables from the end
and decompresses only their frames.
"""

from __future__ import annotations

import io
import struct
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import giving_back, scratch_dir, slices, small_batches
from .tokenize import word_bpe

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SKIP, INDEX_SKIP, SEEK_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
FRAME_BYTES = 1 << 20
#: A document's entry in the index: whether it has an id, the id, its frame, its first byte there, its tokens.
ENTRY = 5


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def checksum(content: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(content) & 0xFFFFFFFF


class ShardWriter:
    """Writes documents in order; a frame is closed once it holds frame_bytes, so a document lies in one frame."""

    def __init__(self, out, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.out, self.most = out, frame_bytes
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.buffer: list[bytes] = []
        self.held, self.frames, self.docs = 0, [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.docs.append((doc_id is not None, doc_id or 0, len(self.frames), self.held, len(ids) // 4))
        self.buffer.append(ids)
        self.held += len(ids)
        if self.held >= self.most:
            self.flush()

    def flush(self) -> None:
        if self.held:
            raw = b"".join(self.buffer)
            packed = self.zstd.compress(raw)
            self.out.write(packed)
            self.frames.append((len(packed), len(raw), checksum(raw)))
            self.buffer, self.held = [], 0

    def close(self) -> None:
        self.flush()
        index = self.zstd.compress(np.array(self.docs, "<i8").reshape(-1, ENTRY).tobytes())
        self.out.write(struct.pack("<II", INDEX_SKIP, len(index)) + index)
        self.frames.append((8 + len(index), 0, checksum(b"")))
        n = len(self.frames)
        self.out.write(struct.pack("<II", SKIP, 12 * n + 9) + b"".join(struct.pack("<III", *f) for f in self.frames))
        self.out.write(struct.pack("<IBI", n, 0x80, SEEK_MAGIC))


class ShardReader:
    """Random access to a shard. Each frame that is read is held against the seek table and its own checksum. Of the
    frames the last is the index."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, io.SEEK_END)
        file.seek(size - 9)
        n, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEK_MAGIC or not flags & 0x80:
            raise ValueError("not a shard: no seek table with checksums at its end")
        table = size - 9 - 12 * n
        file.seek(table - 8)
        head = struct.unpack("<II", file.read(8))
        if head != (SKIP, 12 * n + 9):
            raise ValueError("the seek table is damaged")
        self.frames = np.frombuffer(file.read(12 * n), "<u4").reshape(n, 3)
        self.starts = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        file.seek(int(self.starts[-2]) if n else 0)
        kind, length = struct.unpack("<II", file.read(8)) if n else (0, 0)
        if kind != INDEX_SKIP or self.starts[-1] != table - 8:
            raise ValueError("the document index is missing")
        self.index = np.frombuffer(self._zstd().decompress(file.read(length)), "<i8").reshape(-1, ENTRY)

    @staticmethod
    def _zstd():
        import zstandard

        return zstandard.ZstdDecompressor()

    def frame(self, k: int) -> bytes:
        self.file.seek(int(self.starts[k]))
        raw = self._zstd().decompress(self.file.read(int(self.frames[k, 0])))
        if len(raw) != self.frames[k, 1] or checksum(raw) != self.frames[k, 2]:
            raise ValueError(f"frame {k} fails its checksum")
        return raw

    def documents(self):
        """(doc_id, ids as bytes) of all documents in order; one frame is held at a time."""
        at, raw = -1, b""
        for known, doc_id, k, begin, n in self.index.tolist():
            if k != at and n:
                at, raw = k, self.frame(k)
            yield doc_id if known else None, raw[begin : begin + 4 * n] if n else b""

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every document with this id (None: of those without one); only their frames are decompressed."""
        known = self.index[:, 0] == 1
        chosen = ~known if doc_id is None else known & (self.index[:, 1] == doc_id)
        return [np.frombuffer(self.frame(k)[b : b + 4 * n], "<u4") if n else np.zeros(0, "<u4") for _, _, k, b, n in self.index[chosen].tolist()]


def write(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Encodes every whole text, appends end_id and writes shards in ascending doc_id order below path.

    Returns the manifest (shard, file, docs, tokens), one row a shard. Null texts count as empty (only end_id),
    repeated rows are all written, those of one doc_id in the order of their texts (null first); a null doc_id stays null
    and sorts first. Range partitioning splits by doc_id, so a hot source can't fill a shard; a shard is written to a name of its own attempt and then renamed,
    so a task that is run again replaces the same file with the same bytes.
    """
    import pyarrow as pa

    schema = "shard int, file string, docs bigint, tokens bigint"

    def run(batches):
        import uuid

        import public_tokenizers
        from pyspark import TaskContext

        fs, root = _filesystem(path)
        shard = TaskContext.get().partitionId()
        final, temp = f"{root}/part-{shard:06d}.ids", f"{root}/.part-{shard:06d}-{uuid.uuid4().hex}"
        bpe, end = word_bpe(public_tokenizers.path(tokenizer)), np.array([end_id], "<u4").tobytes()
        out, writer, tokens = None, None, 0
        for batch in batches:
            for doc_id, text in slices(batch, ["doc_id", "text"]):
                if out is None:
                    fs.create_dir(root, recursive=True)
                    out = fs.open_output_stream(temp)
                    writer = ShardWriter(out)
                for d, t in zip(doc_id, text):
                    ids = bpe.encode(t) + end
                    tokens += len(ids) // 4
                    writer.add(d, ids)
        if out is not None:
            writer.close()
            out.close()
            fs.move(temp, final)
            yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "file": [final], "docs": pa.array([len(writer.docs)], pa.int64()), "tokens": pa.array([tokens], pa.int64())})

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text").mapInArrow(giving_back(run), schema)


def read(manifest: DataFrame, path: str) -> DataFrame:
    """(shard, doc_id, start, n_tokens, ids_crc32) of every document of the shards in the manifest.

    The manifest has a row a shard, which bounds what the driver sees (the prefix sum over shards); documents stay
    on the executors. A shard is read frame by frame.
    """
    import pyarrow as pa

    spark = manifest.sparkSession
    shards = sorted(manifest.collect())
    starts, total = [], 0
    for s in shards:
        starts.append((s.shard, s.file, total))
        total += s.tokens
    if not starts:
        return spark.createDataFrame([], "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")
    files = spark.createDataFrame(starts, "shard int, file string, at bigint").repartition(len(starts))

    def run(batches):
        fs, _ = _filesystem(path)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["file"]) as f:
                    rows, at = [], row["at"]
                    for doc_id, ids in ShardReader(f).documents():
                        rows.append((doc_id, at, len(ids) // 4, zlib.crc32(ids)))
                        at += len(ids) // 4
                        if len(rows) == 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return files.mapInArrow(giving_back(run), "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def round_trip(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID) -> DataFrame:
    """Writes all documents to shards in the shared folder and returns what reading them back gives."""
    path = scratch_dir(docs.sparkSession, "tokens")
    return read(write(docs, path, tokenizer, end_id), path)
