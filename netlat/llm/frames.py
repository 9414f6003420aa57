"""Token files of independent zstandard frames.

A file holds, in the order of the identifiers, one frame a document: its ids as
little-endian unsigned integers of 2 or 4 bytes. Behind the frames stand two frames
that plain decoders skip: the identifiers, and the seek table of the zstandard
seekable format, which holds each frame's packed size, plain size and checksum.
A reader takes the table from the file's end and unpacks the frames it wants.

    frame*  |  skip(0x184D2A5D) width:u8, doc_id:i64*  |  skip(0x184D2A5E) seek table
    seek table: (packed:u32 plain:u32 xxh64&0xffffffff:u32)*, count:u32, 0x80, 0x8F92EAB1
"""

import struct
import uuid
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netlat.llm.common import file_system, qualified, text_of
from netlat.llm.pieces import encoder
from netlat.session import settle

_SEEK, _IDS, _END = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
#: A null identifier's place in a file.
_NULL = -(2**63)
_MANIFEST = "shard int, file string, frame int, doc_id long, n_tokens long"


class FrameWriter:
    """Writes one file; ids come as little-endian unsigned 32-bit integers."""

    def __init__(self, out, width: int, level: int):
        self.out, self.width = out, width
        self.packer = zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.table, self.ids = [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        plain = ids if self.width == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes()
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.table.append((len(packed), len(plain), xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF))
        self.ids.append(_NULL if doc_id is None else doc_id)

    def close(self) -> None:
        names = struct.pack("<B", self.width) + np.asarray(self.ids, "<i8").tobytes()
        self.out.write(struct.pack("<II", _IDS, len(names)) + names)
        table = np.asarray(self.table, "<u4").tobytes()
        self.out.write(struct.pack("<II", _SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self.table), 0x80, _END))
        self.out.close()


class FrameReader:
    """Reads one file that can be sought in."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - 9)
        count, _, end = struct.unpack("<IBI", source.read(9))
        if end != _END:
            raise ValueError("no seek table at the file's end")
        source.seek(size - 9 - 12 * count)
        self.table = np.frombuffer(source.read(12 * count), "<u4").reshape(count, 3).astype(np.int64)
        self.starts = np.append(0, np.cumsum(self.table[:, 0]))
        source.seek(int(self.starts[-1]) + 8)
        names = source.read(1 + 8 * count)
        self.width = names[0]
        self.ids = np.frombuffer(names, "<i8", offset=1)
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.table)

    def counts(self) -> np.ndarray:
        """Tokens of each document, from the table alone."""
        return self.table[:, 1] // self.width

    def doc_id(self, k: int) -> int | None:
        return None if self.ids[k] == _NULL else int(self.ids[k])

    def frame(self, k: int) -> bytes:
        """The document's ids as little-endian unsigned 32-bit integers."""
        self.source.seek(int(self.starts[k]))
        plain = self.unpacker.decompress(self.source.read(int(self.table[k, 0])), max_output_size=int(self.table[k, 1]))
        if xxhash.xxh64_intdigest(plain) & 0xFFFFFFFF != self.table[k, 2]:
            raise ValueError(f"checksum of frame {k} differs")
        return plain if self.width == 4 else np.frombuffer(plain, "<u2").astype("<u4").tobytes()


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int, id_col: str = "doc_id", level: int = 1) -> DataFrame:
    """Encode each whole text, add the end id, and write files in ascending order of
    the identifiers: their order within a file, and that of the shards.

    Returns the manifest: shard, file, frame, doc_id, n_tokens. Only the files it
    names count; a task that runs twice writes two files, and one of them is named.
    A null text is the end id alone; null identifiers come first; rows that repeat
    are written each. An empty table writes no file.
    """
    spark = docs.sparkSession
    base = qualified(spark, folder)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of().alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(tokenizer), int(end_id).to_bytes(4, "little")
        width = 2 if max(coder.tokenizer.get_vocab_size() - 1, end_id) < 2**16 else 4
        shard, writer, frame = TaskContext.get().partitionId(), None, 0
        name = f"part-{shard:06d}-{uuid.uuid4().hex}.zst"
        fs, path = file_system(base)
        for batch in batches:
            if batch.num_rows and writer is None:
                fs.create_dir(path, recursive=True)
                writer = FrameWriter(fs.open_output_stream(f"{path}/{name}", compression=None, buffer_size=1 << 20), width, level)
            names, counts = batch.column("doc_id").to_pylist(), []
            for doc_id, text in zip(names, batch.column("text"), strict=True):
                ids = coder.one(text.as_py()) + end
                writer.add(doc_id, ids)
                counts.append(len(ids) // 4)
            n = len(counts)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array([name] * n, pa.string()), pa.array(range(frame, frame + n), pa.int32()), pa.array(names, pa.int64()), pa.array(counts, pa.int64())],
                names=["shard", "file", "frame", "doc_id", "n_tokens"],
            )
            frame += n
        if writer is not None:
            writer.close()

    return settle(ordered.mapInArrow(write, _MANIFEST), "token-manifest")


def shards(manifest: DataFrame, base: str) -> list[tuple[int, str, int]]:
    """(shard, file, ids before it) of each file, as many rows as files; the ids are
    summed up from the files' own seek tables."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(base)
        for batch in batches:
            sums = []
            for name in batch.column("file").to_pylist():
                with fs.open_input_file(f"{path}/{name}") as source:
                    sums.append(int(FrameReader(source, fs.get_file_info(f"{path}/{name}").size).counts().sum()))
            yield pa.RecordBatch.from_arrays([batch.column("shard"), batch.column("file"), pa.array(sums, pa.int64())], names=["shard", "file", "n"])

    files = manifest.select("shard", "file").distinct()
    totals = files.mapInArrow(count, "shard int, file string, n long").orderBy("shard").collect()
    starts = np.append(0, np.cumsum([r["n"] for r in totals], dtype=np.int64))
    return [(r["shard"], r["file"], int(s)) for r, s in zip(totals, starts[:-1], strict=True)]


def read_token_files(spark: SparkSession, folder: str, manifest: DataFrame, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (little-endian
    unsigned 32-bit integers), one file a task, or of the given documents only: their
    frames alone are unpacked."""
    base = qualified(spark, folder)
    wanted = None if doc_ids is None else set(doc_ids)
    files = shards(manifest, base)
    table = spark.createDataFrame(files, "shard int, file string, start long").repartition(max(1, len(files)))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = file_system(base)
        for batch in batches:
            for row in batch.to_pylist():
                full = f"{path}/{row['file']}"
                with fs.open_input_file(full) as source:
                    reader = FrameReader(source, fs.get_file_info(full).size)
                    counts = reader.counts()
                    starts = row["start"] + np.append(0, np.cumsum(counts)[:-1]) if len(counts) else counts
                    some = deque(k for k in range(len(reader)) if wanted is None or reader.doc_id(k) in wanted)
                    while some:
                        now, size = [], 0
                        while some and size < 4_000_000:
                            size += int(counts[some[0]])
                            now.append(some.popleft())
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([reader.doc_id(k) for k in now], pa.int64()), pa.array(starts[now], pa.int64()), pa.array(counts[now], pa.int64()), pa.array([reader.frame(k) for k in now], pa.binary())],
                            names=["doc_id", "start", "n_tokens", "ids"],
                        )

    return table.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")
