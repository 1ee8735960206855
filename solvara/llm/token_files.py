"""Token-id files: one zstandard frame or more a document, a document index, and a trailing seek table.

File layout, little-endian:

* data frames - independent zstandard frames of unsigned 32-bit token ids, at most ``FRAME_IDS`` ids each, with the
  zstandard content checksum on; a document's frames follow one another;
* a skippable frame with the document index - for each document its id (signed 64 bits), a null flag (1 byte), and its
  number of ids (unsigned 64 bits), as three arrays;
* a skippable frame with the seek table of the public seekable format - compressed size, plain size and the low 32 bits
  of the XXH64 of the plain bytes for each data frame, then number of frames, descriptor byte and magic number.

A reader takes the tail, finds a document's frames by summing sizes, and reads and decompresses only those.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.llm.textkit import chunks, small_batches
from solvara.llm.tokens import encoder
from solvara.storage import shared_dir, staged

#: Fixed values of the public zstandard seekable format.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
INDEX_MAGIC = 0x184D2A5D

#: Ids in a frame at most, so that a very long document is read and written piece by piece.
FRAME_IDS = 1 << 20


class FileWriter:
    """Appends documents to an open binary stream; ``close`` writes index and seek table."""

    def __init__(self, stream, level: int = 3):
        self.stream, self.zstd = stream, zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        self.frames: list[tuple[int, int, int]] = []
        self.doc_ids: list[int | None] = []
        self.sizes: list[int] = []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        for i in range(0, len(ids), 4 * FRAME_IDS):
            part = ids[i : i + 4 * FRAME_IDS]
            packed = self.zstd.compress(part)
            self.stream.write(packed)
            self.frames.append((len(packed), len(part), xxhash.xxh64_intdigest(part) & 0xFFFFFFFF))
        self.doc_ids.append(doc_id)
        self.sizes.append(len(ids) // 4)

    def close(self) -> None:
        n = len(self.sizes)
        index = b"".join((
            struct.pack("<Q", n),
            np.array([d or 0 for d in self.doc_ids], dtype="<i8").tobytes(),
            np.array([d is None for d in self.doc_ids], dtype="u1").tobytes(),
            np.array(self.sizes, dtype="<u8").tobytes(),
        ))
        self.stream.write(struct.pack("<II", INDEX_MAGIC, len(index)) + index)
        table = np.array(self.frames, dtype="<u4").reshape(-1, 3).tobytes()
        foot = struct.pack("<IBI", len(self.frames), CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table) + len(foot)) + table + foot)


class FileReader:
    """Random access to the documents of one file, opened on any seekable stream of known size."""

    def __init__(self, stream, size: int):
        self.stream, self.zstd = stream, zstandard.ZstdDecompressor()
        n, flag, magic = struct.unpack("<IBI", self._at(size - 9, 9))
        if magic != SEEKABLE_MAGIC or not flag & CHECKSUM_FLAG:
            raise ValueError("no seek table with checksums at the end of the file")
        self.frames = np.frombuffer(self._at(size - 9 - 12 * n, 12 * n), dtype="<u4").reshape(n, 3)
        self.at = np.concatenate([[0], np.cumsum(self.frames[:, 0], dtype=np.int64)])
        start = int(self.at[-1])
        magic, length = struct.unpack("<II", self._at(start, 8))
        if magic != INDEX_MAGIC:
            raise ValueError("no document index after the data frames")
        index = self._at(start + 8, length)
        (docs,) = struct.unpack_from("<Q", index)
        ids = np.frombuffer(index, "<i8", docs, 8)
        empty = np.frombuffer(index, "u1", docs, 8 + 8 * docs)
        self.doc_ids = [None if e else int(d) for d, e in zip(ids, empty)]
        self.sizes = np.frombuffer(index, "<u8", docs, 8 + 9 * docs).astype(np.int64)
        self.first_frame = np.concatenate([[0], np.cumsum(-(-self.sizes // FRAME_IDS))])

    def _at(self, offset: int, length: int) -> bytes:
        self.stream.seek(offset)
        return self.stream.read(length)

    def ids(self, k: int) -> bytes:
        """The ids of the file's k-th document; raises where a frame fails its checksum."""
        out = []
        for f in range(int(self.first_frame[k]), int(self.first_frame[k + 1])):
            part = self.zstd.decompress(self._at(int(self.at[f]), int(self.frames[f, 0])))
            if len(part) != self.frames[f, 1] or xxhash.xxh64_intdigest(part) & 0xFFFFFFFF != self.frames[f, 2]:
                raise ValueError(f"frame {f} fails its checksum")
            out.append(part)
        return b"".join(out)


FILE_SCHEMA = "part int, file string, documents long, tokens long, bytes long"


def write_token_files(docs: DataFrame, folder: str, vocabulary: str, end_id: int = 2, partitions: int | None = None) -> DataFrame:
    """Encode ``text``, append ``end_id`` and write files in ascending ``doc_id`` order; return one row a file.

    ``folder`` is any path that pyarrow's file systems open on every executor. The rows are range-partitioned by
    doc_id, a file to a partition; file numbers ascend with doc_id, null ids first. Rows of equal doc_id are ordered by
    a hash of their text and stay apart. A null text is empty: it holds the end id alone. No rows give no files.
    A task writes under a name of its own and renames, so a repeated task replaces its file by an equal one.
    """
    spread = docs.select("doc_id", "text", F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("place"))
    keys = ["doc_id", "tie", "place"]
    ranged = spread.repartitionByRange(partitions, *keys) if partitions else spread.repartitionByRange(*keys)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        name, encode = f"{root}/part-{part:06d}.ids.zst", encoder(vocabulary).encode
        draft = f"{name}.{uuid.uuid4().hex}"
        end, writer, stream = struct.pack("<I", end_id), None, None
        for batch in chunks(batches):
            if writer is None:
                stream = fs.open_output_stream(draft)
                writer = FileWriter(stream)
            ids, at = encode(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                writer.add(doc_id, ids[at[k] : at[k + 1]].tobytes() + end)
        if writer is None:
            return
        writer.close()
        stream.close()
        fs.move(draft, name)
        row = [part, name, len(writer.sizes), sum(writer.sizes), fs.get_file_info(name).size]
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int64()))], ["part", "file", "documents", "tokens", "bytes"])

    return staged(small_batches(ranged.sortWithinPartitions(*keys).select("doc_id", "text")).mapInArrow(write, FILE_SCHEMA))


def read_token_files(files: DataFrame, folder: str, wanted: list[int] | None = None) -> DataFrame:
    """Documents of the files listed: doc_id, start (ids of all documents before it), ids (binary).

    ``wanted`` names documents; only their frames are read and decompressed. The running total is over one row a file.
    """
    before = F.coalesce(F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = files.select("part", "file", "bytes", before.alias("before"))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = pyarrow.fs.FileSystem.from_uri(folder)
        keep = None if wanted is None else set(wanted)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(row["file"]) as stream:
                    reader = FileReader(stream, row["bytes"])
                    starts = row["before"] + np.concatenate([[0], np.cumsum(reader.sizes)])
                    out, held = [], 0
                    for k, doc_id in enumerate(reader.doc_ids):
                        if keep is None or doc_id in keep:
                            out.append((doc_id, int(starts[k]), reader.ids(k)))
                            held += len(out[-1][2])
                        if out and (held > 8 << 20 or k == len(reader.doc_ids) - 1):
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "ids"])
                            out, held = [], 0
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.binary()))], ["doc_id", "start", "ids"])

    n = max(1, min(files.count(), 10_000))
    return placed.repartition(n, "part").mapInArrow(read, "doc_id long, start long, ids binary")


def op1_token_files(spark, sf_dir: str) -> DataFrame:
    """Write all documents as token-id files, read them back, and give each document's place, count and checksum."""
    import public_tokenizers

    folder = shared_dir(spark)
    files = write_token_files(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    back = read_token_files(files, folder)
    return back.select("doc_id", "start", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
