"""Best-fit-decreasing packing of token ids into fixed windows."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.llm.textkit import chunks, small_batches
from solvara.llm.tokens import encoder

#: Ids held at a time by a task. A block this large fills thousands of windows, so its last open ones hardly count.
BLOCK_IDS = 4 << 20


class OpenWindows:
    """Open windows by remaining capacity; a segment tree over capacities finds the tightest that still fits."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = [False] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def push(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        node = capacity + self.leaves
        while node and not self.any[node]:
            self.any[node] = True
            node >>= 1

    def tightest(self, need: int) -> int | None:
        """The smallest capacity of at least ``need`` that an open window has."""
        node = need + self.leaves
        while not self.any[node]:
            while node & 1:  # a right child: nothing larger below this parent
                node >>= 1
            if not node:
                return None
            node += 1
        while node < self.leaves:
            node = 2 * node if self.any[2 * node] else 2 * node + 1
        return node - self.leaves

    def pop(self, capacity: int) -> int:
        window = self.windows[capacity].pop()
        node = capacity + self.leaves
        if not self.windows[capacity]:
            self.any[node] = False
            node >>= 1
            while node:
                self.any[node] = self.any[2 * node] or self.any[2 * node + 1]
                node >>= 1
        return window


def best_fit_decreasing(lengths: list[int], size: int) -> list[tuple[int, int]]:
    """Window number and offset of each length (1 to ``size``); equal lengths keep their order."""
    out, tree, windows = [(0, 0)] * len(lengths), OpenWindows(size), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        capacity = tree.tightest(lengths[i])
        if capacity is None:
            capacity, window, windows = size, windows, windows + 1
        else:
            window = tree.pop(capacity)
        out[i] = (window, size - capacity)
        if capacity > lengths[i]:
            tree.push(capacity - lengths[i], window)
    return out


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, size: int = 2048, end_id: int = 1) -> DataFrame:
    """Encode ``text``, append ``end_id``, and place every id in a window of at most ``size`` ids; one row a piece.

    Overlong documents are cut into full windows first; what is left of each, and each short document, goes to the
    tightest open window of its block, longest first. A block is up to ``BLOCK_IDS`` ids of one input partition, so
    there is no shuffle, and hot sources, copies or keys don't matter; a window never spans blocks. Sequence ids are
    unique, from partition and number. A null text is empty (the end id alone); null or repeated doc_ids are packed as
    any row; no rows give no pieces. A document of any length is held whole by one task.
    """
    end = struct.pack("<I", end_id)

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, next_id = encoder(vocabulary).encode, TaskContext.get().partitionId() << 36
        names, types = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"], [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3
        rows: list[tuple] = []
        rests: list[tuple] = []
        held = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for i in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[i : i + 4096]), types)], names)
            rows.clear()

        def place() -> None:
            nonlocal next_id, held
            windows = -1
            for (doc_id, start, ids, total), (window, offset) in zip(rests, best_fit_decreasing([len(r[2]) // 4 for r in rests], size)):
                rows.append((doc_id, start, len(ids) // 4, ids, total, next_id + window, offset))
                windows = max(windows, window)
            next_id += windows + 1
            rests.clear()
            held = 0

        for batch in chunks(batches):
            all_ids, at = encode(batch.column("text"))
            for k, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                ids = all_ids[at[k] : at[k + 1]].tobytes() + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    part = ids[4 * start : 4 * (start + size)]
                    if len(part) == 4 * size:
                        rows.append((doc_id, start, size, part, total, next_id, 0))
                        next_id += 1
                    else:
                        rests.append((doc_id, start, part, total))
                        held += len(part) // 4
            if held >= BLOCK_IDS:
                place()
            yield from flush()
        place()
        yield from flush()

    return small_batches(docs.select("doc_id", "text")).mapInArrow(pack, SCHEMA)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 ids and give each piece's place and checksum."""
    import public_tokenizers

    packed = pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
