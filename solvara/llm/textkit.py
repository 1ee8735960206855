"""Vectorised word and shingle hashing over Arrow string columns.

Words are maximal runs of bytes other than 0x20 and 0x09-0x0D. A word's hash is a multilinear sum of its bytes with
random odd 64-bit multipliers, a shingle's the same over its words; both are mixed. Equal inputs hash alike on every
machine; different ones collide with a probability near 2**-57 a pair.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

U64 = np.uint64
SLICE_BYTES = 1 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def multipliers(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random odd numbers of 64 bits."""
    start = (seed * 0x9E3779B97F4A7C15) % 2**64
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15)) + U64(start)) | U64(1)


POSITIONS = multipliers(1, 4096)
WORDS_IN_SHINGLE = multipliers(2, 64)

_SEPARATOR = np.zeros(256, dtype=bool)
_SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_VALUE = np.where(_SEPARATOR, 0, np.arange(256) + 1).astype(U64)
_LOWER_VALUE = _VALUE.copy()
_LOWER_VALUE[0x41:0x5B] = _VALUE[0x61:0x7B]


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; nulls are empty."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None else np.zeros(0, np.uint8)
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores after it until no column of ``df`` has it, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *names: str) -> list[str]:
    """The columns of ``df`` but for these names, in any case of letters."""
    gone = {n.lower() for n in names}
    return [c for c in df.columns if c.lower() not in gone]


#: Bytes of an Arrow batch that a text operator is handed, at most, or one row.
BATCH_BYTES = 4 << 20


def small_batches(df: DataFrame) -> DataFrame:
    """``df`` after bounding the session's Arrow batches by bytes: rows of long texts would else make large ones."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    if df.sparkSession.conf.get(name) != f"{BATCH_BYTES}b":
        df.sparkSession.conf.set(name, f"{BATCH_BYTES}b")
    return df


def mapped_by_place(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[list]], schema: StructType) -> DataFrame:
    """``df`` through ``run``, which takes record batches of columns c0, c1, ... and yields lists of ``schema``'s columns.

    Spark can't name columns with dots or backticks on this way, so they go by place.
    """
    places = [f"c{i}" for i in range(len(schema))]

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays(columns, places)

    plain = StructType([StructField(c, f.dataType) for c, f in zip(places, schema)])
    return small_batches(df.toDF(*(f"c{i}" for i in range(len(df.columns))))).mapInArrow(named, plain).toDF(*schema.names)


def release() -> None:
    """Give freed memory back to the system: Spark keeps Python workers, and what they hold, for later stages."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that each holds about ``size`` bytes of text, or one row; release memory at the end."""
    for batch in batches:
        _, offsets = utf8(batch.column(text))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(offsets, offsets[start] + size, side="right")) - 1)
            yield batch.slice(start, end - start)
            start = end
        batch = offsets = None
    release()


class Words:
    """The words of a batch of texts: byte range and hash of each, and each text's range of words.

    ``values`` gives each byte a value, bytes of 0 separating words; else separators are as above.
    """

    def __init__(self, column: pa.Array, lower: bool = False, values: np.ndarray | None = None):
        self.data, offsets = utf8(column)
        self.values = values if values is not None else _LOWER_VALUE if lower else _VALUE
        word = (self.values != 0)[self.data]
        first, last = word.copy(), word.copy()
        if len(word):
            first[1:] &= ~word[:-1]
            last[:-1] &= ~word[1:]
            inner = offsets[(offsets > 0) & (offsets < len(word))]
            first[inner] |= word[inner]
            last[inner - 1] |= word[inner - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.of = np.searchsorted(self.starts, offsets)  # text i has words of[i]:of[i + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.of)

    def text_of_words(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.of) - 1), self.counts())

    def hashes(self) -> np.ndarray:
        """A hash for each word."""
        out = np.empty(len(self.starts), dtype=U64)
        begin = 0
        while begin < len(out):
            end = max(begin + 1, int(np.searchsorted(self.starts, self.starts[begin] + SLICE_BYTES)))
            low, high = self.starts[begin], self.ends[end - 1]
            at = self.starts[begin:end] - low
            place = np.arange(high - low) - np.repeat(at, np.diff(np.append(at, high - low)))
            weight = POSITIONS[np.minimum(place, len(POSITIONS) - 1)]
            far = np.flatnonzero(place >= len(POSITIONS))
            weight[far] = mixed(place[far].astype(U64) + U64(77)) | U64(1)
            out[begin:end] = np.add.reduceat(self.values[self.data[low:high]] * weight, at)
            begin = end
        return mixed(out)


def rolled(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` neighbouring entries; runs may cross texts, callers choose the valid ones."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(n, dtype=U64)
    for j in range(k):
        out += hashes[j : j + n] * WORDS_IN_SHINGLE[j]
    return mixed(out)


def run_starts(of: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions at which a run of ``k`` words lies within its text, and the offsets of these by text."""
    counts = np.maximum(np.diff(of) - k + 1, 0)
    offsets = np.concatenate([[0], np.cumsum(counts)])
    return np.arange(offsets[-1]) - np.repeat(offsets[:-1], counts) + np.repeat(of[:-1], counts), offsets
