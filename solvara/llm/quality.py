"""Document quality by supervised subword embeddings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from solvara.llm.joins import with_small
from solvara.llm.textkit import U64, Words, chunks, column, mapped_by_place, mixed, multipliers, others, rolled, run_starts, small_batches
from solvara.storage import staged

#: Hash buckets (a power of two), sizes of character n-grams, and width of a vector.
BUCKET_BITS, NGRAMS, WIDTH = 16, (3, 4, 5), 16
#: Labelled rows that training takes at most, least by a hash of their doc_id; steps over them, in whole
#: passes from 5 to 50; first step size.
TRAIN_ROWS, STEPS, STEP = 4096, 20_000, 0.6

_CHAR = (multipliers(11, max(NGRAMS)) >> U64(32)).astype(np.uint32) | np.uint32(1)
_MIX = multipliers(12, len(NGRAMS)).astype(np.uint32) | np.uint32(1)


def features(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Groups of feature buckets for a batch of texts, each with its offsets by text.

    Features are whole words, pairs of neighbouring words, and character n-grams of words with their borders. The last
    group is one constant feature a text, so that empty and null texts have one too.
    """
    words = Words(column)
    hashes = words.hashes()
    shift = U64(64 - BUCKET_BITS)
    yield (hashes >> shift).astype(np.int32), words.of
    at, offsets = run_starts(words.of, 2)
    yield (mixed(rolled(hashes, 2)[at]) >> shift).astype(np.int32), offsets
    texts = [t or "" for t in column.to_pylist()]
    chars = np.frombuffer((" " + " ".join(texts) + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    bounds = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])  # the border before each text, and the last
    space = (chars == 0x20) | ((chars >= 0x09) & (chars <= 0x0D))
    for n, mix in zip(NGRAMS, _MIX):
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, dtype=np.uint32)
        inner = np.zeros(m, dtype=bool)
        for j in range(n):
            h += chars[j : j + m] * _CHAR[j]
            if 0 < j < n - 1:
                inner |= space[j : j + m]
        good = np.flatnonzero(~inner)
        yield ((h[good] * mix) >> np.uint32(32 - BUCKET_BITS)).astype(np.int32), np.searchsorted(good, bounds)
    yield np.zeros(len(texts), dtype=np.int32), np.arange(len(texts) + 1)


def counted(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct buckets and their counts for each text."""
    groups = list(features(column))
    return [np.unique(np.concatenate([f[o[i] : o[i + 1]] for f, o in groups]), return_counts=True) for i in range(len(column))]


@dataclass
class Model:
    """Vectors by bucket, output weights (2 rows), and the difference of the two outputs for each bucket's vector."""

    vectors: np.ndarray
    output: np.ndarray

    def table(self) -> np.ndarray:
        return self.vectors.astype(np.float64) @ (self.output[1] - self.output[0]).astype(np.float64)


def train(samples: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> Model:
    """Stochastic gradient descent on the softmax loss of averaged vectors, one document a step."""
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / WIDTH, 1 / WIDTH, (1 << BUCKET_BITS, WIDTH)).astype(np.float32)
    output = np.zeros((2, WIDTH), dtype=np.float32)
    passes = min(50, max(5, STEPS // len(samples)))
    steps, done = passes * len(samples), 0
    for _ in range(passes):
        for i in rng.permutation(len(samples)):
            buckets, counts, label = samples[i]
            share = (counts / counts.sum()).astype(np.float32)
            mean = share @ vectors[buckets]
            z = output @ mean
            error = np.exp(z - z.max())
            error /= error.sum()
            error[label] -= 1
            rate = np.float32(STEP * (1 - done / steps))
            back = output.T @ error
            output -= rate * np.outer(error, mean)
            vectors[buckets] -= rate * np.outer(share, back)
            done += 1
    return Model(vectors, output)


def held_out():
    """Whether a row is kept from training: crc32 of its doc_id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Train on at most ``rows`` labelled documents, none of them held out; None without any.

    The sample is the labels of least hashed doc_id; repeated labels of a document count once, as the smallest, and of
    rows that repeat a doc_id the text of least hash trains. Features are counted by the tasks that hold these texts, and
    one task trains on the counts. Columns other than doc_id, text and quality don't matter.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").alias("label"))
    picked = staged(known.orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows).withColumnRenamed("doc_id", "__id"))
    found = with_small(docs.select("doc_id", "text"), picked, F.expr("doc_id = __id"))
    texts = found.groupBy("doc_id", "label").agg(F.min(F.struct(F.xxhash64("text"), "text")).alias("least")).select("doc_id", "label", "least.text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=1 << 20):
            got = counted(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.array([b.tobytes() for b, _ in got], pa.binary()), pa.array([c.astype(np.float32).tobytes() for _, c in got], pa.binary())], ["doc_id", "label", "buckets", "counts"])

    def learn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        samples = []
        for batch in batches:
            for d, label, b, c in zip(*(batch.column(k).to_pylist() for k in ("doc_id", "label", "buckets", "counts"))):
                samples.append((d, np.frombuffer(b, np.int32), np.frombuffer(c, np.float32), label))
        if samples:
            samples.sort(key=lambda s: (s[0], s[3], len(s[1]), s[1].tobytes()))
            model = train([s[1:] for s in samples])
            yield pa.RecordBatch.from_arrays([pa.array([model.vectors.tobytes()], pa.binary()), pa.array([model.output.tobytes()], pa.binary())], ["vectors", "output"])

    bags = small_batches(texts.select("doc_id", "label", "text")).mapInArrow(count, "doc_id long, label int, buckets binary, counts binary")
    row = bags.repartition(1).mapInArrow(learn, "vectors binary, output binary").first()
    return row and Model(np.frombuffer(row.vectors, np.float32).reshape(-1, WIDTH), np.frombuffer(row.output, np.float32).reshape(2, WIDTH))


def scored(docs: DataFrame, model: Model | None, name: str = "score") -> DataFrame:
    """``docs`` with a column ``name``, the probability of label 1 by the whole text; 0.5 for all without a model.

    As the output is linear in the mean vector, each bucket's share of it is looked up in one table. Null and blank
    texts score by the constant feature. Other columns pass through, one that has the name already is replaced; repeated
    rows get equal scores.
    """
    columns = others(docs, name)
    kept = docs.select(*map(column, columns))
    if model is None:
        return kept.withColumn(name, F.lit(0.5))
    table = docs.sparkSession.sparkContext.broadcast(model.table())  # 2**BUCKET_BITS numbers
    place = f"c{columns.index('text')}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches, text=place, size=1 << 20):
            total, n = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for buckets, offsets in features(batch.column(place)):
                values = np.empty(len(buckets) + 1)
                np.take(table.value, buckets, out=values[:-1])
                values[-1] = 0.0
                sums = np.add.reduceat(values, offsets[:-1])
                size = np.diff(offsets)
                total += np.where(size > 0, sums, 0.0)
                n += size
            score = 1 / (1 + np.exp(-total / n))
            yield [*batch.columns, pa.array(score)]

    return mapped_by_place(kept, run, StructType([*kept.schema.fields, StructField(name, DoubleType())]))


def op9_quality(spark, sf_dir: str) -> DataFrame:
    """Score all documents with a model of the labels that are not held out."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = scored(docs, model)
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
