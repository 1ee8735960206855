"""Ranked lexical search: impact vectors in buckets by length, pruned by Cauchy-Schwarz and coordinate bounds, rescored exactly."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.llm.textkit import U64, Words, chunks, release, small_batches
from solvara.storage import staged

#: Bytes that separate terms, and byte values with ASCII letters lowered (0 for a separator).
_BYTES = np.arange(256)
_LETTER = (_BYTES >= 0x80) | ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x41) & (_BYTES <= 0x5A)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A))
TERM_VALUES = np.where(_LETTER, np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES) + 1, 0).astype(U64)
#: Bytes of items that one pass over the documents takes; documents of a bucket; longest vectors that set first bounds.
PASS_BYTES, BUCKET, SEED_ROWS = 8 << 20, 4096, 2048
#: Share of an item's squared length that its foremost coordinates have.
FOREMOST = 0.9
SLACK = 1 + 1e-9


class Queries:
    """Items of one pass: their terms by number in one sorted vocabulary of hashes, and how often each has each."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.string()), values=TERM_VALUES)
        self.ids = ids
        self.vocabulary, inverse = np.unique(words.hashes(), return_inverse=True)
        self.terms, self.times = [], []
        for a, b in zip(words.of[:-1], words.of[1:]):
            terms, times = np.unique(inverse[a:b], return_counts=True)
            self.terms.append(terms)
            self.times.append(times)

    def weigh(self, weights: np.ndarray) -> None:
        """Set the vocabulary's weights: exact ones for scores, and roots for lengths and bounds; rarest terms first."""
        self.weights, self.roots = weights, np.sqrt(weights.astype(float))
        for i, (terms, times) in enumerate(zip(self.terms, self.times)):
            order = np.argsort(-self.roots[terms] * times, kind="stable")
            self.terms[i], self.times[i] = terms[order], times[order]
        self.coordinates = [self.roots[t] * n for t, n in zip(self.terms, self.times)]
        self.norms = np.array([np.sqrt((c**2).sum()) for c in self.coordinates])
        self.foremost = [int(np.searchsorted(np.cumsum(c**2), FOREMOST * (c**2).sum())) + 1 for c in self.coordinates]


def term_counts(batches: Iterable[pa.RecordBatch], vocabulary: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Of each document with a term: its number of terms, and those of the vocabulary with their occurrences."""
    for batch in chunks(batches):
        words = Words(batch.column("text"), values=TERM_VALUES)
        hashes, n = words.hashes(), words.counts()
        place = np.minimum(np.searchsorted(vocabulary, hashes), max(len(vocabulary) - 1, 0))
        hit = vocabulary[place] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
        keys, times = np.unique(words.text_of_words()[hit] * max(len(vocabulary), 1) + place[hit], return_counts=True)
        text, term = np.divmod(keys, max(len(vocabulary), 1))
        offsets = np.searchsorted(text, np.arange(len(n) + 1)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), pa.array(x)) for x in (term.astype(np.int32), times.astype(np.int64))]
        rows = pa.array(np.flatnonzero(n))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(rows), pa.array(n[n > 0], pa.int64()), *(x.take(rows) for x in lists)], ["doc_id", "n", "terms", "tfs"])
    release()


class Bucket:
    """Documents of neighbouring length: postings by term, lengths, and the greatest coordinate of each term."""

    def __init__(self, batch: pa.RecordBatch, roots: np.ndarray):
        ids = batch.column("doc_id")
        self.null = np.asarray(ids.is_null())
        self.ids = ids.fill_null(np.iinfo(np.int64).max).to_numpy()
        self.norms = batch.column("norm").to_numpy()
        lists = batch.column("terms")
        doc = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy())
        terms, impacts = lists.flatten().to_numpy(), batch.column("impacts").flatten().to_numpy()
        order = np.argsort(terms, kind="stable")
        self.doc, self.impacts = doc[order], impacts[order]
        self.starts = np.searchsorted(terms[order], np.arange(len(roots) + 1))
        self.coordinates = self.impacts * roots[terms[order]]
        self.top = np.zeros(len(roots))
        here = np.flatnonzero(np.diff(self.starts))
        if len(here):
            self.top[here] = np.maximum.reduceat(self.coordinates, self.starts[here])

    def postings(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of these terms' postings, and for each the term's place."""
        a, b = self.starts[terms], self.starts[terms + 1]
        which = np.repeat(np.arange(len(terms)), b - a)
        return np.arange(len(which)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + a[which], which

    def survivors(self, queries: Queries, q: int, bound: float) -> np.ndarray:
        """Documents that could score ``bound``: first by the whole bucket, then by the item's foremost coordinates.

        What the other coordinates add is at most the product of both remaining lengths, and at most the bucket's greatest
        coordinates.
        """
        terms, own = queries.terms[q], queries.coordinates[q]
        tops = own * self.top[terms]
        if min(queries.norms[q] * self.norms.max(), tops.sum()) * SLACK < bound:
            return np.zeros(0, np.int64)
        half = queries.foremost[q]
        at, which = self.postings(terms[:half])
        known = np.bincount(self.doc[at], own[which] * self.coordinates[at], minlength=len(self.ids))
        square = np.bincount(self.doc[at], self.coordinates[at] ** 2, minlength=len(self.ids))
        rest = np.sqrt((own[half:] ** 2).sum()) * np.sqrt(np.maximum(self.norms**2 * SLACK - square, 0))
        return np.flatnonzero((known + np.minimum(rest, tops[half:].sum())) * SLACK >= bound)

    def scores(self, queries: Queries, q: int, rows: np.ndarray) -> np.ndarray:
        """Exact integer scores of some documents."""
        place = np.full(len(self.ids), -1)
        place[rows] = np.arange(len(rows))
        at, which = self.postings(queries.terms[q])
        to = place[self.doc[at]]
        total = np.zeros(len(rows), np.int64)
        here = to >= 0
        np.add.at(total, to[here], (queries.weights[queries.terms[q]] * queries.times[q])[which[here]] * self.impacts[at[here]])
        return total


def ranked(batches: Iterable[pa.RecordBatch], queries: Queries, bounds: np.ndarray, k: int) -> Iterator[pa.RecordBatch]:
    """The ``k`` best documents of each item among these vectors, which come by falling length.

    An item's bound is the score its k-th best has for sure: the given one, or that of this task's own k-th best so far.
    """
    bounds = bounds.astype(float).copy()
    best = [(np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, np.int64)) for _ in queries.ids]

    def take(rows: list[pa.RecordBatch]) -> None:
        bucket = Bucket(pa.Table.from_batches(rows).combine_chunks().to_batches()[0], queries.roots)
        for q in range(len(queries.ids)):
            left = bucket.survivors(queries, q, bounds[q])
            if not len(left):
                continue
            scores = bucket.scores(queries, q, left)
            on = (scores > 0) & (scores >= bounds[q])
            all_ids, all_null, all_scores = (np.concatenate(x) for x in zip(best[q], (bucket.ids[left[on]], bucket.null[left[on]], scores[on])))
            order = np.lexsort((all_ids, all_null, -all_scores))[:k]
            best[q] = all_ids[order], all_null[order], all_scores[order]
            if len(order) == k:
                bounds[q] = max(bounds[q], float(best[q][2][-1]))

    waiting, rows = [], 0
    for batch in batches:
        for low in range(0, batch.num_rows, BUCKET):
            part = batch.slice(low, BUCKET)
            waiting.append(part)
            rows += part.num_rows
            if rows >= BUCKET:
                take(waiting)
                waiting, rows = [], 0
    if rows:
        take(waiting)
    counts = [len(b[0]) for b in best]
    ids, null, scores = (np.concatenate([np.zeros(0, t), *(b[i] for b in best)]) for i, t in enumerate((np.int64, bool, np.int64)))
    numbers = np.repeat(np.arange(len(counts)), counts)
    yield pa.RecordBatch.from_arrays([pa.array(numbers, pa.int64()), pa.array(ids, mask=null), pa.array(scores)], ["item", "doc_id", "score"])
    release()


def _pass(docs: DataFrame, queries: Queries, k: int) -> DataFrame:
    """(item, doc_id, score): for one pass's items, by number, the best of each task's documents."""
    spark = docs.sparkSession
    vocabulary = spark.sparkContext.broadcast(queries.vocabulary)  # at most PASS_BYTES of items have these terms
    counts = staged(small_batches(docs).mapInArrow(lambda batches: term_counts(batches, vocabulary.value), "doc_id long, n long, terms array<int>, tfs array<long>"))
    total = counts.agg(F.count("*").alias("N"), F.coalesce(F.sum("n"), F.lit(0)).alias("L")).first()
    weight = F.floor(1000 * F.log((2 * F.lit(total.N) + 2).cast("double") / (2 * F.col("df") + 1))).cast("long")
    weights = np.zeros(len(queries.vocabulary), np.int64)
    for row in counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).select("term", weight.alias("w")).toLocalIterator():
        weights[row.term] = row.w  # a row a term of the items
    queries.weigh(weights)
    held = spark.sparkContext.broadcast(queries)
    m = F.lit(75) + F.expr(f"CAST((CAST(25 AS DECIMAL(38, 0)) * n * {total.N}) DIV {max(total.L, 1)} AS LONG)")
    named = counts.where(F.size("terms") > 0).select("doc_id", "terms", "tfs", m.alias("m"))

    def impacts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots = held.value.roots
        for batch in batches:
            terms, tf = (batch.column(c).flatten().to_numpy() for c in ("terms", "tfs"))
            lengths = batch.column("terms").value_lengths().to_numpy()
            starts = np.cumsum(lengths) - lengths
            impact = (1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(batch.column("m").to_numpy(), lengths))
            norm = np.sqrt(np.add.reduceat((impact * roots[terms]) ** 2, starts)) if len(starts) else np.zeros(0)
            lists = pa.ListArray.from_arrays(pa.array(np.append(starts, len(terms)), pa.int32()), pa.array(impact, pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(norm), batch.column("terms"), lists], ["doc_id", "norm", "terms", "impacts"])

    schema = "doc_id long, norm double, terms array<int>, impacts array<long>"
    vectors = staged(small_batches(named).mapInArrow(impacts, schema))
    found = "item long, doc_id long, score long"
    none = np.zeros(len(queries.ids))
    first = vectors.orderBy(F.desc("norm"), "doc_id").limit(SEED_ROWS).mapInArrow(lambda batches: ranked(batches, held.value, none, k), found)
    bounds = none.copy()
    for row in first.groupBy("item").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).toLocalIterator():
        bounds[row.item] = row.least  # a row an item: k documents reach it
    by_length = vectors.withColumn("salt", F.xxhash64("doc_id", "terms")).repartitionByRange(F.desc("norm"), "salt").sortWithinPartitions(F.desc("norm"))
    return small_batches(by_length.drop("salt")).mapInArrow(lambda batches: ranked(batches, held.value, bounds, k), found)


def search(docs: DataFrame, benchmark: DataFrame, k: int = 20) -> DataFrame:
    """For each item the ``k`` documents of highest score above 0: (item_id, rank, doc_id, score).

    Terms are runs of ASCII letters, digits and all signs beyond ASCII, ASCII letters lowered. A score sums, over the
    item's terms with repeats, the term's weight (by the number of documents that have it) times its impact in the
    document (by its occurrences there and the document's length), all in integers.

    Documents become sparse impact vectors over the items' terms, ranged by falling length into buckets. The longest
    vectors give each item a bound first; a bucket, then a document, that can't reach it is passed over; the rest are
    scored exactly. Equal scores go by doc_id, a null one last. Each row of ``docs`` is a document, copies too; vectors of
    one length are dealt out by id and terms. Null texts and those without terms are in no result and count nowhere; an
    item without terms, and empty tables, give no rows. Equal rows of an item are one; rows of one item_id with unlike
    texts are items of their own and each give ``k`` rows. Terms are compared by 64-bit hashes. Items of more than
    PASS_BYTES bytes in all take further passes.
    """
    items = staged(benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where("text is not null").distinct())
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // PASS_BYTES))
    found = None
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()  # PASS_BYTES, about
        part = _pass(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), Queries([r.item_id for r in rows], [r.text for r in rows]), k)
        names = docs.sparkSession.createDataFrame([(i, r.item_id) for i, r in enumerate(rows)], "item long, item_id long")
        part = part.join(F.broadcast(names), "item").withColumn("pass", F.lit(p))  # a row an item of the pass
        found = part if found is None else found.union(part)
    rank = F.row_number().over(Window.partitionBy("pass", "item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def op13_lexical_search(spark, sf_dir: str) -> DataFrame:
    """The 20 best documents of each benchmark item."""
    return search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), 20)


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
b AS (SELECT DISTINCT item_id, text, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM benchmark),
c AS (SELECT count(*) AS n_docs, sum(len(ts)) AS n_terms FROM d WHERE len(ts) > 0),
q AS (SELECT item_id, text, t, count(*) AS times FROM (SELECT item_id, text, unnest(ts) AS t FROM b) GROUP BY item_id, text, t),
v AS (SELECT DISTINCT t FROM q),
p AS (SELECT row, doc_id, n, t, count(*) AS tf FROM (SELECT row, doc_id, len(ts) AS n, unnest(ts) AS t FROM d) SEMI JOIN v USING (t) GROUP BY row, doc_id, n, t),
w AS (SELECT t, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t),
s AS (SELECT item_id, text, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM p JOIN w USING (t) JOIN q USING (t), c GROUP BY item_id, text, row, doc_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, text ORDER BY score DESC, doc_id NULLS LAST) AS INT) AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
