"""Benchmark passages in documents: SimHash windows, multi-index Hamming blocks, exact weighted-shingle similarity."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.llm.joins import with_small
from solvara.llm.textkit import U64, Words, chunks, rolled, run_starts, small_batches, unused
from solvara.storage import staged

SHINGLE = 5
SIMILARITY = Fraction(3, 4)
#: Fingerprints of 64 bits are looked up by 4 blocks of 16 bits: of two that differ in RADIUS bits at most, one block
#: differs in RADIUS // 4 at most. The radius is chosen by measured recall, see README.
BLOCKS, RADIUS = 4, 15
#: Item-sized windows start at steps of a STEPS-th part of their size; sizes that differ less than GRID share their windows.
STEPS, GRID = 6, 1.25
#: Words on which windows are fingerprinted together.
SLICE_WORDS = 1 << 14
#: Runs of words that an item must have unchanged in a similar passage: sizes in words, and the bits in which their
#: fingerprints may differ. Runs of W words start at every max(1, W // 4)-th word.
RUNS, RUN_RADIUS = (1, 2, 3, 4, 5, 8, 12, 16, 24, 32, 48, 64), 3
#: Bytes of item texts held by a pass over the documents, about; more are taken part by part.
PASS_BYTES = 8 << 20


def stride(window: int) -> int:
    return max(1, window // 4)


def clean_run(n: int, similarity: Fraction = SIMILARITY) -> int:
    """Words of the longest unchanged run that an item of ``n`` words must have in a window similar enough.

    Of its m shingles at most m * (1 - t) / (1 + t) can be missing, and a break inside costs 4 of them or more.
    """
    if n < SHINGLE:
        return n
    m = n - SHINGLE + 1
    missing = int(m * (1 - similarity) / (1 + similarity))
    return -(-(m - missing) // (missing // (SHINGLE - 1) + 1)) + SHINGLE - 1


def run_for(n: int) -> int:
    """The largest run that fits into the clean run wherever its stride falls."""
    return max(w for w in RUNS if w + stride(w) - 1 <= clean_run(n) or w == 1)


def fingerprints(hashes: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """SimHash of the windows of ``window`` words that start at ``starts``: the majority of each bit over their shingles."""
    k = min(SHINGLE, window)
    n = window - k + 1
    if not len(starts):
        return np.zeros(0, dtype=U64)
    low, high = starts.min(), starts.max() + window
    bits = np.unpackbits(rolled(hashes[low:high], k).view(np.uint8).reshape(-1, 8), axis=1)
    votes = np.zeros((len(starts), 64), dtype=np.uint8)
    for j in range(n):
        votes += bits[starts - low + j]
    return np.packbits(votes > n // 2, axis=1).view(U64).reshape(-1)


def item_window(n: int) -> int:
    """The size of the windows that items of ``n`` words share: a power of GRID, near ``n``."""
    return round(GRID ** round(math.log(n) / math.log(GRID)))


def bit_sums(hashes: np.ndarray, most: int) -> np.ndarray:
    """Running sums of each bit over the shingles' hashes, from 0, for windows of ``most`` words or fewer.

    Only differences of sums are used, so the sums may wrap: one byte does for windows of up to 255 shingles.
    """
    kind = np.uint8 if most < 256 else np.uint16 if most < 65_536 else np.int64
    sums = np.zeros((max(len(hashes) - SHINGLE + 1, 0) + 1, 64), dtype=kind)
    if len(sums) > 1:
        np.cumsum(np.unpackbits(rolled(hashes, SHINGLE).view(np.uint8).reshape(-1, 8), axis=1), axis=0, dtype=kind, out=sums[1:])
    return sums


def window_prints(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """SimHash of windows of any sizes from SHINGLE words on: the majority of each bit over their shingles."""
    last = ends - SHINGLE + 1
    half = ((last - starts) // 2).astype(sums.dtype)
    return np.packbits(sums[last] - sums[starts] > half[:, None], axis=1).view(U64).reshape(-1)


def windows_of(of: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, text) of each text's windows of ``size`` words at the stride, the last one at its end, or the whole of a shorter text."""
    words = np.diff(of)
    step = max(1, size // STEPS)
    count = np.where(words < SHINGLE, 0, np.maximum(-(-(words - size) // step), 0) + 1)
    text = np.repeat(np.arange(len(words)), count)
    at = (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)) * step
    at = np.minimum(at, np.maximum(words - size, 0)[text]) + of[text]
    return at, np.minimum(at + size, of[text + 1]), text


def neighbours(bits: int, radius: int) -> np.ndarray:
    """All numbers of ``bits`` bits with ``radius`` ones at most."""
    every = np.arange(1 << bits)
    return every[np.bitwise_count(every) <= radius]


class Index:
    """Fingerprints by each block of bits, entered under all keys that a print within the radius can have in a block."""

    def __init__(self, prints: np.ndarray, owners: np.ndarray, radius: int):
        self.prints, self.owners, self.radius = prints, owners, radius
        near = neighbours(64 // BLOCKS, radius // BLOCKS)
        self.tables = []
        for shift in range(0, 64, 64 // BLOCKS):
            key = ((prints >> U64(shift)) & U64(0xFFFF)).astype(np.int64)
            keys = (key[:, None] ^ near).ravel()
            order = np.argsort(keys, kind="stable")
            table = np.concatenate([[0], np.cumsum(np.bincount(keys, minlength=1 << 16))])
            self.tables.append((U64(shift), table, (order // len(near)).astype(np.int32)))

    def within(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All pairs (index of print, item) within the radius, some of them repeated."""
        at, item = [], []
        for shift, offsets, entries in self.tables:
            key = ((prints >> shift) & U64(0xFFFF)).astype(np.int64)
            low = offsets[key]
            count = offsets[key + 1] - low
            ends = np.cumsum(count)
            begin = 0
            while begin < len(prints):  # in parts, so that frequent keys of many prints don't pile up
                end = max(begin + 1, int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + (1 << 20), side="right")))
                part = slice(begin, end)
                own = np.repeat(np.arange(begin, end), count[part])
                other = entries[np.arange(len(own)) - np.repeat(np.cumsum(count[part]) - count[part], count[part]) + np.repeat(low[part], count[part])]
                near = np.bitwise_count(prints[own] ^ self.prints[other]) <= self.radius
                at.append(own[near])
                item.append(self.owners[other[near]])
                begin = end
        return np.concatenate([np.zeros(0, np.int64), *at]), np.concatenate([np.zeros(0, np.int64), *item])


class Items:
    """Items prepared for one pass: shingle counts of each, an index for each size of windows, and one for each of runs."""

    def __init__(self, ids: list[int], texts: list[str]):
        words = Words(pa.array(texts, pa.string()), lower=True)
        self.ids, self.n, hashes = ids, words.counts(), words.hashes()
        self.shingles = []
        by_size: dict[int, list] = {}
        by_run: dict[int, tuple[list, list]] = {}
        for i, n in enumerate(self.n):
            own = hashes[words.of[i] : words.of[i + 1]]
            self.shingles.append(np.unique(rolled(own, min(SHINGLE, n)), return_counts=True) if n else (np.zeros(0, U64), np.zeros(0, int)))
            if n >= SHINGLE:
                by_size.setdefault(item_window(int(n)), []).append((window_prints(bit_sums(own, int(n)), np.array([0]), np.array([n]))[0], i))
            if n:
                w = run_for(int(n))
                prints, owners = by_run.setdefault(w, ([], []))
                prints.append(fingerprints(own, np.arange(n - w + 1), w))
                owners.append(np.full(n - w + 1, i))
        self.windows = {w: Index(np.array([p for p, _ in x], U64), np.array([i for _, i in x]), RADIUS) for w, x in by_size.items()}
        self.runs = {w: Index(np.concatenate(p), np.concatenate(o), RUN_RADIUS) for w, (p, o) in by_run.items()}
        self.sizes = {w: np.unique(self.n[np.unique(index.owners)]) for w, index in self.runs.items()}

    def by_windows(self, words: Words, hashes: np.ndarray) -> list[np.ndarray]:
        """Pairs (text * number of items + item) with fingerprints of item-sized windows within the radius."""
        pairs = []
        windows = [(windows_of(words.of, size), index) for size, index in self.windows.items()]
        for low in range(0, len(hashes), SLICE_WORDS):
            parts = [(np.searchsorted(start, [low, low + SLICE_WORDS]), start, end, text, index) for (start, end, text), index in windows]
            high = max([int(end[b - 1]) for (a, b), _, end, _, _ in parts if b > a], default=low)
            sums = bit_sums(hashes[low:high], max(self.windows, default=0))
            for (a, b), start, end, text, index in parts:
                which, item = index.within(window_prints(sums, start[a:b] - low, end[a:b] - low))
                pairs.append(np.unique(text[a:b][which] * len(self.ids) + item))
        return pairs

    def by_runs(self, words: Words, hashes: np.ndarray) -> list[np.ndarray]:
        """Pairs that have a run of the item as it is; of texts somewhat shorter than an item, runs start at each word."""
        pairs = []
        counts = words.counts()
        for w, index in self.runs.items():
            at, offsets = run_starts(words.of, w)
            sizes = np.append(self.sizes[w], np.iinfo(np.int64).max)
            dense = sizes[np.searchsorted(sizes, counts, side="right")] - SHINGLE <= (counts - SHINGLE + 1) / float(SIMILARITY)
            text = np.repeat(np.arange(len(counts)), np.diff(offsets))
            on = ((at - words.of[text]) % stride(w) == 0) | dense[text]
            at, text = at[on], text[on]
            which, item = index.within(fingerprints(hashes, at, w))
            pairs.append(np.unique(text[which] * len(self.ids) + item))
        return pairs

    def best(self, i: int, hashes: np.ndarray) -> tuple[int, int, int, int] | None:
        """(shared, union, start, words) of the document's window most similar to item i, the first of these; None below the bound.

        Windows have the item's number of words, or all of a shorter document's. Shared counts repeated shingles as often
        as both sides have them.
        """
        n = min(int(self.n[i]), len(hashes))
        k = min(SHINGLE, int(self.n[i]))
        keys, counts = self.shingles[i]
        m, own = n - k + 1, int(counts.sum())
        if m < 1:
            return None
        doc = rolled(hashes, k)
        place = np.minimum(np.searchsorted(keys, doc), len(keys) - 1)
        hit = keys[place] == doc
        total = np.concatenate([[0], np.cumsum(hit)])
        upper = total[m:] - total[:-m]
        top = None
        for start in np.flatnonzero(upper * (1 + SIMILARITY.denominator / SIMILARITY.numerator) >= m + own - 1e-9):
            part = slice(start, start + m)
            shared = int(np.minimum(np.bincount(place[part][hit[part]], minlength=len(keys)), counts).sum())
            union = m + own - shared
            if shared * SIMILARITY.denominator >= union * SIMILARITY.numerator and (top is None or shared * top[1] > top[0] * union):
                top = (shared, union, int(start), n)
        return top


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, text_hash, item_id, start, n_words, shared, union_size): the most similar window of each text and item."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").distinct()
    passes = max(1, -(-(items.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0) // PASS_BYTES))
    found = None
    for p in range(passes):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(passes)) == p).orderBy("item_id", "text").collect()
        held = spark.sparkContext.broadcast(Items([r.item_id for r in rows], [r.text for r in rows]))

        def run(batches: Iterable[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            items = held.value
            for batch in chunks(batches):
                words = Words(batch.column("text"), lower=True)
                hashes = words.hashes()
                pairs = items.by_windows(words, hashes) + items.by_runs(words, hashes)
                ids, marks = batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist()
                out = []
                for pair in np.unique(np.concatenate(pairs)) if pairs else ():
                    t, i = divmod(int(pair), len(items.ids))
                    if top := items.best(i, hashes[words.of[t] : words.of[t + 1]]):
                        shared, union, start, n = top
                        out.append((ids[t], marks[t], items.ids[i], start, n, shared, union))
                columns = list(zip(*out)) if out else [[]] * 7
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "text_hash", "item_id", "start", "n_words", "shared", "union_size"])

        part = small_batches(docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_hash"), "text")).mapInArrow(run, "doc_id long, text_hash long, item_id long, start long, n_words long, shared long, union_size long")
        found = part if found is None else found.union(part)
    return found

def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row for each document and benchmark item it contains: doc_id, item_id, start, n_words, shared, union_size, similarity.

    A document contains an item if a window of the item's number of words (or the whole of a shorter document) has a
    weighted Jaccard similarity of 0.75 or more with it, over counted five-word shingles of lower-cased words; the row
    names its most similar window, the first of equals. Items of fewer words are one shingle. Repeated rows of a
    document or an item give one row. Null or blank texts contain nothing and are contained in nothing; empty tables
    give no rows. A null doc_id is reported as null. Items are broadcast in blocks of about PASS_BYTES; documents are
    never shuffled.
    """
    found = matches(docs, benchmark)
    similarity = (F.col("shared") / F.col("union_size")).alias("similarity")
    best = F.max(F.struct(similarity, (-F.col("start")).alias("back"), "n_words", "shared", "union_size"))
    rows = found.groupBy("doc_id", "item_id").agg(best.alias("b"))
    return rows.select("doc_id", "item_id", (-F.col("b.back")).alias("start"), "b.n_words", "b.shared", "b.union_size", "b.similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows whose text contains an item. Rows of one id, or without one, are judged by their own texts."""
    own, mark = unused(docs, "leak_id"), unused(docs, "leak_hash")
    hit = staged(matches(docs, benchmark).select(F.col("doc_id").alias(own), F.col("text_hash").alias(mark)).distinct())
    return with_small(docs, hit, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(mark)), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    """Benchmark items contained in documents."""
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark),
ds AS (SELECT doc_id, nd, p, array_to_string(ws[p+1:p+5], ' ') AS s FROM (SELECT doc_id, ws, len(ws) AS nd, unnest(generate_series(0, len(ws) - 5)) AS p FROM d WHERE len(ws) >= 5)),
bs AS (SELECT item_id, n, s, count(*) AS c FROM (SELECT item_id, len(ws) AS n, array_to_string(ws[i+1:i+5], ' ') AS s FROM (SELECT item_id, ws, unnest(generate_series(0, len(ws) - 5)) AS i FROM b WHERE len(ws) >= 5)) GROUP BY item_id, n, s),
hit AS (SELECT doc_id, item_id, p, s, c, least(n, nd) AS w, n - 4 AS own, nd FROM ds JOIN bs USING (s)),
win AS (SELECT doc_id, item_id, w, own, s, c, unnest(generate_series(greatest(0, p - w + 5), least(p, nd - w))) AS start FROM hit),
per AS (SELECT doc_id, item_id, w, own, start, least(count(*), min(c)) AS k FROM win GROUP BY doc_id, item_id, w, own, start, s),
sim AS (SELECT doc_id, item_id, start, w AS n_words, CAST(sum(k) AS BIGINT) AS shared, CAST(w - 4 + own - sum(k) AS BIGINT) AS union_size FROM per GROUP BY doc_id, item_id, w, own, start),
best AS (SELECT *, shared / union_size AS similarity, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY shared / union_size DESC, start) AS r FROM sim WHERE 4 * shared >= 3 * union_size)
SELECT doc_id, item_id, CAST(start AS BIGINT) AS start, CAST(n_words AS BIGINT) AS n_words, shared, union_size, similarity FROM best WHERE r = 1
"""
