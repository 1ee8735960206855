"""Removal of word windows that an earlier document already has, by super-k-mer partitioning."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from solvara.llm.joins import with_small
from solvara.llm.textkit import U64, Words, chunks, column, mapped_by_place, mixed, multipliers, others, release, rolled, run_starts, small_batches, unused
from solvara.storage import staged

#: Words of a minimiser, and windows that travel in one packed string at most.
MINIMISER, RUN = 3, 64
#: Bytes of packed strings that a bucket holds, about, before compression; a text's strings overlap, and take some
#: EXPANSION times its bytes.
BUCKET_BYTES, EXPANSION = 6 << 20, 4
#: A minimiser of fewer strings is never hot.
LEAST_HOT = 4
#: Bits of the filter of hot minimisers at most (8 MB), and for each of them.
FILTER_BITS, BITS_EACH = 1 << 26, 16
#: A null doc_id comes after all others; a real id of this value is taken for one.
LAST = np.iinfo(np.int64).max
RUN_WEIGHTS = multipliers(8, RUN)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least of each ``width`` neighbours."""
    out, have = x, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:]) if len(out) > step else out[:0]
        have += step
    return out


def super_kmers(hashes: np.ndarray, at: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Cut the windows that start at ``at`` into runs of neighbours with one minimiser: index of each run's first window, and its minimiser."""
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, U64)
    least = sliding_min(rolled(hashes, MINIMISER), k - MINIMISER + 1)[at]
    new = np.ones(len(at), dtype=bool)
    new[1:] = (np.diff(at) != 1) | (least[1:] != least[:-1])
    first = np.flatnonzero(new)
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    first = np.flatnonzero(place % RUN == 0)
    return first, least[first]


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indices of all ranges, one after the other."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def pack(arrays: list[np.ndarray]) -> bytes:
    """Arrays of fixed types, each after its byte length, as one zstandard frame."""
    return zstandard.ZstdCompressor(level=3).compress(b"".join(len(b := np.ascontiguousarray(a).tobytes()).to_bytes(8, "little") + b for a in arrays))


#: Types of a packed string's arrays: doc_id, tag in 16-bit parts, first window's word, windows, bytes of text, text.
PACKED = (np.int64, np.uint16, np.int32, np.uint8, np.int32, np.uint8)
#: Types of a list of spans: doc_id, tag, first word, end.
SPANS = (np.int64, np.int64, np.int32, np.int32)


def unpack(blob: bytes, types: tuple) -> list[np.ndarray]:
    plain, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    for kind in types:
        size = int.from_bytes(plain[at : at + 8], "little")
        out.append(np.frombuffer(plain, kind, size // np.dtype(kind).itemsize, at + 8))
        at += 8 + size
    return out


def whole_tags(parts: np.ndarray, n: int) -> np.ndarray:
    """The tags of ``n`` strings from their 16-bit parts, lowest first; parts that aren't there are 0."""
    out = np.zeros((n, 4), "<u2")
    out[:, : len(parts) // n] = parts.reshape(n, -1)
    return out.view("<i8").ravel()


def later(doc: np.ndarray, *content: np.ndarray) -> np.ndarray:
    """Which entries have an equal one of a lesser document."""
    order = np.lexsort((doc, *content))
    same = np.ones(len(order), dtype=bool)
    same[:1] = False
    for c in content:
        same[1:] &= c[order][1:] == c[order][:-1]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    out = np.zeros(len(order), dtype=bool)
    out[order] = doc[order] > doc[order][head]
    return out


def merged_strings(batch: pa.RecordBatch, k: int):
    """The super-k-mers of a batch, and which of them only repeat an equal one of a lesser document of the batch.

    None without windows; else words, at (first word of each window), first (first window of each string), count,
    minimiser, windows (hashes), place (of a window in its string), doc, tag, start, repeats.
    """
    words = Words(batch.column("text"))
    hashes = words.hashes()
    at, _ = run_starts(words.of, k)
    first, minimiser = super_kmers(hashes, at, k)
    if not len(first):
        return None
    docs, tags = batch.column("doc_id").fill_null(LAST).to_numpy(), batch.column("tag").to_numpy()
    count = np.diff(np.append(first, len(at)))
    windows = rolled(hashes, k)[at]
    place = np.arange(len(at)) - np.repeat(first, count)
    content = [np.add.reduceat(mixed(windows ^ salt) * RUN_WEIGHTS[place], first) for salt in multipliers(9, 2)]
    text = np.searchsorted(words.of, at[first], side="right") - 1
    doc, tag, start = docs[text], tags[text], (at[first] - words.of[text]).astype(np.int32)
    repeats = later(doc, *content)
    return words, at, first, count, minimiser, windows, place, doc, tag, start, repeats


class Filter:
    """A set of minimisers as bits, two for each: members are always found, a few others too."""

    def __init__(self, size: int, words: np.ndarray, masks: np.ndarray):
        self.size, self.bits = size, np.zeros(size >> 6, dtype=U64)
        self.bits[words] = masks

    def has(self, minimiser: np.ndarray) -> np.ndarray:
        out = np.ones(len(minimiser), dtype=bool)
        for shift in (0, 26):
            place = (minimiser >> U64(shift)) & U64(self.size - 1)
            out &= (self.bits[place >> U64(6)] >> (place & U64(63))) & U64(1) != 0
        return out


def hot_minimisers(docs: DataFrame, k: int, buckets: int) -> Filter:
    """Minimisers that lead more strings than half a mean bucket holds, from counts of all strings of all documents.

    Text beside a passage that very many documents have would else meet in one bucket. Counts are added up by the shuffle;
    the driver gets the hot ones as bits of a filter of FILTER_BITS at most. What the filter takes for hot beside these is
    cut into windows too, which gives equal results.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, size=4 << 20):
            if found := merged_strings(batch, k):
                values, n = np.unique(found[4][~found[-1]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([*values.view(np.int64).tolist(), None], pa.int64()), pa.array(np.append(n, n.sum()))], ["minimiser", "n"])  # a null has all

    counts = small_batches(docs).mapInArrow(run, "minimiser long, n long").groupBy("minimiser").agg(F.sum("n").alias("n"))
    counts = staged(counts.where(F.col("minimiser").isNull() | (F.col("n") >= LEAST_HOT)))
    total = counts.where("minimiser is null").agg(F.sum("n")).first()[0] or 0
    counts = counts.where("minimiser is not null")
    hot = staged(counts.where(F.col("n") >= total / (2 * buckets)).select("minimiser"))
    size = min(FILTER_BITS, max(1 << 10, 1 << (BITS_EACH * hot.count()).bit_length()))
    places = hot.select(F.explode(F.array(*[F.shiftrightunsigned("minimiser", shift).bitwiseAND(F.lit(size - 1)) for shift in (0, 26)])).alias("place"))
    masks = places.groupBy(F.shiftright("place", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(place & 63 as int))")).alias("mask")).toArrow()  # FILTER_BITS / 64 rows at most
    return Filter(size, masks["word"].to_numpy(), masks["mask"].to_numpy().view(U64))


def framed(bucket: np.ndarray, doc: np.ndarray, tag: np.ndarray, start: np.ndarray, count: np.ndarray, low: np.ndarray, high: np.ndarray, data: np.ndarray) -> tuple[list[int], list[bytes]]:
    """Strings (bytes ``low`` to ``high`` of ``data``) in one frame for each bucket that has any: buckets and frames."""
    order = np.argsort(bucket, kind="stable")
    bucket, doc, tag, start, count, low, high = (x[order] for x in (bucket, doc, tag, start, count, low, high))
    occupied, edges = np.unique(bucket, return_index=True)  # a chunk's work follows its strings, not the number of buckets
    blobs = []
    for begin, end in zip(edges, np.append(edges[1:], len(bucket))):
        part = slice(begin, end)
        size = high[part] - low[part]
        arrays = [doc[part], tag[part].astype("<i8").view("<u2"), start[part], count[part], size, data[ragged(low[part], size)]]
        blobs.append(pack([a.astype(t, copy=False) for a, t in zip(arrays, PACKED)]))
    return occupied.tolist(), blobs


def unframed(blobs: list[bytes]) -> list[np.ndarray]:
    """The arrays of several frames, one after the other, tags whole."""
    parts = [unpack(b, PACKED) for b in blobs]
    return [np.concatenate(x) for x in zip(*([p[0], whole_tags(p[1], len(p[0])), *p[2:]] for p in parts))]


def packed_strings(docs: DataFrame, k: int, buckets: int, hot: Filter) -> DataFrame:
    """(bucket, blob): super-k-mers by bucket of their minimiser, and spans already known to repeat (bucket below 0).

    Before anything is sent, equal super-k-mers of a chunk are merged: only the least document's go on, the others'
    windows are known to repeat; these need no comparison, so each chunk's go whole to a bucket that task and number of the
    chunk choose, as many to one as to another. So copies and common passages cost one string a chunk, not one a document. Strings of
    a hot minimiser are cut into single windows, merged likewise, which spread over all buckets by their own hash.
    """
    held = docs.sparkSession.sparkContext.broadcast(hot)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, batch in enumerate(chunks(batches, size=4 << 20)):
            found = merged_strings(batch, k)
            if found is None:
                continue
            words, at, first, count, minimiser, windows, place, doc, tag, start, repeats = found
            out_bucket, out_blob = [], []
            salt = int(mixed(np.array([task << 32 | number], U64))[0] >> U64(33))
            single = ~repeats & held.value.has(minimiser)
            go = np.flatnonzero(~repeats & ~single)
            alone = np.flatnonzero(np.repeat(single, count))  # windows of the hot strings
            of = np.repeat(np.arange(len(first)), count)[alone]
            again = later(doc[of], windows[alone])
            known = [np.append(doc[repeats], doc[of][again]), np.append(tag[repeats], tag[of][again])]
            known += [np.append(start[repeats], start[of][again] + place[alone][again]).astype(np.int32), np.append(start[repeats] + count[repeats] + k - 1, start[of][again] + place[alone][again] + k).astype(np.int32)]
            if len(known[0]):
                out_bucket.append(-1 - salt % buckets)
                out_blob.append(pack(known))
            alone, of = alone[~again], of[~again]
            bucket = (np.concatenate([mixed(minimiser[go]), mixed(windows[alone])]) % U64(buckets)).astype(np.int64)
            begin, count = np.append(at[first[go]], at[alone]), np.append(count[go], np.ones(len(alone), np.int64))
            occupied, blobs = framed(bucket, np.append(doc[go], doc[of]), np.append(tag[go], tag[of]), np.append(start[go], start[of] + place[alone]), count, words.starts[begin], words.ends[begin + count + k - 2], words.data)
            out_bucket, out_blob = out_bucket + occupied, out_blob + blobs
            yield pa.RecordBatch.from_arrays([pa.array(out_bucket, pa.int32()), pa.array(out_blob, pa.binary())], ["bucket", "blob"])

    return small_batches(docs).mapInArrow(run, "bucket int, blob binary")


def spans_in(table: pa.Table, k: int) -> pa.Table:
    """The spans of windows of one bucket that a document of smaller id also has.

    Windows are sorted by hash; those of one hash are compared by their words' hashes, and where these differ, by the words.
    """
    out = []
    blobs = table.column("blob").to_pylist()
    if table.column("bucket")[0].as_py() < 0:
        out = [unpack(b, SPANS) for b in blobs]
    else:
        doc, tag, start, count, size, data = unframed(blobs)
        count = count.astype(np.int64)
        strings = pa.LargeStringArray.from_buffers(len(size), pa.py_buffer(np.concatenate([[0], np.cumsum(size, dtype=np.int64)]).tobytes()), pa.py_buffer(data))
        words = Words(strings)
        hashes = words.hashes()
        at, offsets = run_starts(words.of, k)
        window = rolled(hashes, k)[at]
        owner = np.repeat(np.arange(len(doc)), count)
        order = np.lexsort((doc[owner], window))
        same = np.zeros(len(order), dtype=bool)
        same[1:] = window[order][1:] == window[order][:-1]
        head = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
        later = doc[owner[order]] > doc[owner[head]]
        flagged, source = order[later], head[later]
        differ = np.zeros(len(flagged), dtype=bool)
        for j in range(k):
            differ |= hashes[at[flagged] + j] != hashes[at[source] + j]
        if differ.any():  # two sequences under one hash: settle these by the words themselves
            clash = np.isin(window, window[flagged[differ]])
            text = {i: data[words.starts[at[i]] : words.ends[at[i] + k - 1]].tobytes().split() for i in np.flatnonzero(clash)}
            least: dict[tuple, int] = {}
            for i, w in text.items():
                least[tuple(w)] = min(least.get(tuple(w), LAST), int(doc[owner[i]]))
            flagged = np.concatenate([flagged[~clash[flagged]], [i for i, w in text.items() if doc[owner[i]] > least[tuple(w)]]]).astype(np.int64)
        flagged = np.sort(flagged)
        if len(flagged):
            new = np.ones(len(flagged), dtype=bool)
            new[1:] = (np.diff(flagged) != 1) | (owner[flagged][1:] != owner[flagged][:-1])
            begin = flagged[new]
            length = np.diff(np.append(np.flatnonzero(new), len(flagged)))
            o = owner[begin]
            begin = (start[o] + begin - offsets[o]).astype(np.int32)
            out = [[doc[o], tag[o], begin, (begin + length + k - 1).astype(np.int32)]]
    columns = [np.concatenate(x) for x in zip(*out)] if out else [np.zeros(0, t) for t in SPANS]
    release()
    return pa.table({"__doc": columns[0], "__tag": columns[1], "start": columns[2], "end": columns[3]})


def repeated_spans(docs: DataFrame, k: int = 13, buckets: int | None = None) -> DataFrame:
    """Per document with repeats: __doc (doc_id, a null as the greatest number), __tag, spans of words [start, end).

    The number of buckets follows from the bytes of all texts, so that a bucket doesn't grow with the corpus; the same
    for the number of partitions that buckets are dealt to. A chunk sends a frame to each bucket that it has
    strings for, so at most as many as it has strings. Equal strings of a chunk are merged by two 64-bit sums of
    their windows' hashes.
    """
    tagged = docs.select(F.col("doc_id").cast("long"), tag().alias("tag"), "text")
    least = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    size = tagged.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(6 * least, -(-EXPANSION * size // BUCKET_BYTES))
    strings = packed_strings(tagged, k, buckets, hot_minimisers(tagged, k, buckets))
    spans = strings.repartition(max(least, buckets // 8), "bucket").groupBy("bucket").applyInArrow(lambda t: spans_in(t, k), "__doc long, __tag long, start int, end int")
    lists = spans.groupBy("__doc", "__tag").agg(F.collect_list(F.struct("start", "end")).alias("spans"))
    return lists.mapInArrow(merged, "__doc long, __tag long, spans array<struct<start: int, end: int>>")


def merged(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each document's spans joined where they meet, in order."""
    for batch in batches:
        spans = batch.column("spans")
        row = np.repeat(np.arange(batch.num_rows), np.diff(spans.offsets.to_numpy()))
        items = spans.flatten()
        start, end = (items.field(f).to_numpy().astype(np.int64) for f in ("start", "end"))
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        shift = row * (1 << 32)  # rows apart, so that one running maximum serves all
        reach = np.maximum.accumulate(end + shift)
        new = np.ones(len(row), dtype=bool)
        new[1:] = start[1:] + shift[1:] > reach[:-1]
        first = np.flatnonzero(new)
        ends = (np.append(reach[first[1:] - 1], reach[-1:]) - shift[first]).astype(np.int32)
        out = pa.StructArray.from_arrays([pa.array(start[first].astype(np.int32)), pa.array(ends)], ["start", "end"])
        sizes = np.concatenate([[0], np.cumsum(np.bincount(row[first], minlength=batch.num_rows))])
        yield pa.RecordBatch.from_arrays([batch.column("__doc"), batch.column("__tag"), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), out)], ["__doc", "__tag", "spans"])


def tag():
    """64 bits of a text's hash: keeps rows apart that share a doc_id, however many these are."""
    return F.xxhash64("text")


def without_repeats(docs: DataFrame, k: int = 13, buckets: int | None = None, tidy: bool = True, n_words: str = "n_words", n_removed: str = "n_removed") -> DataFrame:
    """``docs`` with ``text`` cut and two more columns, by default ``n_words`` and ``n_removed``; text is the kept words, joined by one space.

    A word goes if a window of ``k`` words of its document covers it and the same sequence also starts in a document of
    smaller doc_id; all windows are those of the input. The first document keeps the passage, also where it repeats
    within it. Rows of equal doc_id don't remove from each other; a null doc_id counts as the greatest. Null and blank
    texts have no words and become empty; texts of fewer than ``k`` words lose nothing. Other columns pass through, those
    that have an added column's name already are replaced. Without ``tidy``, texts that lose nothing stay as they are,
    white space and nulls included.
    """
    spans = staged(repeated_spans(docs, k, buckets))
    columns = others(docs, "text", n_words, n_removed)
    own, mark, list_ = (unused(docs, n) for n in ("own_id", "own_tag", "own_spans"))
    narrow = docs.select(*map(column, columns), column("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(int(LAST))).alias(own), tag().alias(mark))
    spans = spans.select(F.col("__doc").alias(f"{own}_of"), F.col("__tag").alias(f"{mark}_of"), F.col("spans").alias(list_))
    joined = with_small(narrow, spans, (F.col(own) == F.col(f"{own}_of")) & (F.col(mark) == F.col(f"{mark}_of")), "left", F.size(list_)).select(*map(column, columns), "text", list_)
    out = StructType([*joined.schema.fields[: len(columns)], StructField("text", StringType()), StructField(n_words, LongType()), StructField(n_removed, LongType())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[list]:
        for batch in chunks(batches, text=f"c{len(columns)}"):
            texts, counts, removed = [], [], []
            *passed, words_, spans_of = batch.columns
            for text, spans_ in zip(words_.cast(pa.large_binary()).to_pylist(), spans_of.to_pylist()):
                words = (text or b"").split()  # bytes split at 0x20 and 0x09 to 0x0D
                n, kept = len(words), words
                if spans_:
                    gone = np.zeros(n + 1, dtype=np.int32)
                    np.add.at(gone, [s["start"] for s in spans_], 1)
                    np.add.at(gone, [s["end"] for s in spans_], -1)
                    kept = [w for w, g in zip(words, np.cumsum(gone[:n]) > 0) if not g]
                texts.append(b" ".join(kept) if tidy or len(kept) < n else text)
                counts.append(n)
                removed.append(n - len(kept))
            yield [*passed, pa.array(texts, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64()), pa.array(removed, pa.int64())]

    return mapped_by_place(joined, cut, out)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents without 13-word windows that an earlier one has, as digests of what is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS s
  FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM w WHERE len(ws) >= 13)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS d FROM win) WHERE doc_id > d),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM rep, generate_series(0, 12) AS g(j)),
word AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws))) AS p FROM w)),
kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed,
         coalesce(string_agg(CASE WHEN gone.p IS NULL THEN word END, ' ' ORDER BY word.p), '') AS kept
  FROM word LEFT JOIN gone ON gone.doc_id = word.doc_id AND gone.p = word.p GROUP BY word.doc_id)
SELECT w.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id
"""
