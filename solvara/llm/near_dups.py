"""Near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.llm.joins import components, with_small
from solvara.llm.textkit import U64, WORDS_IN_SHINGLE, Words, chunks, mixed, multipliers, rolled, run_starts, small_batches
from solvara.storage import staged

#: 64 permutations give 128 values (the least and the greatest under each), 4 a band: 32 bands. A pair at a similarity
#: of 0.75 shares none of them with a probability of (1 - 0.75**4)**32, or 5e-6.
PERMUTATIONS, BAND_ROWS = 64, 4
SHORT = U64(0x5851F42D4C957F2D)
#: Shingles in a block of the block-wise comparison, about.
BLOCK_SHINGLES = 1 << 16


def shingle_sets(column: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of ``k``-word shingles of lower-cased texts, sorted by text, and their offsets.

    A text of fewer words has its whole sequence as its one shingle; one without words, or a null, has none.
    """
    words = Words(column, lower=True)
    hashes = words.hashes()
    at, offsets = run_starts(words.of, k)
    shingles = rolled(hashes, k)[at]
    sets = []
    for i, count in enumerate(words.counts()):
        if count >= k:
            sets.append(np.unique(shingles[offsets[i] : offsets[i + 1]]))
        elif count:
            own = hashes[words.of[i] : words.of[i + 1]] * WORDS_IN_SHINGLE[:count] + SHORT  # added once a word: tells lengths apart
            sets.append(mixed(own.sum(keepdims=True)))
        else:
            sets.append(np.zeros(0, dtype=U64))
    return np.concatenate([np.zeros(0, dtype=U64), *sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def set_keys(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """128 bits that equal sets share: two sums of differently mixed members."""
    sums = [np.concatenate([np.zeros(1, U64), np.cumsum(mixed(values ^ salt))]) for salt in multipliers(3, 2)]
    return np.stack([s[offsets[1:]] - s[offsets[:-1]] for s in sums], axis=1)


def band_hashes(values: np.ndarray, starts: np.ndarray, permutations: int, rows: int) -> np.ndarray:
    """A row of band hashes for each non-empty set that starts at ``starts``: bands of least values, then of greatest."""
    if not len(starts):
        return np.zeros((0, 2 * permutations // rows), dtype=np.int64)
    members = (values >> U64(32)).astype(np.uint32)
    factors, shifts = multipliers(4, permutations).astype(np.uint32), (multipliers(5, permutations) >> U64(32)).astype(np.uint32)
    least, most = np.empty((permutations, len(starts)), np.uint32), np.empty((permutations, len(starts)), np.uint32)
    for i in range(permutations):
        under = members * (factors[i] | np.uint32(1)) + shifts[i]
        least[i], most[i] = np.minimum.reduceat(under, starts), np.maximum.reduceat(under, starts)
    signature = np.concatenate([least, most]).astype(U64).reshape(-1, rows, len(starts))
    weights, salts = multipliers(6, rows), multipliers(7, len(signature))
    return mixed((mixed(signature + U64(1)) * weights[None, :, None]).sum(axis=1, dtype=U64) + salts[:, None]).T.view(np.int64)


def sketches(docs: DataFrame, k: int, permutations: int, rows: int) -> DataFrame:
    """For each row: doc_id, text_hash, n_shingles, set_key (null for an empty set), bands."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            values, offsets = shingle_sets(batch.column("text"), k)
            counts = np.diff(offsets)
            full = counts > 0
            bands = band_hashes(values, offsets[:-1][full], permutations, rows)
            width = np.where(full, bands.shape[1], 0)
            keys = set_keys(values, offsets)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id").cast(pa.int64()),
                batch.column("text_hash"),
                pa.array(counts),
                pa.array([key.tobytes() if f else None for key, f in zip(keys, full)], pa.binary()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width)]), pa.int32()), pa.array(np.ascontiguousarray(bands).reshape(-1))),
            ], ["doc_id", "text_hash", "n_shingles", "set_key", "bands"])

    columns = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    return small_batches(columns).mapInArrow(run, "doc_id long, text_hash long, n_shingles long, set_key binary, bands array<long>")


#: Stands for a null doc_id where rows are looked up.
NO_ID = (1 << 63) - 1


def shingles_of(docs: DataFrame, wanted: DataFrame, k: int) -> DataFrame:
    """(cid, n, shingles) of the classes in ``wanted`` (cid, key_id, key_hash, set_key), recomputed from one row of each.

    The row is found by its doc_id and its text's hash, so rows that share an id, or have none, don't meet all classes of
    it; of copies that share both, a task goes on with one.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in chunks(batches):
            cids = batch.column("cid").to_pylist()
            fresh = [i for i, c in enumerate(cids) if not (c in done or done.add(c))]
            batch = batch.take(pa.array(fresh, pa.int64()))
            values, offsets = shingle_sets(batch.column("text"), k)
            keys = set_keys(values, offsets)
            same = np.array([key.tobytes() == want for key, want in zip(keys, batch.column("set_key").to_pylist())], dtype=bool)
            sets = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values.view(np.int64)))
            out = pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(np.diff(offsets)), sets], ["cid", "n", "shingles"])
            yield out.filter(pa.array(same))

    own = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key_id"), F.xxhash64("text").alias("key_hash"), "text")
    texts = with_small(own, wanted, ["key_id", "key_hash"])
    found = staged(small_batches(texts.select("cid", "set_key", "text")).mapInArrow(run, "cid long, n long, shingles array<long>"))
    if found.count() > wanted.count():  # copies with one doc_id in several tasks
        found = staged(found.dropDuplicates(["cid"]))
    return found


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    left = sets.select(F.col("cid").alias("a"), F.col("n").alias("na"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("cid").alias("b"), F.col("n").alias("nb"), F.col("shingles").alias("sb"))
    sized = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).select("a", "b")
    both = sized.join(left, "a").join(right, "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(100 * shared >= percent * (F.col("na") + F.col("nb") - shared)).select("a", "b")


def rest_links(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between different components within a bucket, for the members (bucket, cid, component) left over.

    In each bucket all members outside its largest component meet all members, in blocks of about BLOCK_SHINGLES: a
    block pair is a group, so no group grows with the bucket. Only links leave the comparison.
    """
    sized = members.join(sets.select("cid", "n"), "cid")
    by = sized.groupBy("bucket", "component").agg(F.sum("n").alias("s"))
    main = staged(by.groupBy("bucket").agg(F.max_by("component", F.struct("s", "component")).alias("main"), F.max("s").alias("most"), F.sum("s").alias("all")))
    blocks = main.select("bucket", "main", F.ceil(F.col("all") / BLOCK_SHINGLES).cast("int").alias("ny"), F.ceil((F.col("all") - F.col("most")) / BLOCK_SHINGLES).cast("int").alias("nx"))
    at = sized.join(blocks, "bucket")
    spot = F.xxhash64("cid")
    ys = at.select("bucket", "cid", "component", F.explode(F.sequence(F.lit(0), F.col("nx") - 1)).alias("x"), F.pmod(spot, "ny").cast("int").alias("y"), F.lit(False).alias("asks"))
    xs = at.where("component <> main").select("bucket", "cid", "component", F.pmod(spot, "nx").cast("int").alias("x"), F.explode(F.sequence(F.lit(0), F.col("ny") - 1)).alias("y"), F.lit(True).alias("asks"))
    both = xs.unionByName(ys).join(sets, "cid")

    def compare(table: pa.Table) -> pa.Table:
        asks = np.array(table.column("asks").to_pylist(), dtype=bool)
        cid, comp, n = (table.column(c).to_numpy() for c in ("cid", "component", "n"))
        lists = table.column("shingles").to_pylist()
        qs, ds = np.flatnonzero(asks), np.flatnonzero(~asks)
        found: list[tuple[int, int]] = []
        if len(qs) and len(ds):
            values = np.concatenate([np.asarray(lists[i], dtype=np.int64) for i in qs])
            owner = np.repeat(np.arange(len(qs)), n[qs])
            order = np.argsort(values, kind="stable")
            values, owner = values[order], owner[order]
            for d in ds:
                mine = np.asarray(lists[d], dtype=np.int64)
                low, high = np.searchsorted(values, mine, "left"), np.searchsorted(values, mine, "right")
                lengths = high - low
                hits = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(low, lengths)
                shared = np.bincount(owner[hits], minlength=len(qs))
                good = (100 * shared >= percent * (n[qs] + n[d] - shared)) & (comp[qs] != comp[d])
                _, one = np.unique(comp[qs][good], return_index=True)  # a link to each other component is enough
                found += [(int(cid[q]), int(cid[d])) for q in qs[good][one]]
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return both.groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 75, permutations: int = PERMUTATIONS, rows: int = BAND_ROWS) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id, kept, text_hash (xxhash64 of the text).

    Equal shingle sets form a class and go on as one, by a grouped aggregation. Classes that share a band are candidates:
    first each is held against its bucket's first class (its least such first, the others where these left two
    components), then, in buckets that still hold several components, the rest block by block. So large groups of
    copies cost about their size, and no pair within a bucket that could join two components goes unchecked.

    Nulls: a null or blank text has no shingles, links with nothing and is its own component. A null doc_id takes part;
    it counts as greater than any other, and a component of such rows alone has a null id and keeps them. Rows that
    repeat a doc_id are rows of their own: kept says only that doc_id is its component's least. Extra columns are
    ignored. An empty table gives an empty result.
    """
    rows_table = staged(sketches(docs, k, permutations, rows))
    grouped = rows_table.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.min_by("text_hash", F.coalesce("doc_id", F.lit(NO_ID))).alias("key_hash"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    classes = staged(grouped.withColumn("cid", F.monotonically_increasing_id()))
    entries = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    shared = staged(entries.groupBy("bucket").agg(F.min("cid").alias("first"), F.min_by("n", "cid").alias("first_n"), F.count("*").alias("m")).where("m > 1"))
    members = staged(entries.join(shared, "bucket").where("cid <> first").select("bucket", "cid", "n", "first", "first_n", "m"))
    stars = staged(members.groupBy(F.col("cid").alias("a"), F.col("first").alias("b")).agg(F.first("n").alias("na"), F.first("first_n").alias("nb")))
    met = staged(members.select("cid").union(members.select("first")).distinct().join(classes, "cid").select("cid", F.coalesce("rep", F.lit(NO_ID)).alias("key_id"), "key_hash", "set_key"))
    sets = shingles_of(docs, met, k)

    first = stars.groupBy("a").agg(F.min(F.struct("b", "na", "nb")).alias("s")).select("a", "s.*")
    levels: list[DataFrame] = []  # components of classes, then components of these by further links, and so on

    def component(df: DataFrame, node: str, name: str) -> DataFrame:
        df = df.withColumn(name, F.col(node))
        for level in levels:
            df = df.join(level.select(F.col("node").alias(name), F.col("component").alias("further")), name, "left").withColumn(name, F.coalesce("further", name)).drop("further")
        return df

    def add(links: DataFrame) -> None:
        levels.append(staged(components(component(component(links, "a", "ca"), "b", "cb").select(F.col("ca").alias("a"), F.col("cb").alias("b")))))

    add(confirmed(first, sets, percent))
    tested = first.select("a", "b", F.lit(True).alias("tested"))
    more = component(component(stars, "a", "ca"), "b", "cb").where("ca <> cb").join(tested, ["a", "b"], "left_anti").drop("ca", "cb")
    add(staged(confirmed(more, sets, percent)))

    several = component(members.where("m > 2"), "cid", "component")
    mixed_buckets = staged(several.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("bucket"))
    rest = staged(several.select("bucket", "cid", "component").join(mixed_buckets, "bucket", "left_semi"))
    if not rest.isEmpty():
        add(staged(rest_links(rest, sets, percent)))

    named = staged(component(classes.select("cid", "set_key", "rep"), "cid", "component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    by_key = staged(named.join(least, "component").select("set_key", F.col("component_id").alias("__c"), F.lit(True).alias("__known")))
    out = rows_table.drop("bands").join(by_key, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("__known"), F.col("__c")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "text_hash")


def op6_near_dups(spark, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


OP6_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, CASE WHEN len(ws) < 5 THEN array_to_string(ws, ' ') ELSE array_to_string(ws[i:i+4], ' ') END AS sh, (len(ws) < 5) AS short
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.short = b.short AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r(node, seen) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON r.seen = e.a)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN (SELECT node, min(seen) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
