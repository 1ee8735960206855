"""Exact removal of repeated lines: hashes range-partitioned, sorted by document and position, streamed; native SQL functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from solvara.llm.joins import with_small
from solvara.llm.textkit import column, others, unused
from solvara.storage import staged

#: What is stripped from a line's ends, and the letters that are lowered.
BLANKS, UPPER, LOWER = " \t\n\x0b\x0c\r", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: A hash that takes more than 1 / (8 * partitions) of the lines is cut up; so many rows of the routing sample show it.
CUTS, SHOWN = 8, 64
_HASH = ("h1", "h2")
_DOC = ("doc_id", "text_hash")


def lines_of(text: Column) -> Column:
    """The lines of a text; null is one empty line."""
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_hashes(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, text_hash, pos, h1, h2): a row for each line whose key has ``min_chars`` code points or more.

    The key is hashed to 128 bits. Only ASCII letters are lowered: where a text has no others, by ``lower``, which is faster.
    """
    text = F.col("text")
    lowered = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.posexplode(lines_of(lowered)).alias("pos", "line"))
    keys = lines.select(*_DOC, "pos", F.btrim("line", F.lit(BLANKS)).alias("key")).where(F.length("key") >= min_chars)
    return keys.select(*_DOC, "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _hot(lines: DataFrame) -> DataFrame:
    """(h1, h2, cuts): hashes of so many lines that one task shouldn't have them, and into how many parts each goes.

    It only decides where rows travel, never what happens to them. A sample by hash, about CUTS * SHOWN rows a partition,
    has SHOWN rows of each such hash, so at most CUTS hashes a partition come out; the cuts add up to as many at most.
    """
    partitions = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    share = max(1, lines.count() // (CUTS * SHOWN * partitions))
    drawn = lines.where(F.pmod(F.xxhash64(*_HASH, *_DOC, "pos"), F.lit(share)) == 0)
    return drawn.groupBy(*_HASH).agg((F.count("*") / SHOWN).cast("int").alias("cuts")).where("cuts > 0")


def _varint(n: Column) -> Column:
    """Hexadecimal digits of a number as bytes of seven bits, least first, the high bit set on all but the last."""
    n, out = n.cast("long"), []
    for k in range(5):
        bits = F.shiftright(n, 7 * k).bitwiseAND(F.lit(127))
        more, here = n >= (1 << 7 * (k + 1)), n >= (1 << 7 * k) if k else F.lit(True)
        out.append(F.when(more, F.lpad(F.hex(bits.bitwiseOR(F.lit(128))), 2, "0")).when(here, F.lpad(F.hex(bits), 2, "0")).otherwise(""))
    return F.concat(*out)


def packed(positions: Column) -> Column:
    """A sorted array of dropped positions as a compressed bitmap: run lengths, kept and dropped in turn, as varints."""
    starts = F.array_compact(F.zip_with(positions, F.concat(F.array(F.lit(-2)), positions), lambda x, before: F.when(x > before + 1, x)))
    ends = F.array_compact(F.zip_with(positions, F.slice(positions, 2, F.size(positions)), lambda x, after: F.when(after.isNull() | (after > x + 1), x)))
    kept = F.array_compact(F.zip_with(starts, F.concat(F.array(F.lit(-1)), ends), lambda s, e: s - e - 1))
    dropped = F.zip_with(starts, ends, lambda s, e: e - s + 1)
    return F.unhex(F.array_join(F.zip_with(kept, dropped, lambda k, d: F.concat(_varint(k), _varint(d))), ""))


def unpacked(bitmap: Column) -> Column:
    """A compressed bitmap as an array of booleans, up to its last dropped line; whatever comes after that is kept."""

    def number(digits: Column) -> Column:
        byte = lambda k: F.conv(F.substring(digits, 2 * k + 1, 2), 16, 10).cast("long")
        total = F.lit(0).cast("long")
        for k in range(5):
            total = total + F.when(F.length(digits) > 2 * k, F.shiftleft(byte(k).bitwiseAND(F.lit(127)), 7 * k)).otherwise(F.lit(0))
        return total.cast("int")

    runs = F.transform(F.regexp_extract_all(F.hex(bitmap), F.lit("((?:[89A-F][0-9A-F])*[0-7][0-9A-F])"), 1), number)
    return F.flatten(F.transform(runs, lambda n, i: F.array_repeat(i % 2 == 0, n)))


def keep_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, text_hash, n_dropped, keep_bitmap) of each document that loses lines; the others keep all.

    A line's key is the line without blanks at its ends, ASCII letters lowered. Keys of ``min_chars`` code points or more
    that ``min_docs`` documents or more have lose all their lines; with ``keep_first`` the first by document id, text hash
    and position stays. ``text_hash`` is Spark's xxhash64 of the text: rows of one id with unlike texts are documents of
    their own, equal rows are one document. A null id is an id (the least). Null and empty texts are one empty line.

    Lines travel as 128-bit hashes, ranged by hash, and are streamed in the order of hash, document and position, counting
    documents. A hash with a large share of all lines is cut into parts for that; each part reports its first ``min_docs``
    documents, and these few rows settle the hash. Only lines that go travel on to their document.
    """
    lines = staged(line_hashes(docs, min_chars))
    hot = staged(_hot(lines))
    part = F.when(F.col("cuts").isNotNull(), F.pmod(F.xxhash64(*_DOC, "pos"), F.col("cuts"))).alias("part")
    routed = lines.join(F.broadcast(hot), list(_HASH), "left").select(*_HASH, part, *_DOC, "pos")  # CUTS rows a partition
    run = Window.partitionBy(*_HASH, "part")
    stream = run.orderBy(*_DOC, "pos")
    before = lambda c: F.lag(c).over(stream)
    new = (F.row_number().over(stream) == 1) | ~before("doc_id").eqNullSafe(F.col("doc_id")) | (before("text_hash") != F.col("text_hash"))
    ranged = routed.repartitionByRange(*_HASH, "part").withColumns({"nth": F.row_number().over(stream), "new": new})
    counted = ranged.withColumn("docs", F.count_if("new").over(stream)).withColumn("of", F.max("docs").over(run))
    candidates = staged(counted.where(F.col("part").isNotNull() | (F.col("of") >= min_docs)))
    place = F.struct(*_DOC, "pos")
    seen = candidates.where(F.col("part").isNotNull() & F.col("new") & (F.col("docs") <= min_docs))
    fates = seen.groupBy(*_HASH).agg((F.count_distinct(F.struct(*_DOC)) >= min_docs).alias("goes"), F.min(F.when(F.col("nth") == 1, place)).alias("first"))
    gone = candidates.join(F.broadcast(fates), list(_HASH), "left").where(F.coalesce("goes", F.lit(True)))  # CUTS rows a partition
    if keep_first:
        gone = gone.where(~((F.col("nth") == 1) & (F.col("first").isNull() | F.col("first").eqNullSafe(place))))
    positions = gone.groupBy(*_DOC).agg(F.sort_array(F.collect_set("pos")).alias("positions"))
    return positions.select(*_DOC, F.size("positions").cast("long").alias("n_dropped"), packed(F.col("positions")).alias("keep_bitmap"))


def without_lines(docs: DataFrame, bitmaps: DataFrame, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with ``bitmaps`` applied to ``text``, its number of lines before, and that of lines dropped.

    Columns of these two names are replaced, whatever the case of their letters; others stay. A null text becomes empty.
    """
    own, mark, lost, bits = (unused(docs, n) for n in ("own_id", "own_hash", "lost", "bits"))
    small = staged(bitmaps.select(F.col("doc_id").alias(own), F.col("text_hash").alias(mark), F.col("n_dropped").alias(lost), F.col("keep_bitmap").alias(bits)))
    both = with_small(docs, small, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (F.xxhash64("text") == F.col(mark)), "left", (F.octet_length(bits) / 8).cast("long"))
    lines = lines_of(F.col("text"))
    kept = F.array_join(F.zip_with(lines, unpacked(F.col(bits)), lambda line, keep: F.when(F.coalesce(keep, F.lit(True)), line)), "\n")
    text = F.when(F.col(bits).isNull(), F.coalesce("text", F.lit(""))).otherwise(kept).alias("text")
    names = others(docs, n_lines, n_dropped)
    return both.select(*[text if c == "text" else column(c) for c in names], F.size(lines).cast("long").alias(n_lines), F.coalesce(lost, F.lit(0)).cast("long").alias(n_dropped))


def op11_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Documents without the lines that ten or more documents have, as a digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return without_lines(docs, keep_bitmaps(docs)).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT DISTINCT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, text, unnest(ls) AS line, generate_subscripts(ls, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM (SELECT DISTINCT doc_id, text, key FROM k) WHERE length(key) >= 1 GROUP BY key HAVING count(*) >= 10),
r AS (SELECT doc_id, text, count(*) AS n_lines, count(f.key) AS n_dropped, coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (f.key IS NULL), '') AS kept FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id, text)
SELECT documents.doc_id, CAST(n_lines AS BIGINT) AS n_lines, CAST(n_dropped AS BIGINT) AS n_dropped, sha256(kept) AS kept_sha256
FROM documents JOIN r ON documents.doc_id IS NOT DISTINCT FROM r.doc_id AND documents.text IS NOT DISTINCT FROM r.text
"""
