"""Reproducible shuffle into shards by a Feistel permutation of global row numbers."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from solvara.llm.textkit import column, others, unused
from solvara.storage import staged

ROUNDS = 6
#: Multiplier of the round function: below 2**31, so that its product with a half of up to 31 bits stays within 63.
ROUND_MULTIPLIER = 1_540_483_477


def round_keys(seed: int) -> list[int]:
    """Keys below 2**31 from a linear congruential sequence."""
    keys, x = [], seed & 0x7FFFFFFF
    for _ in range(ROUNDS):
        x = (x * 1_103_515_245 + 12_345) % 2**31
        keys.append(x)
    return keys


def half_bits(n: int) -> int:
    """Bits of each half of the smallest balanced domain that holds ``n`` rows."""
    return max(1, -(-max(n - 1, 1).bit_length() // 2))


def permuted(rows: np.ndarray, n: int, seed: int, inverse: bool = False) -> np.ndarray:
    """Where each row number below ``n`` goes (or comes from): a Feistel network, walked until it is below ``n`` again."""
    bits = half_bits(n)
    mask = (1 << bits) - 1
    keys = round_keys(seed)

    def once(x: np.ndarray) -> np.ndarray:
        left, right = x >> bits, x & mask
        for key in reversed(keys) if inverse else keys:
            if inverse:
                left, right = right ^ ((left * ROUND_MULTIPLIER + key) >> 13) & mask, left
            else:
                left, right = right, left ^ ((right * ROUND_MULTIPLIER + key) >> 13) & mask
        return (left << bits) | right

    out = once(np.asarray(rows, dtype=np.int64))
    while (outside := np.flatnonzero(out >= n)).size:
        out[outside] = once(out[outside])
    return out


def place_of(rows: np.ndarray, n: int, shards: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Shard and slot of row numbers, with no table."""
    to = permuted(rows, n, seed)
    return to % shards, to // shards


def row_at(shard: np.ndarray, slot: np.ndarray, n: int, shards: int, seed: int) -> np.ndarray:
    """The row number that lies in a slot of a shard."""
    return permuted(np.asarray(slot, dtype=np.int64) * shards + shard, n, seed, inverse=True)


def numbered(df: DataFrame, *order: str, name: str = "row_number") -> tuple[DataFrame, int]:
    """``df`` with a global number ``name`` from 0 by ``order``, and the count. Rows equal in all of ``order`` get any of their numbers.

    Rows are ranged by ``order`` and, within equal ones, by place, so a hot value spreads over tasks; each partition's
    offset comes from one count a partition. The ranged rows are staged, so both uses see the same partitions. ``name``
    must be free in ``df``.
    """
    place, part, at, before = (unused(df, n) for n in ("place", "part", "at", "before"))
    keys = [*map(column, order), column(place)]
    ranged = df.withColumn(place, F.monotonically_increasing_id()).repartitionByRange(*keys).sortWithinPartitions(*keys)
    local = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    kept = staged(ranged.select(*map(column, df.columns), F.spark_partition_id().alias(part), local.alias(at)))
    counts = kept.groupBy(part).agg(F.count("*").alias("n"))
    sums = F.coalesce(F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(part, sums.alias(before))  # a row a partition
    out = kept.join(F.broadcast(offsets), part).withColumn(name, F.col(before) + F.col(at))
    return out.select(*map(column, df.columns), name), kept.count()


def shard_rows(df: DataFrame, shards: int, seed: int, *order: str) -> DataFrame:
    """Add ``row_number``, ``shard`` and ``slot``: counts differ by one at most, slots of a shard run from 0 without gaps.

    Columns of these names that ``df`` has already are replaced, after they ordered the rows where ``order`` names them.
    Null order values come first; repeated rows are rows of their own; an empty table stays empty. ``df`` should be
    narrow: it is sorted and staged once.
    """
    number, to = unused(df, "row_number"), unused(df, "place")
    rows, n = numbered(df, *order, name=number)

    @F.pandas_udf("struct<shard int, slot long>")
    def place(numbers: pd.Series) -> pd.DataFrame:
        shard, slot = place_of(numbers.to_numpy(), n, shards, seed)
        return pd.DataFrame({"shard": shard.astype("int32"), "slot": slot})

    kept = others(df, "row_number", "shard", "slot")
    return rows.withColumn(to, place(number)).select(*map(column, kept), F.col(number).alias("row_number"), f"{to}.shard", f"{to}.slot")


def op3_feistel_shards(spark, sf_dir: str, shards: int = 16, seed: int = 20_240_601) -> DataFrame:
    """All documents in 16 shards under the law ``rows``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    narrow = docs.select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(F.col("text").cast("binary")), F.lit(0)).cast("long").alias("text_crc32"),
    )
    placed = shard_rows(narrow, shards, seed, "doc_id", "text_crc32", "size")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))



def _sql(shards: int = 16, seed: int = 20_240_601) -> str:
    """The same in SQL: CRC-32 byte by byte, the rounds written out, and the walk as a recursion."""
    left, right = "(x >> bits)", "(x & mask)"
    for key in round_keys(seed):
        left, right = right, f"xor({left}, (({right} * {ROUND_MULTIPLIER} + {key}) >> 13) & mask)"
    permuted_ = f"(({left} << bits) | {right})"
    return f"""
WITH RECURSIVE size_ AS (SELECT count(*) AS n, greatest(1, (CAST(floor(log2(greatest(count(*) - 1, 1))) AS BIGINT) + 2) // 2) AS bits FROM documents),
dom AS (SELECT n, bits, (1::BIGINT << bits) - 1 AS mask FROM size_),
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_concat([b], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT doc_id, size, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(size - 1), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT))), lambda c, v: xor(c >> 8, t[xor(c & 255, v) + 1]))) AS text_crc32 FROM d, crc),
r AS (SELECT doc_id, size, CAST(text_crc32 AS BIGINT) AS text_crc32, CAST(row_number() OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS i FROM b),
walk(i, x) AS (SELECT i, {permuted_} FROM (SELECT i, i AS x, bits, mask FROM r, dom) UNION ALL SELECT i, {permuted_} FROM (SELECT walk.*, bits, mask FROM walk, dom WHERE x >= n))
SELECT doc_id, size, text_crc32, 'rows' AS law, CAST(x % {shards} AS INT) AS shard, x // {shards} AS slot, CAST(NULL AS INT) AS grown_shard FROM r JOIN walk USING (i), dom WHERE x < n
"""


OP3_SQL = _sql()
