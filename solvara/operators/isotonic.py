"""Isotonic calibration without a central step: adjacent violators pooled by score range, then over the ranges' blocks."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.operators.ranking import running_totals
from solvara.storage import staged

BLOCKS = "lo double, hi double, w double, s double"
#: Knots up to this number are broadcast to the scores that they calibrate; more are joined by shuffle.
BROADCAST_KNOTS = 500_000


def pool(lo: np.ndarray, hi: np.ndarray, w: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, ...]:
    """Blocks in order of score, merged until their means s / w rise. Each pass merges whole falling or level runs."""
    while len(w) > 1:
        rises = s[1:] * w[:-1] > s[:-1] * w[1:]
        if rises.all():
            break
        first = np.flatnonzero(np.append(True, rises))
        last = np.append(first[1:], len(w)) - 1
        lo, hi, w, s = lo[first], hi[last], np.add.reduceat(w, first), np.add.reduceat(s, first)
    return lo, hi, w, s


def pooled_ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One task's sorted blocks, pooled batch by batch: what is held is the pooled blocks so far."""
    held = tuple(np.zeros(0) for _ in range(4))
    for batch in batches:
        held = pool(*(np.concatenate([a, b.to_numpy()]) for a, b in zip(held, batch.columns)))
    yield pa.RecordBatch.from_arrays([pa.array(x) for x in held], ["lo", "hi", "w", "s"])


def fit(df: DataFrame, label: str, score: str) -> DataFrame:
    """The fitted blocks (lo, hi, value): mean label of each block of scores, rising.

    Equal scores are one point. Points are ranged by score and pooled in each range; while neighbouring ranges still
    violate, which the first and last block of each range tell, their blocks are ranged anew, over two thirds as many
    tasks, and pooled again. Pooling in any order gives the same fit. Rows without label or score, or with NaN, take no
    part; no rows give no blocks.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    points = rows.groupBy(F.col(score).cast("double").alias("lo")).agg(F.count("*").cast("double").alias("w"), F.sum(F.col(label).cast("double")).alias("s"))
    blocks = staged(points.select("lo", F.col("lo").alias("hi"), "w", "s"))
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while True:
        ranged = blocks.repartitionByRange(tasks, "lo").sortWithinPartitions("lo").mapInArrow(pooled_ranges, BLOCKS)
        blocks = staged(ranged.withColumn("task", F.spark_partition_id()))
        ends = blocks.groupBy("task").agg(F.min("lo").alias("lo"), *[F.min_by(F.col("s") / F.col("w"), "lo").alias("first"), F.max_by(F.col("s") / F.col("w"), "lo").alias("last")])
        ends = ends.orderBy("lo").collect()  # a row a task
        if all(b.first > a.last for a, b in zip(ends, ends[1:])):
            return blocks.select("lo", "hi", (F.col("s") / F.col("w")).alias("value"))
        tasks = max(1, tasks * 2 // 3)
        blocks = blocks.drop("task")


def apply(df: DataFrame, blocks: DataFrame, score: str, name: str = "calibrated") -> DataFrame:
    """``df`` with the fitted value of each score: straight lines between blocks, and the nearest value outside them.

    The last knot at or below each distinct score is found by its rank, a running count of knots over score ranges. A null
    or NaN score, or a fit without blocks, has a null value.
    """
    ends = F.array_distinct(F.array("lo", "hi"))
    knots = blocks.select(F.explode(ends).alias("x"), F.col("value").alias("y"), F.lit(1).alias("k"))
    places = df.where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double"))).select(F.col(score).cast("double").alias("x")).distinct()
    both = knots.unionByName(places.select("x", F.lit(None).cast("double").alias("y"), F.lit(0).alias("k")))
    counts = both.groupBy(F.lit(1).alias("all"), "x").agg(F.max("y").alias("y"), F.sum("k").alias("k"), F.count_if(F.col("k") == 0).alias("asked"))
    frame = staged(running_totals(counts, ["all"], "x", ["k"]).select("x", "y", "k", "asked", (F.col("before_k") + F.col("k")).alias("rank")))
    named = frame.where("k = 1").select("rank", "x", "y")
    after = named.select((F.col("rank") - 1).alias("rank"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    lines = staged(named.withColumnsRenamed({"x": "x1", "y": "y1"}).join(after, "rank", "full"))  # rank 0 has only what comes after
    asked = frame.where("asked > 0").select(F.col("x").alias("__x"), "rank")
    small = lines.count() <= BROADCAST_KNOTS
    found = asked.join(F.broadcast(lines) if small else lines, "rank", "left")
    line = F.col("y1") + (F.col("y2") - F.col("y1")) * (F.col("__x") - F.col("x1")) / (F.col("x2") - F.col("x1"))
    value = F.when(F.col("x1").isNull(), F.col("y2")).when(F.col("x2").isNull() | (F.col("__x") == F.col("x1")), F.col("y1")).otherwise(line)
    return df.join(found.select("__x", value.alias(name)), F.col(score).cast("double") == F.col("__x"), "left").drop("__x")
