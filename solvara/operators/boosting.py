"""Boosted trees from histograms of gradients: missing values go where the gain is, rows and features are drawn a tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from solvara.operators.ranking import quantiles, running_totals
from solvara.storage import Files, shared_dir

#: Bins of a feature's values at most (one more is for missing ones), and trees after which the rows' margins are written anew.
BINS, WRITTEN = 64, 20
#: Rows of a block of arrays, and of a partition of blocks at most (a partition a core where that is less).
BLOCK, PARTITION = 16_384, 10_000_000
PENALTY, LEAST_WEIGHT = 1.0, 1.0


@dataclass
class Tree:
    """Nodes in order of level: node i has children 2 i + 1 and 2 i + 2. A node without a feature (-1) is a leaf."""

    feature: np.ndarray
    cut: np.ndarray  # the last bin that goes left
    missing_left: np.ndarray
    value: np.ndarray

    def leaves(self, bins: np.ndarray, levels: int | None = None) -> np.ndarray:
        """The node that each row of binned features (0 for missing) ends in, after so many levels."""
        n, d = bins.shape
        size = len(self.feature)
        at, bin_ = np.arange(size)[:, None], np.arange(256)
        left = np.where(bin_ == 0, self.missing_left[:, None], bin_ <= self.cut[:, None])
        following = np.where(self.feature[:, None] < 0, at, 2 * at + 2 - left).ravel()  # by node and bin
        feature, flat, first = np.maximum(self.feature, 0), bins.ravel(), np.arange(n) * d
        node = np.zeros(n, np.int64)
        for _ in range(int(np.log2(size + 1)) - 1 if levels is None else levels):
            node = following.take(node * 256 + flat.take(first + feature.take(node)))
        return node


@dataclass
class Boosted:
    """Features with the upper edges of their bins, trees, and the gain that each feature brought."""

    features: list[str]
    edges: list[np.ndarray]
    trees: list[Tree] = field(default_factory=list)
    gain: np.ndarray | None = None

    def binned(self, columns: list[np.ndarray]) -> np.ndarray:
        """Values (NaN for missing) as bins from 1, missing ones as 0."""
        return np.stack([np.where(np.isnan(x), 0, np.searchsorted(e, x, side="left") + 1) for x, e in zip(columns, self.edges)], axis=1)

    def margins(self, bins: np.ndarray) -> np.ndarray:
        return sum((t.value[t.leaves(bins)] for t in self.trees), np.zeros(len(bins)))

    def scored(self, df: DataFrame, name: str = "score") -> DataFrame:
        """``df`` with the probability of label 1."""
        model = df.sparkSession.sparkContext.broadcast(self)

        @F.pandas_udf("double")
        def probability(*columns: pd.Series) -> pd.Series:
            return pd.Series(1 / (1 + np.exp(-model.value.margins(model.value.binned([c.to_numpy() for c in columns])))))

        given = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))) for f in self.features]
        return df.select(*[c for c in df.columns if c != name], probability(*given).alias(name))


def bin_edges(train: DataFrame, features: list[str], bins: int = BINS) -> list[np.ndarray]:
    """Distinct inner quantiles of each feature, from one ranged frame of all values; a value goes to the first edge at or above it."""
    items = F.array(*[F.struct(F.lit(i).alias("feature"), F.col(f).cast("double").alias("value")) for i, f in enumerate(features)])
    counts = train.select(F.inline(items)).where("value is not null and not isnan(value)").groupBy("feature", "value").agg(F.count("*").alias("n"))
    cuts = quantiles(running_totals(counts, ["feature"], "value", ["n"]), ["feature"], "value", "n", [b / bins for b in range(1, bins)])
    found = {r.feature: np.unique(np.array(r.cuts)) for r in cuts.collect()}  # a row a feature
    return [found.get(i, np.zeros(0)) for i in range(len(features))]


def drawn(rows: np.ndarray, tree: int, seed: int, share: float) -> np.ndarray:
    """Whether rows, by a number that is theirs, belong to a tree's draw; the same wherever they lie."""
    with np.errstate(over="ignore"):
        x = rows.view(np.uint64) ^ np.uint64((seed * 0x9E3779B97F4A7C15 + tree * 0xD1B54A32D192ED03) % 2**64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) < np.uint64(min(int(share * 2**64), 2**64 - 1))


def best_split(g: np.ndarray, h: np.ndarray) -> tuple[float, int, int, bool] | None:
    """(gain, feature, last bin on the left, whether missing go left) of one node's sums by feature and bin, None without a gain.

    Bin 0 has the missing rows. Of equal gains the first feature, then the least cut, then missing to the left.
    """
    total_g, total_h = g[0].sum(), h[0].sum()
    best = None
    for missing_left in (True, False):
        left_g, left_h = (np.cumsum(x[:, 1:], axis=1)[:, :-1] + (x[:, :1] if missing_left else 0) for x in (g, h))
        right_g, right_h = total_g - left_g, total_h - left_h
        gain = left_g**2 / (left_h + PENALTY) + right_g**2 / (right_h + PENALTY) - total_g**2 / (total_h + PENALTY)
        gain = np.where((left_h >= LEAST_WEIGHT) & (right_h >= LEAST_WEIGHT), gain, -np.inf)
        if gain.size:
            f, cut = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, cut] > 1e-9 and (best is None or gain[f, cut] > best[0] + 1e-12):
                best = float(gain[f, cut]), int(f), int(cut) + 1, missing_left
    return best


def fit(train: DataFrame, features: list[str], label: str, trees: int = 300, depth: int = 4, step: float = 0.05, row_share: float = 0.8, feature_share: float = 0.8, seed: int = 42) -> Boosted:
    """Boosted trees of a logistic loss; positives weigh (1 - p) / p. Rows without a label take no part, one class alone is an error.

    Rows lie as blocks of arrays in as many partitions as there are cores, kept in the executors with their margins. Each level
    of a tree is one job of one stage: tasks add up gradients and second derivatives by node, feature and bin, the driver
    adds the tasks' sums (nodes * features * bins numbers a task) and picks each node's split. A tree's values go into
    the margins once, before the next tree; every ``WRITTEN`` trees these are written to the shared folder, so that
    a lost executor costs a few trees. Null and NaN are a bin of their own that goes to the side of greater gain. Which
    rows and features a tree sees follows from its number and ``seed``.
    """
    rows = train.where(F.col(label).isNotNull())
    n, p = rows.agg(F.count("*"), F.avg(F.col(label).cast("double"))).first()
    if not n or p in (0.0, 1.0):
        raise ValueError("boosted trees need both classes")
    model = Boosted(features, bin_edges(rows, features), gain=np.zeros(len(features)))
    edges = Boosted(features, model.edges)  # what tasks need of it
    width, d = max(len(e) for e in model.edges) + 2, len(features)

    def to_blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []

        def block() -> pa.RecordBatch:
            row, y, bins = (np.concatenate(parts) for parts in zip(*held))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in (row, y, bins)], ["row", "y", "bins"])

        for batch in batches:
            row, y, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            held.append((row, y.astype(np.uint8), edges.binned(columns).astype(np.uint8)))
            if sum(len(x[0]) for x in held) >= BLOCK:
                yield block()
        if held:
            yield block()

    def arrays(r) -> tuple[np.ndarray, ...]:
        row = np.frombuffer(r.row, np.int64)
        return row, np.frombuffer(r.y, np.uint8), np.frombuffer(r.bins, np.uint8).reshape(len(row), d), np.zeros(len(row))

    context = rows.sparkSession.sparkContext
    given = [F.coalesce(F.col(f).cast("double"), F.lit(float("nan"))).alias(f"f{i}") for i, f in enumerate(features)]
    number = F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns]).alias("row")
    spread = rows.select(number, F.col(label).cast("int").alias("y"), *given).repartition(max(context.defaultParallelism, -(-n // PARTITION)), "row")
    if not context.getCheckpointDir():
        shared_dir(rows.sparkSession)
    data = spread.mapInArrow(to_blocks, "row binary, y binary, bins binary").rdd.map(arrays).persist(StorageLevel.MEMORY_AND_DISK)
    before, written = None, None

    rng = np.random.default_rng(seed)
    for number in range(trees):
        chosen = np.sort(rng.choice(d, max(1, round(feature_share * d)), replace=False))
        size = 2 ** (depth + 1) - 1
        tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size, bool), np.zeros(size))
        sums: dict[int, tuple[float, float]] = {}
        open_ = [0]
        for level in range(depth):

            def histograms(blocks: Iterable[tuple[np.ndarray, ...]], tree=tree, level=level, number=number, chosen=chosen) -> Iterator[np.ndarray]:
                first = 2**level - 1
                total = np.zeros((2, 2**level, len(chosen), width))
                for row, y, bins, margin in blocks:
                    q = 1 / (1 + np.exp(-margin))
                    node = tree.leaves(bins, level) - first
                    weight = np.where(y == 1, (1 - p) / p, 1.0) * (drawn(row, number, seed, row_share) & (node >= 0))
                    at, w = np.maximum(node, 0) * width, (weight * (q - y), weight * q * (1 - q))
                    for k, f in enumerate(chosen):
                        place = at + bins[:, f]
                        for part in range(2):
                            total[part, :, k] += np.bincount(place, w[part], 2**level * width).reshape(-1, width)
                yield total

            g, h = np.sum(data.mapPartitions(histograms).collect(), axis=0)  # an array a task
            if before is not None:  # the rows with the new margins are in place
                before.unpersist()
                before = None
                if data.isCheckpointed():
                    if written:
                        Files(rows.sparkSession, written).delete("")
                    written = data.getCheckpointFile()
            following = []
            for node in open_:
                own = node - (2**level - 1)
                if level == 0:
                    sums[0] = float(g[0, 0].sum()), float(h[0, 0].sum())
                split = best_split(g[own], h[own])
                if split is None:
                    continue
                gain, k, cut, missing_left = split
                tree.feature[node], tree.cut[node], tree.missing_left[node] = chosen[k], cut, missing_left
                model.gain[chosen[k]] += gain
                left = tuple(float(x[own, k, 1 : cut + 1].sum() + (x[own, k, 0] if missing_left else 0)) for x in (g, h))
                sums[2 * node + 1], sums[2 * node + 2] = left, (sums[node][0] - left[0], sums[node][1] - left[1])
                following += [2 * node + 1, 2 * node + 2]
            open_ = following
            if not open_:
                break
        for node, (a, b) in sums.items():
            tree.value[node] = -step * a / (b + PENALTY)
        model.trees.append(tree)
        if number + 1 < trees:

            def moved(block: tuple[np.ndarray, ...], tree=tree) -> tuple[np.ndarray, ...]:
                row, y, bins, margin = block
                return row, y, bins, margin + tree.value[tree.leaves(bins)]

            before, data = data, data.map(moved).persist(StorageLevel.MEMORY_AND_DISK)
            if (number + 1) % WRITTEN == 0:
                data.checkpoint()
    data.unpersist()
    if written:
        Files(rows.sparkSession, written).delete("")
    return model


def importance(model: Boosted, df: DataFrame) -> DataFrame:
    """(feature, gain), greatest first; a row a feature."""
    return df.sparkSession.createDataFrame(list(zip(model.features, map(float, model.gain))), "feature string, gain double").orderBy(F.desc("gain"), "feature")
