"""Distributed Isolation Forest (Liu, Ting, Zhou: Isolation Forest, ICDM 2008).

Random numbers are addressed, not drawn: each is a piece of the MD5 of the seed and of what it decides on (an order and a pick, or a
tree and a node), so any engine that knows MD5 finds the same forest. Every row may enter the bag of every tree: hashes of the
order id say how many bags a row is drawn for and which, so a row costs few hashes and only drawn ones go on, about two bags per
tree at any size of the table. Neither partitioning nor the order of rows matters. Trees are grown one per group of at most 256
rows; path lengths are whole billionths, so their sums are exact. The forest (trees x 511 nodes
at most) is broadcast, and all rows are scored once, by an Arrow UDF without a shuffle, into a staged table.
The cut for a contamination share is an exact quantile of the unrounded scores.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewatch.config import DetectorConfig, check_contamination
from tidewatch.functions.rounding import round_even
from tidewatch.operators.quantiles import single_quantiles
from tidewatch.schema import MODEL_FEATURES
from tidewatch.sources.staging import stage

MIN_ROWS = 10
MAX_BAG = 256
UNIT = 1_000_000_000  # path lengths are counted in these parts
NODE_SCHEMA = "tree int, node int, feature int, threshold double, path long, bag int"


@dataclass(frozen=True)
class Forest:
    """Complete binary trees by level; a leaf repeats itself down to the last level."""

    feature: np.ndarray
    threshold: np.ndarray
    path: np.ndarray
    height: int
    bag: int


def _hashed(*of: Column) -> Column:
    """52 bits of the MD5 of the arguments, which are joined by colons."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[c.cast("string") for c in of])), 1, 13), 16, 10).cast("long")


def _drawn_bags(share: float, trees: int, seed: int) -> Column:
    """The trees that a row is drawn for: each with probability ``share``, independently of the others.

    A Poisson number of even picks among the trees hits each of them independently; its mean is
    chosen so that a tree is hit at all with the wanted probability.
    """
    mean = -trees * math.log1p(-min(share, 1 - 1e-9))
    term, total, steps, k = math.exp(-mean), 0.0, [], 0
    if mean > 500:  # exp underflows: the count is then as good as always the mean
        steps = [0.0] * math.ceil(mean)
    while mean <= 500 and (total < 1 - 1e-16 and k < mean + 40 * math.sqrt(mean + 1)):
        total += term
        steps.append(total)
        k += 1
        term *= mean / k
    order = F.coalesce(F.col("order_id"), F.lit(""))
    u = _hashed(F.lit(seed), order, F.lit(0)) / float(1 << 52)
    picks = F.size(F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: s < u))
    tree = lambda j: (_hashed(F.lit(seed), order, j) % trees).cast("int")
    return F.when(picks > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), picks), tree)))


def mean_path(n: float) -> float:
    """Average path length of an unsuccessful search among n points."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (math.log(n - 1) + np.euler_gamma) - 2.0 * (n - 1) / n


def bags(base: DataFrame, features: list[str], rows: int, trees: int, seed: int, share_factor: float = 2.0) -> DataFrame:
    """``min(256, rows)`` rows per tree, chosen by hash."""
    bag = min(MAX_BAG, rows)
    picked = base.select(
        "order_id", *[F.col(f).cast("double").alias(f) for f in features],
        F.explode(_drawn_bags(share_factor * bag / rows, trees, seed)).alias("tree"),
    )
    drawn = picked.withColumn("h", _hashed(F.lit("bag"), F.lit(seed), F.coalesce("order_id", F.lit("")), F.col("tree")))
    # About two bags of rows per tree reach this window.
    rank = F.row_number().over(W.partitionBy("tree").orderBy("h", "order_id"))
    return drawn.withColumn("rank", rank).where(F.col("rank") <= bag)


def path_length(depth: int, n: int) -> int:
    """What a leaf of n rows at a depth counts, in units."""
    return round((depth + mean_path(n)) * UNIT)


def _split(seed: int, tree: int, node: int, low: np.ndarray, high: np.ndarray) -> tuple[int, float]:
    """Feature and cut of a node: rows above the cut go right, so both sides get some."""
    digest = hashlib.md5(f"{seed}:{tree}:{node}".encode()).hexdigest()
    which, where = int(digest[:13], 16) / 2.0**52, int(digest[13:26], 16) / 2.0**52
    varied = np.flatnonzero(high > low)
    f = int(varied[int(which * len(varied))])
    cut = low[f] + (high[f] - low[f]) * where
    return f, cut if cut < high[f] else low[f]


def _grow(rows: pd.DataFrame, features: list[str], height: int, seed: int) -> pd.DataFrame:
    """Grow one tree from its bag; nodes numbered as in a heap."""
    tree = int(rows["tree"].iloc[0])
    x = rows[features].to_numpy(dtype=float)
    size = 2 ** (height + 1) - 1
    feature = np.zeros(size, dtype=np.int32)
    threshold = np.full(size, np.inf)
    path = np.zeros(size, dtype=np.int64)
    open_nodes = [(0, 0, np.arange(len(x)))]
    while open_nodes:
        node, depth, members = open_nodes.pop()
        part = x[members]
        low, high = part.min(axis=0), part.max(axis=0)
        if depth == height or len(members) <= 1 or not (high > low).any():
            # Rows always step left from a leaf, so its path length goes to that last-level node.
            bottom = node
            for _ in range(height - depth):
                bottom = 2 * bottom + 1
            path[bottom] = path_length(depth, len(members))
            continue
        f, cut = _split(seed, tree, node, low, high)
        right = part[:, f] > cut
        feature[node], threshold[node] = f, cut
        open_nodes.append((2 * node + 2, depth + 1, members[right]))
        open_nodes.append((2 * node + 1, depth + 1, members[~right]))
    return pd.DataFrame(
        {
            "tree": np.int32(tree), "node": np.arange(size, dtype=np.int32), "feature": feature,
            "threshold": threshold, "path": path, "bag": np.int32(len(x)),
        }
    )


def fit(
    base: DataFrame, rows: int, trees: int = 200, seed: int = 42, features: list[str] | None = None
) -> Forest:
    """Grow the forest; what reaches the driver is bounded by trees x 511 nodes."""
    features = features or MODEL_FEATURES
    bag = min(MAX_BAG, rows)
    height = max(1, math.ceil(math.log2(bag)))
    size = 2 ** (height + 1) - 1
    share = 2.0
    while True:
        grown = (
            bags(base, features, rows, trees, seed, share)
            .groupBy("tree")
            .applyInPandas(lambda pdf: _grow(pdf, features, height, seed), NODE_SCHEMA)
            .toPandas()
            .sort_values(["tree", "node"])
        )
        # A bag falls short only if hashes cluster badly; draw from a wider share then.
        if len(grown) == trees * size and grown["bag"].min() == bag:
            break
        if share * bag >= rows:
            if grown.empty:
                raise ValueError("no rows to grow a forest from")
            break
        share *= 2
    shape = (grown["tree"].nunique(), size)
    return Forest(
        grown["feature"].to_numpy().reshape(shape),
        grown["threshold"].to_numpy().reshape(shape),
        grown["path"].to_numpy().reshape(shape),
        height,
        bag,
    )


def _walk(forest: Forest, x: np.ndarray) -> np.ndarray:
    """Anomaly score of each row of ``x`` (features in rows), batch by batch and tree by tree."""
    n = x.shape[1]
    flat, lane = np.ascontiguousarray(x).ravel(), np.arange(n)
    total = np.zeros(n, dtype=np.int64)
    for feature, threshold, path in zip(forest.feature, forest.threshold, forest.path):
        offset = feature.astype(np.int64) * n
        node = np.zeros(n, dtype=np.int64)
        for _ in range(forest.height):
            right = flat[offset[node] + lane] > threshold[node]
            node = 2 * node + 1 + right
        total += path[node]
    mean = total / len(forest.feature) / float(UNIT)
    return 2.0 ** (-mean / max(mean_path(forest.bag), 1e-12))


def with_raw_score(df: DataFrame, forest: Forest, features: list[str] | None = None) -> DataFrame:
    """Add ``iforest_raw`` in (0, 1]; higher is more isolated."""
    features = features or MODEL_FEATURES
    shared = df.sparkSession.sparkContext.broadcast(forest)

    @F.pandas_udf("double")
    def raw_score(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.Series]:
        for cols in batches:
            yield pd.Series(_walk(shared.value, np.stack([c.to_numpy(dtype=float) for c in cols])))

    return df.withColumn("iforest_raw", raw_score(*[F.col(f).cast("double") for f in features]))


def cut_value(scored: DataFrame, contamination: float) -> float:
    """The exact (1 - contamination) quantile of the raw score."""
    check_contamination(contamination)
    return single_quantiles(scored, "iforest_raw", [1.0 - contamination]).first()["q0"]


def flag_columns(cut: float, digits: int = 5) -> dict[str, Column]:
    raw = F.col("iforest_raw")
    return {
        "iforest_anomaly": (raw > F.lit(cut)).cast("int"),
        "iforest_score": round_even(raw - F.lit(cut), digits),
        "iforest_skipped": F.lit(False),
    }


def skipped_columns() -> dict[str, Column]:
    return {
        "iforest_anomaly": F.lit(0),
        "iforest_score": F.lit(0.0),
        "iforest_skipped": F.lit(True),
    }


def with_forest(
    base: DataFrame, config: DetectorConfig, rows: int | None = None,
    features: list[str] | None = None, digits: int = 5, min_rows: int = MIN_ROWS,
) -> DataFrame:
    """Add the forest columns. The base is read to fit and to score; the cut and the result read the staged scores.

    Missing features count as their medians, as for the scaled features.
    """
    features = features or MODEL_FEATURES
    rows = base.count() if rows is None else rows
    if rows < min_rows:
        return base.withColumns(skipped_columns())
    nulls = base.agg(*[F.count_if(F.col(f).isNull()).alias(f) for f in features]).first()
    filled = [f for f in features if nulls[f]]
    model = base.withColumns({
        f"_m_{f}": F.coalesce(F.col(f), F.lit(single_quantiles(base, f, [0.5]).first()["q0"])) if f in filled else F.col(f)
        for f in features
    })
    names = [f"_m_{f}" for f in features]
    forest = fit(model, rows, config.n_trees, config.random_state, names)
    scored = stage(with_raw_score(model, forest, names).drop(*names), "forest-scores")
    cut = cut_value(scored, config.iforest_contamination)
    return scored.withColumns(flag_columns(cut, digits)).drop("iforest_raw")


def forest_layer(
    base: DataFrame, contamination: float | None = None, config: DetectorConfig | None = None
) -> DataFrame:
    config = config or DetectorConfig()
    if contamination is not None:
        config = DetectorConfig(
            **{**config.__dict__, "iforest_contamination": check_contamination(contamination)}
        )
    return with_forest(base, config).select(
        "order_id", "iforest_anomaly", "iforest_score", "iforest_skipped"
    )
