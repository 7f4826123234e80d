"""Near-duplicate vectors within a label: spherical k-means cells and blocked cosine products.

1. Bit-equal vectors of a label become one class with its number of vectors.
2. Spherical k-means, fitted on a bounded sample of each label (by hash, spread evenly), gives centres, as many as its size asks for; every
   vector has a home cell, that of its nearest centre.
3. If x and y are within the angle of the threshold and y's home is c, then x lies at most sin(angle) beyond
   the plane that separates c from any other centre. So x is also sent to each cell c for which that holds: all
   partners of y are in y's home cell, and nothing is lost at cell borders.
4. A cell is compared in blocks of home vectors against blocks of its vectors. A block gives each home vector's number
   of links and the links that connect what it connects, never all pairs.
5. Components of those links name the groups; the smallest vec_id of a group is its representative.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import Forest, components
from tidewatch.sources.staging import measured, stage

SAMPLE = 2048  # vectors per label, and SAMPLE_A_CELL for each of its cells, that the centres are fitted on
SAMPLE_A_CELL = 16
PER_CELL = 4096  # vectors wanted in a cell
MAX_CELLS = 1024  # centres of a label that one task fits; cells of more than PER_CELL vectors are still compared in blocks
BLOCK = 2048
ROUNDS = 10


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Unit centres of unit rows; begins with rows that lie far apart, so no randomness is needed."""
    picked, nearest = [0], x @ x[0]
    while len(picked) < min(k, len(x)):
        picked.append(int(nearest.argmin()))
        nearest = np.maximum(nearest, x @ x[picked[-1]])
    centres = x[picked]
    for _ in range(rounds):
        home = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        size = np.linalg.norm(sums, axis=1, keepdims=True)
        moved = np.where(size > 1e-12, sums / np.maximum(size, 1e-12), centres)
        if np.allclose(moved, centres):
            break
        centres = moved
    return centres


def _units(v: pd.Series) -> np.ndarray:
    """Unit rows; a huge or tiny vector is scaled by its largest component first."""
    x = np.stack(v.to_numpy()).astype(np.float64)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _fit(frame: pd.DataFrame) -> pd.DataFrame:
    k = int(frame["cells"].iloc[0])
    centres = spherical_kmeans(_units(frame.sort_values("rep")["v"]), k)
    return pd.DataFrame({"label": frame["label"].iloc[0], "dims": frame["dims"].iloc[0], "centres": [centres.ravel().tolist()]})


def _assign(vectors: pd.DataFrame, centres: pd.DataFrame, sine: float) -> pd.DataFrame:
    x = _units(vectors["v"])
    c = np.array(centres["centres"].iloc[0]).reshape(-1, x.shape[1])
    near = x @ c.T
    home = near.argmax(1)
    rows = []
    for cell in range(len(c)):
        apart = np.linalg.norm(c - c[cell], axis=1)
        beyond = np.where(apart > 1e-9, (near - near[:, [cell]]) / np.maximum(apart, 1e-9), 0).max(1)
        inside = np.flatnonzero((home == cell) | (beyond <= sine + 1e-9))
        rows.append(pd.DataFrame({"at": inside, "cell": cell, "home": home[inside] == cell}))
    rows = pd.concat(rows)
    return vectors[["label", "dims", "rep", "copies", "v"]].iloc[rows["at"]].assign(
        cell=rows["cell"].to_numpy(), home=rows["home"].to_numpy()
    )


def _compare(frame: pd.DataFrame, cosine: float) -> pd.DataFrame:
    """Counts per home vector, and connecting links, between one block of home vectors and one of all vectors."""
    left, right = frame[frame["side"] == 0].sort_values("rep"), frame[frame["side"] == 1].sort_values("rep")
    columns = ["rep", "links", "other"]
    if left.empty or right.empty:
        return pd.DataFrame(columns=columns).astype("int64")
    product = _units(left["v"]) @ _units(right["v"]).T
    a, b, copies = left["rep"].to_numpy(), right["rep"].to_numpy(), right["copies"].to_numpy()
    hit = (product >= cosine) & (a[:, None] != b[None, :])
    counts = hit @ copies
    place = {r: k for k, r in enumerate(np.unique(np.concatenate([a, b])).tolist())}
    forest, others = Forest(len(place)), []
    for i, j in zip(*np.nonzero(hit)):
        if forest.join(place[a[i]], place[b[j]]):
            others.append((a[i], 0, b[j]))
    rows = [(r, n, r) for r, n in zip(a, counts) if n] + others
    return pd.DataFrame(rows, columns=columns, dtype="int64")


def near_duplicate_vectors(
    vectors: DataFrame, cosine: float = 0.93, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """One row per row: vec_id, n_links (other vectors linked directly), component_id, kept (vec_id = component_id).

    Two vectors link when their labels are equal and not null, their lengths are equal, and their cosine in double
    precision is at least ``cosine``. Null, empty and zero vectors, vectors with null or non-finite components, and
    rows without a label link with nothing. Rows without a vec_id link with nothing and are not kept. An empty table gives none.
    """
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"),
        F.col(vector).cast("array<double>").alias("v"),
    )
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    fit = (
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
        & F.forall("v", finite) & F.exists("v", lambda x: x != 0)
    )
    # -0.0 and 0.0 are the same component; ids stand for whole vectors in what follows
    good = rows.where(fit).withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn(
        "key", F.sha2(F.concat_ws(",", F.transform("v", lambda x: x.cast("string"))), 256)
    )
    keyed = good.select("vec_id", "label", "key")
    classes = good.groupBy("label", "key").agg(
        F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("v").alias("v")
    ).withColumn("dims", F.size("v"))
    classes = stage(classes, "vector-classes")

    group = ["label", "dims"]
    sizes = classes.groupBy(*group).agg(F.count("*").alias("n"))
    cells = F.least(F.ceil(F.col("n") / PER_CELL), F.lit(MAX_CELLS)).cast("int")
    wanted = F.greatest(F.lit(SAMPLE), SAMPLE_A_CELL * F.col("cells"))
    sizes = measured(sizes.withColumn("cells", cells).withColumn("wanted", wanted))
    # a share of a large label goes on, four times what is wanted; only that is ordered
    share = F.pmod(F.xxhash64("rep", F.lit(7)), F.col("n")) < 4 * F.col("wanted")
    order = Window.partitionBy(*group).orderBy(F.xxhash64("rep"), "rep")
    sample = classes.select(*group, "rep", "v").join(sizes, group).where(share)
    sample = sample.withColumn("k", F.row_number().over(order)).where(F.col("k") <= F.col("wanted"))
    kind = vectors.schema[label].dataType.simpleString()
    centres = sample.groupBy(*group).applyInPandas(
        _fit, f"label {kind}, dims int, centres array<double>"
    )
    centres = stage(centres.join(sizes.withColumn("chunks", F.ceil(F.col("n") / BLOCK)), group), "vector-centres")

    chunked = classes.join(centres.select(*group, "chunks"), group).withColumn(
        "chunk", F.pmod(F.xxhash64("rep"), F.col("chunks"))
    )
    wide = centres.select(*group, "centres", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)).alias("chunk"))
    keys = [*group, "chunk"]
    sine = float(np.sqrt(1 - cosine**2))
    cells = chunked.select(*keys, "rep", "copies", "v").groupBy(*keys).cogroup(wide.groupBy(*keys)).applyInPandas(
        lambda x, c: _assign(x, c, sine) if len(x) and len(c) else pd.DataFrame(
            columns=["label", "dims", "rep", "copies", "v", "cell", "home"]),
        f"label {kind}, dims int, rep long, copies long, v array<double>, cell int, home boolean",
    )
    cells = stage(cells, "vector-cells")
    group = [*group, "cell"]
    counted = cells.groupBy(*group).agg(
        F.ceil(F.count_if("home") / BLOCK).alias("lefts"), F.ceil(F.count("*") / BLOCK).alias("rights")
    )
    dealt = cells.join(counted, group)
    to = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("rep"), F.col(n))
    left = dealt.where("home").select(*group, own("lefts").alias("i"), to("rights").alias("j"), F.lit(0).alias("side"), "rep", "copies", "v")
    right = dealt.where("lefts > 0").select(*group, to("lefts").alias("i"), own("rights").alias("j"), F.lit(1).alias("side"), "rep", "copies", "v")
    found = stage(
        left.union(right).groupBy(*group, "i", "j").applyInPandas(
            lambda frame: _compare(frame, cosine), "rep long, links long, other long"
        ),
        "vector-links",
    )
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("other").alias("b")))
    per_class = (
        classes.select("label", "key", "rep", "copies").join(links, "rep", "left")
        .join(groups.withColumnRenamed("id", "rep"), "rep", "left")
        .select("label", "key", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                F.coalesce("component", "rep").alias("component_id"))
    )
    alone = rows.where(~fit | fit.isNull()).select(
        "vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")
    )
    joined = keyed.join(per_class, ["label", "key"]).select("vec_id", "n_links", "component_id")
    return joined.union(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
