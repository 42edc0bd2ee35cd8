"""Near-duplicate vectors: spherical k-means cells and blocked cosine products within them.

Equal vectors of a label are one class, compared once. Each label with ``LEAST_CELLED`` classes
gets k-means centroids, trained on a bounded sample by distributed sums. A vector belongs to
the cell of its nearest centroid and visits every other cell that could hold a partner: with
|x - y| <= r, a partner y of x in cell j has y.(c_j - c_i) >= 0, so x.(c_i - c_j) <= r |c_i - c_j|.
Every pair at the threshold or above therefore meets in the home cell of each of its two
vectors, and none is lost. Cells are compared in blocks of bounded size, in double precision; a
block returns link counts and a spanning forest of its links, never the pairs.

Cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors
without a label, link with nothing and are kept; vectors of different lengths don't link;
repeated rows link with each other; a null id is an ordinary row, and a component's id is its
smallest id that is not null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from basaltic.llm.common import connected_components, saved

THRESHOLD = 0.98
#: Classes of a label for each of its cells (two cells at least), and rows on each side of a
#: block. Labels with fewer classes are one cell.
CELL_TARGET, LEAST_CELLED, BLOCK = 2_000, 32, 2_000
#: Bytes of the centroids of all labels together, which the driver and every executor hold.
CENTROID_BYTES = 48 << 20
#: Sampled vectors for each centroid, and rounds of k-means.
SAMPLE_A_CELL, ROUNDS = 64, 4
#: Products of vectors with centroids that are held at once.
PRODUCTS = 2_000_000
#: Largest number of cells whose numbers of blocks are broadcast (about 40 bytes each).
BROADCAST_CELLS = 200_000


def unit(vectors) -> np.ndarray:
    rows = np.array([np.asarray(v, np.float64) for v in vectors])
    rows /= np.abs(rows).max(1, keepdims=True)  # no overflow or underflow in the squares
    return rows / np.sqrt((rows * rows).sum(1, keepdims=True))


def sums(centroids: dict):
    """For each cell the sum of the sampled unit vectors that are nearest to its centroid."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, part in rows.groupby(["label", "dim"], sort=False):
                c = centroids.value.get((int(key[0]), int(key[1])))
                if c is None:
                    continue
                step = max(1, PRODUCTS // len(c))
                for at in range(0, len(part), step):
                    x = unit(part["v"].iloc[at : at + step])
                    nearest = np.argmax(x @ c.T, 1)
                    cells, which = np.unique(nearest, return_inverse=True)
                    total = np.zeros((len(cells), x.shape[1]))
                    np.add.at(total, which, x)
                    yield pd.DataFrame({"label": key[0], "dim": key[1], "cell": cells, "total": list(total)})

    return run


def add_up(rows: pd.DataFrame) -> pd.DataFrame:
    """One cell's new centroid; none where its vectors cancel out."""
    total = np.sum([np.asarray(t) for t in rows["total"]], 0)
    norm = np.sqrt(total @ total)
    return rows[["label", "dim", "cell"]].iloc[:1].assign(total=[total / norm]) if norm > 1e-9 else rows.iloc[:0]


def spherical_k_means(spark, sample: DataFrame, rounds: int):
    """Unit centroids by (label, dim), on every executor. sample: label, dim, k, n, cid, v of
    the drawn classes. Each round sends a sum for each cell of each batch, which are added up
    by cell; only centroids reach the driver."""
    start = F.xxhash64("cid", F.lit("start"))
    near = sample.where(F.pmod(start, F.lit(1 << 20)) < F.lit(8.0 * (1 << 20)) * F.col("k") / F.least("n", F.col("k") * SAMPLE_A_CELL))
    place = F.row_number().over(Window.partitionBy("label", "dim").orderBy(start, "cid"))
    seeds = near.select("label", "dim", "k", "cid").withColumn("cell", place - 1).where("cell < k").select("cid", "cell")
    centroids: dict = {}
    for r in sample.join(seeds, "cid").select("label", "dim", "cell", "v").orderBy("label", "dim", "cell").toLocalIterator():
        centroids.setdefault((r["label"], r["dim"]), []).append(unit([r["v"]])[0])
    centroids = {key: np.array(found) for key, found in centroids.items()}
    for _ in range(rounds if centroids else 0):
        held = spark.sparkContext.broadcast(centroids)
        parts = sample.select("label", "dim", "v").mapInPandas(sums(held), "label long, dim int, cell int, total array<double>")
        moved = parts.groupBy("label", "dim", "cell").applyInPandas(add_up, "label long, dim int, cell int, total array<double>")
        centroids = {key: c.copy() for key, c in centroids.items()}
        for r in moved.toLocalIterator():
            centroids[r["label"], r["dim"]][r["cell"]] = r["total"]
        held.unpersist()
    return spark.sparkContext.broadcast(centroids)


def assign(centroids: dict, radius: float):
    """The home cell of each class and all cells it meets."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for key, part in rows.groupby(["label", "dim"], sort=False):
                c = centroids.value.get((int(key[0]), int(key[1])))
                if c is None:
                    yield part.assign(home=0, cells=[[0]] * len(part))
                    continue
                step = max(1, PRODUCTS // len(c))
                for at in range(0, len(part), step):
                    some = part.iloc[at : at + step]
                    scores = unit(some["v"]) @ c.T
                    home = np.argmax(scores, 1)
                    homes, which = np.unique(home, return_inverse=True)
                    gaps = np.sqrt(np.maximum(0, 2 - 2 * (c[homes] @ c.T)))
                    behind = scores[np.arange(len(some)), home][:, None] - scores
                    meets = behind <= radius * gaps[which] + 1e-9
                    yield some.assign(home=home, cells=[np.flatnonzero(m) for m in meets])

    return run


def compare(threshold: float):
    """Link counts of a block's own rows and a spanning forest of its links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        """A cell of one block comes once, its own rows marked; other blocks in two parts."""
        own = rows[rows["own"]]
        others = rows if rows["whole"].iloc[0] else rows[~rows["own"]]
        if not len(own) or not len(others):
            return pd.DataFrame({"cid": [], "links": [], "root": []})
        left, right = own["cid"].to_numpy(), others["cid"].to_numpy()
        linked = unit(own["v"]) @ unit(others["v"]).T >= threshold
        linked &= left[:, None] != right[None, :]
        links = (linked * others["weight"].to_numpy()[None, :]).sum(1)
        a, b, none = left.copy(), right.copy(), np.iinfo(np.int64).max
        while True:
            b2 = np.minimum(b, np.where(linked, a[:, None], none).min(0))
            a2 = np.minimum(a, np.where(linked, b2[None, :], none).min(1))
            if (a2 == a).all() and (b2 == b).all():
                break
            a, b = a2, b2
        edges = [(n, r) for ns, rs in ((left, a), (right, b)) for n, r in zip(ns.tolist(), rs.tolist(), strict=True) if n != r]
        counted = pd.DataFrame({"cid": left, "links": links, "root": pd.array([None] * len(left), "Int64")})[links > 0]
        forest = pd.DataFrame({"cid": [n for n, _ in edges], "links": 0, "root": pd.array([r for _, r in edges], "Int64")})
        return pd.concat([counted, forest])

    return run


def usable(v, label):
    return F.col(label).isNotNull() & F.col(v).isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)


def link(vectors: DataFrame, threshold: float = THRESHOLD, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept of every row."""
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v"))
    rows = rows.withColumn("good", F.coalesce(usable("v", "label"), F.lit(False)))
    good = rows.where("good").withColumn("dim", F.size("v"))
    classes = saved(
        good.groupBy("label", "dim", "v").agg(F.count(F.lit(1)).alias("weight"), F.min("vec_id").alias("least")).withColumn("cid", F.monotonically_increasing_id()),
        "vector-classes",
    )
    sizes = classes.groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_CELLED)
    asked = F.greatest(F.ceil(F.col("n") / CELL_TARGET), F.lit(2))
    need = sizes.agg(F.sum(asked * F.col("dim") * 8)).first()[0] or 0
    sizes = sizes.withColumn("k", F.floor(asked * min(1.0, CENTROID_BYTES / max(need, 1))).cast("int")).where("k > 1")
    drawn = classes.join(sizes, ["label", "dim"]).where(F.pmod(F.xxhash64("cid"), F.lit(1 << 20)) < F.col("k") * SAMPLE_A_CELL / F.col("n") * (1 << 20))
    held = spherical_k_means(spark, saved(drawn.select("label", "dim", "k", "n", "cid", "v"), "vector-sample"), ROUNDS)
    radius = float(np.sqrt(2 - 2 * threshold))
    kind = classes.schema["v"].dataType.simpleString()
    placed = classes.select("label", "dim", "cid", "weight", "v").mapInPandas(assign(held, radius), f"label long, dim int, cid long, weight long, v {kind}, home int, cells array<int>")
    placed = saved(placed, "vector-cells")
    homes = placed.groupBy("label", "dim", F.col("home").alias("cell")).agg(F.count(F.lit(1)).alias("n_own"))
    visits = placed.select("label", "dim", F.explode("cells").alias("cell")).groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n_all"))
    parts = homes.join(visits, ["label", "dim", "cell"]).select("label", "dim", "cell", F.ceil(F.col("n_own") / BLOCK).cast("int").alias("own_parts"), F.ceil(F.col("n_all") / BLOCK).cast("int").alias("all_parts"))
    parts = saved(parts.where("own_parts > 1 or all_parts > 1"), "vector-parts")  # only cells with centroids
    parts = F.broadcast(parts) if parts.count() <= BROADCAST_CELLS else parts

    # A cell of one block goes there once; of others, the vectors at home go to every block of
    # their part, and so do all that the cell meets.
    met = placed.withColumn("cell", F.explode("cells")).join(parts, ["label", "dim", "cell"], "left")
    columns = ["label", "dim", "cell", "a", "b", "own", "whole", "cid", "weight", "v"]
    single = met.where("own_parts is null").select("label", "dim", "cell", F.lit(0).alias("a"), F.lit(0).alias("b"), (F.col("cell") == F.col("home")).alias("own"), F.lit(True).alias("whole"), "cid", "weight", "v")
    many = met.where("own_parts is not null").withColumn("whole", F.lit(False))
    hashed = F.xxhash64("cid")
    mine = many.where("cell = home").withColumns({"own": F.lit(True), "a": F.pmod(hashed, "own_parts").cast("int"), "b": F.explode(F.sequence(F.lit(0), F.col("all_parts") - 1))})
    theirs = many.withColumns({"own": F.lit(False), "b": F.pmod(hashed, "all_parts").cast("int"), "a": F.explode(F.sequence(F.lit(0), F.col("own_parts") - 1))})
    blocks = single.select(*columns).union(mine.select(*columns)).union(theirs.select(*columns))
    found = blocks.groupBy("label", "dim", "cell", "a", "b").applyInPandas(compare(threshold), "cid long, links long, root long")
    found = saved(found, "vector-links")
    components = connected_components(found.where("root is not null").select(F.col("cid").alias("a"), F.col("root").alias("b")), "vector-components")
    counts = found.groupBy(F.col("cid").alias("n_cid")).agg(F.sum("links").alias("links"))
    joined = classes.drop("v", "dim", "label").join(counts, F.col("cid") == F.col("n_cid"), "left").join(components, F.col("cid") == F.col("node"), "left")
    joined = saved(joined.select("cid", "weight", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "cid").alias("component")), "vector-classes")
    least = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(least, "component").select("cid", F.col("component_id"), (F.col("links") + F.col("weight") - 1).alias("n_links"))
    named = saved(classes.select("cid", "label", "v").join(named, "cid").select("label", "v", "component_id", "n_links"), "vector-named")
    out = rows.join(named.withColumn("good", F.lit(True)), ["good", "label", "v"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
