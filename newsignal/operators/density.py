"""Density clusters of vectors: the hierarchy of mutual reachability, its stable clusters, soft membership of the rest."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import last_of_nearest
from .graph import DIGITS, spanning_tree
from .store import Scratch

#: Rows of a block, of which one task compares two, or one with its group.
BLOCK = 8_192
#: Rows of a cluster and neighbours of a core at least, and the soft membership from which on a row outside all clusters joins one.
LEAST_SIZE, LEAST_CORE, SOFT = 5, 3, 0.10
_TINY = 1e-12


def adaptive(n: int) -> tuple[int, int]:
    """Least size of a cluster, and neighbours that make a core, in a group of n rows."""
    size = max(LEAST_SIZE, n // 10) if n < 80 else max(5, n // 15) if n < 200 else max(8, n // 20)
    return size, max(LEAST_CORE if n < 200 else 5, size // 2)


def condensed(n: int, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, list[tuple[int, float, float]]]:
    """(cluster, leaving) of each of n rows and (parent, birth, stability) of each cluster; edges: (a, b, weight) in ascending order.

    From the top of the hierarchy down: where both sides of a split have ``least`` rows they are new
    clusters, else the smaller side falls out of the cluster that goes on.  A row leaves its last
    cluster at the inverse of the distance at which it falls out.
    """
    left, right, size = np.zeros(2 * n - 1, np.int64), np.zeros(2 * n - 1, np.int64), np.ones(2 * n - 1, np.int64)
    top, height = np.arange(2 * n - 1), np.zeros(2 * n - 1)

    def root(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for k, (a, b, w) in enumerate(edges):
        x, y, new = root(int(a)), root(int(b)), n + k
        left[new], right[new], size[new], height[new] = x, y, size[x] + size[y], max(w, _TINY)
        top[x] = top[y] = new
    cluster, leaving = np.zeros(n, np.int64), np.zeros(n)
    found: list[list[float]] = [[-1, 0.0, 0.0]]
    stack = [(2 * n - 2, 0, False, 0.0)]
    while stack:
        node, own, out, at = stack.pop()
        if node < n:
            cluster[node], leaving[node] = own, at if out else np.inf
            continue
        now = at if out else 1 / height[node]
        sides = (left[node], right[node])
        large = [size[s] >= least for s in sides]
        if not out and all(large):
            found[own][2] += size[node] * (now - found[own][1])
            for s in sides:
                found.append([own, now, 0.0])
                stack.append((s, len(found) - 1, False, now))
            continue
        for s, fits in zip(sides, large, strict=True):
            gone = out or not fits
            if gone and not out:
                found[own][2] += size[s] * (now - found[own][1])
            stack.append((s, own, gone, now))
    return cluster, leaving, [(int(p), b, s) for p, b, s in found]


def stable(found: list[tuple[int, float, float]]) -> np.ndarray:
    """For each cluster the selected one that it lies in, -1 for none: the most excess of mass, never the whole."""
    best, chosen = [s for _, _, s in found], np.zeros(len(found), bool)
    below = np.zeros(len(found))
    for k in range(len(found) - 1, 0, -1):
        chosen[k] = best[k] >= below[k]
        below[found[k][0]] += max(best[k], below[k])
    home = np.full(len(found), -1)
    for k in range(1, len(found)):
        up = home[found[k][0]]
        home[k] = up if up >= 0 else k if chosen[k] else -1
    return home


def label_tree(n: int, edges: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(label, leaving) of n rows: clusters numbered by their first row, -1 outside of them."""
    if n < 2 or n < least:
        return np.full(n, -1), np.zeros(n)
    cluster, leaving, found = condensed(n, edges, least)
    home = stable(found)[cluster]
    _, first = np.unique(home[home >= 0], return_index=True)
    order = home[home >= 0][np.sort(first)]
    number = {int(h): k for k, h in enumerate(order)}
    return np.array([number.get(int(h), -1) for h in home]), leaving


def density_clusters(df: DataFrame, group: str, key: str, vector: str, soft: float = SOFT) -> DataFrame:
    """(group, key, cluster, hard) of every row: its density cluster within its group, -1 for noise.

    1. Each row's core distance is that to its ``adaptive`` nearest neighbour, all blocks of a
       group against each other.
    2. The minimum spanning tree of mutual reachability is made in rounds over the same blocks.
    3. The tree of one group, three numbers a row, is condensed in one task.
    4. A row outside all clusters joins the one with the largest membership if that is ``soft`` or
       more: the share of the inverse distance to its most central row, times how dense the row is
       against that row.  ``hard``: whether it was in the cluster before.

    Cases: groups of fewer rows than a cluster needs are noise, rows of one vector have distance 0,
    a zero vector has distance 1 to all, ties go to the smaller key, a null group is one group;
    repeated keys are rows of their own; rows without a vector are left out.
    """
    work = Scratch(df.sparkSession)
    size_of, core_of = (F.udf(lambda n, k=k: adaptive(n)[k], "long") for k in (0, 1))  # a row for each group
    rows = df.select(F.col(group).alias("_name"), F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v")).filter("_v is not null")
    sizes = rows.groupBy("_name").agg(F.count("*").alias("_n"), F.min("_key").alias("_first"))
    sizes = work.keep(sizes.withColumns({"_group": F.monotonically_increasing_id(), "_least": size_of("_n"), "_near": core_of("_n"), "_blocks": F.ceil(F.col("_n") / BLOCK).cast("long")}))
    norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    unit = rows.withColumn("_norm", norm).withColumn("_v", F.transform("_v", lambda x: F.when(F.col("_norm") > 0, x / F.col("_norm")).otherwise(x)))
    placed = unit.join(sizes.withColumnRenamed("_name", "_same"), F.col("_name").eqNullSafe(F.col("_same"))).drop("_same", "_norm", "_first")
    # Numbered in the order of keys, so that ties go to the smaller key; written down, so that a number stays what it is.
    placed = work.keep(placed.repartitionByRange("_group", "_key").sortWithinPartitions("_group", "_key").withColumn("_row", F.monotonically_increasing_id()))
    near = last_of_nearest(placed.select("_group", "_row", "_v", "_near", "_blocks"))
    core = near.select(F.col("src").alias("_row"), F.round(F.greatest(F.lit(0.0), 1 - F.col("sim")), DIGITS).alias("_core"))
    ready = work.keep(placed.join(core, "_row", "left").fillna({"_core": 2.0}))
    tree = spanning_tree(ready.select("_group", "_row", "_v", "_core", "_blocks"), work)

    def run(x: pd.DataFrame, e: pd.DataFrame) -> pd.DataFrame:
        x, e = x.sort_values("_row"), e.sort_values(["w", "a", "b"])
        ids = x["_row"].to_numpy()
        edges = np.stack([np.searchsorted(ids, e["a"]), np.searchsorted(ids, e["b"]), e["w"].to_numpy()], 1) if len(e) else np.empty((0, 3))
        label, leaving = label_tree(len(ids), edges, int(x["_least"].iloc[0]) if len(x) else 1)
        return pd.DataFrame({"_row": ids, "label": label.astype(np.int64), "leaving": leaving})

    hard = work.keep(ready.select("_group", "_row", "_least").groupBy("_group").cogroup(tree.groupBy("_group")).applyInPandas(run, "_row long, label long, leaving double"))
    joined = ready.select("_group", "_row", "_name", "_key", "_v", "_core").join(hard, "_row")
    # One row for each cluster, at most twenty a group: the one with the smallest core distance.
    centers = joined.filter("label >= 0").groupBy("_group", "label").agg(F.min_by(F.struct("_v", "_core"), F.struct("_core", "_row")).alias("c"))
    centers = centers.groupBy("_group").agg(F.sort_array(F.collect_list(F.struct("label", "c"))).alias("centers"))
    asked = joined.filter("label < 0").join(centers, "_group")
    dot = lambda v: F.aggregate(F.zip_with("_v", v, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    away = F.transform("centers", lambda c: F.struct(c["label"].alias("label"), F.greatest(1 - dot(c["c"]["_v"]), F.lit(_TINY)).alias("d"), F.greatest(c["c"]["_core"], F.lit(_TINY)).alias("core")))
    share = F.transform("away", lambda c: F.struct((1 / c["d"] / F.col("every") * F.least(c["core"] / F.greatest("_core", F.lit(_TINY)), F.lit(1.0))).alias("p"), (-c["label"]).alias("minus")))
    found = asked.withColumn("away", away).withColumn("every", F.aggregate("away", F.lit(0.0), lambda s, c: s + 1 / c["d"])).select("_row", F.array_max(share).alias("best"))
    soft_of = found.filter(F.col("best.p") >= soft).select("_row", (-F.col("best.minus")).alias("joined"))
    out = joined.join(soft_of, "_row", "left").select(F.col("_name").alias(group), F.col("_key").alias(key), F.coalesce("joined", "label").cast("int").alias("cluster"), (F.col("label") >= 0).alias("hard"))
    out = work.keep(out)
    work.drop_all_but(out)
    return out
