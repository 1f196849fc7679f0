"""Parent-child links to full hierarchies, by tree contraction.

Each round rakes the leaves and splices every other node out of unary chains, so that a forest of n nodes is gone
after O(log n) rounds whatever its depth; the live part shrinks geometrically, and so do the rounds' shuffles. What
is left when nothing else shrinks are self-loops: each is a contracted circle. The recorded contractions are then
undone, last first: a node's parent at the time it was removed already has its root, depth and path.

A round over all nodes is one written table. Once at most ``SMALL`` nodes are live, the rounds that are left are made over
arrays in one task, which cost less than a table each.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from palimpsest.session import Scratch, ship

#: Live nodes whose contraction one task ends: about 100 bytes each; a tenth of them with paths.
SMALL = 200_000


def hierarchy(nodes: DataFrame, edges: DataFrame, paths: bool = False, small: int | None = None) -> DataFrame:
    """Root and depth of every node.

    ``nodes`` has ``id`` BIGINT; ``edges`` has ``id`` and ``parent``. Result: id, parent, root, depth and, if ``paths``,
    path (ARRAY from the node to its root) and round. Repeated rows count once; null ids, parents that are no node and
    nodes of edges that are no node count for nothing. A node of several parents follows the smallest. A node whose way
    up ends in a circle gets the circle's smallest id as root, depth -1, a null path and as round (null for all others) its
    way up to the circle and once round it, each node once. Other columns are ignored; empty tables give an empty result.
    ``small`` is the number of live nodes whose contraction ends in one task.
    """
    spark = nodes.sparkSession
    ship(spark)
    scratch = Scratch(spark)
    ids = nodes.select(F.col("id").cast("bigint").alias("n")).where("n is not null").distinct()
    up = (
        edges.select(F.col("id").cast("bigint").alias("n"), F.col("parent").cast("bigint").alias("p"))
        .where("n is not null and p is not null")
        .join(ids.select(F.col("n").alias("p")), "p", "left_semi")
        .groupBy("n")
        .agg(F.min("p").alias("p"))
    )
    start = ids.join(up, "n", "left").select("n", "p", F.lit(1).alias("w"), "n", F.lit(None).cast("array<bigint>"))
    start = start.toDF("n", "p", "w", "least", "via")
    if paths:
        start = start.withColumn("via", F.array().cast("array<bigint>"))
    live = scratch.save(start, "start")
    links = live

    steps: list[DataFrame] = []
    left = size = live.count()
    small = SMALL // (10 if paths else 1) if small is None else small
    while left and size > small:
        step, left, size = _contract(live, len(steps), paths, scratch)
        steps.append(step)
        live = step.where("tag = 'live'")

    def end(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [*parts]
        if held and sum(map(len, held)):
            yield contract(pd.concat(held, ignore_index=True), paths)

    # Until the end path is the way up of every node. A node that was spliced out of a circle comes again in the way of
    # the one above it: only the first time counts.
    path = F.lit(None).cast("array<bigint>")
    if left:
        known = live.select("n", "p", "w", "least", "via").coalesce(1).mapInPandas(end, "n bigint, root bigint, depth int, path array<bigint>")
    else:
        known = live.select("n", F.least("n", "least").alias("root"), F.lit(-1).alias("depth"), (F.concat(F.array("n"), "via") if paths else path).alias("path"))
    for r in range(len(steps) - 1, -1, -1):
        gone = steps[r].where("tag = 'gone'").alias("g")
        top = known.select(F.col("n").alias("p"), "root", "depth", "path").alias("k")
        joined = gone.join(top, "p", "left")
        ring = F.col("depth") == -1
        new = joined.select(
            "n",
            F.when(F.col("p").isNull(), F.col("n")).otherwise(F.col("root")).alias("root"),
            F.when(F.col("p").isNull(), 0).when(ring, -1).otherwise(F.col("depth") + F.col("w")).alias("depth"),
            (
                F.when(F.col("p").isNull(), F.array("n")).when(ring, F.array_distinct(F.concat(F.array("n"), "via", "path"))).otherwise(F.concat(F.array("n"), "via", "path"))
                if paths
                else path
            ).alias("path"),
        )
        known = scratch.save(known.unionByName(new), f"known{r}")
        scratch.drop(f"known{r + 1}")
        scratch.drop(f"step{r}")
    out = known.join(links.select("n", F.col("p").alias("parent")), "n")
    ring = F.col("depth") == -1
    ways = [F.when(~ring, F.col("path")).alias("path"), F.when(ring, F.col("path")).alias("round")]
    return out.select(F.col("n").alias("id"), "parent", "root", "depth", *(ways if paths else []))


def contract(live: pd.DataFrame, paths: bool) -> pd.DataFrame:
    """n, root, depth and path of live nodes (n, p, w, least, via), by the rounds of ``_contract`` over arrays."""
    n = live["n"].to_numpy(np.int64)
    order = np.argsort(n)
    n = n[order]
    raw = live["p"].to_numpy()[order]
    there = ~pd.isna(raw)
    p = np.full(len(n), -1)
    p[there] = np.searchsorted(n, raw[there].astype(np.int64))
    w = live["w"].to_numpy(np.int64)[order].copy()
    least = live["least"].fillna(np.iinfo(np.int64).max).to_numpy(np.int64)[order].copy()
    via = [[*map(int, v)] for v in live["via"].to_numpy()[order]] if paths else None
    own = np.arange(len(n))
    alive = np.ones(len(n), bool)
    steps: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    while (alive & (p != own)).any():
        kids = np.bincount(p[alive & (p >= 0)], minlength=len(n))
        only = np.zeros(len(n), np.int64)
        has = np.flatnonzero(alive & (p >= 0))
        only[p[has]] = has
        with np.errstate(over="ignore"):  # priorities differ by round
            rank = (own.astype(np.uint64) + np.uint64(len(steps) + 1) * np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xC2B2AE3D27D4EB4F)
            rank ^= rank >> np.uint64(29)
            rank *= np.uint64(0x165667B19E3779F9)
        v = np.flatnonzero(alive & (kids == 1) & (p >= 0) & (p != own))
        v = v[(rank[v] > rank[p[v]]) & (rank[v] > rank[only[v]])]
        leaves = np.flatnonzero(alive & (kids == 0))
        c = only[v]
        spliced = (v, p[v].copy(), w[v].copy())
        p[c], w[c], least[c] = p[v], w[c] + w[v], np.minimum(least[c], least[v])
        if paths:
            for x, y in zip(c.tolist(), v.tolist()):
                via[x] = [*via[x], int(n[y]), *via[y]]
        gone = tuple(np.concatenate(x) for x in zip(spliced, (leaves, p[leaves], w[leaves])))
        alive[gone[0]] = False
        steps.append(gone)
    root, depth = np.minimum(n, least), np.full(len(n), -1)
    way: list = [[int(x), *v] for x, v in zip(n, via)] if paths else [None] * len(n)
    for at, up, by in reversed(steps):
        top = up < 0
        over = np.where(top, at, up)
        root[at] = np.where(top, n[at], root[over])
        depth[at] = np.where(top, 0, np.where(depth[over] < 0, -1, depth[over] + by))
        if paths:
            for x, y in zip(at.tolist(), up.tolist()):
                way[x] = [int(n[x])] if y < 0 else [int(n[x]), *via[x], *way[y]]
                if y >= 0 and depth[x] < 0:
                    way[x] = [*dict.fromkeys(way[x])]
    return pd.DataFrame({"n": n, "root": root, "depth": depth.astype(np.int32), "path": way})


def _contract(live: DataFrame, r: int, paths: bool, scratch: Scratch) -> tuple[DataFrame, int, int]:
    """One round. Rows tagged 'gone' were raked or spliced out in it, 'live' ones stay; with the number of those that can
    shrink and of all that stay."""
    kids = live.where("p is not null").groupBy("p").agg(F.count("*").alias("k"), F.max("n").alias("only"))
    seen = live.join(kids.withColumnRenamed("p", "q"), F.col("n") == F.col("q"), "left").drop("q")
    # Priorities differ by round; a spliced node beats its parent and its child, so neither of them is spliced.
    rank = lambda c: F.xxhash64(F.col(c), F.lit(r))
    splice = (
        (F.col("k") == 1)
        & F.col("p").isNotNull()
        & (F.col("p") != F.col("n"))
        & (rank("n") > rank("p"))
        & (rank("n") > rank("only"))
    )
    seen = seen.withColumn("splice", F.coalesce(splice, F.lit(False)))
    bridge = seen.where("splice").select(
        F.col("only").alias("c"), F.col("n").alias("v"), F.col("p").alias("vp"), F.col("w").alias("vw"),
        F.col("least").alias("vleast"), F.col("via").alias("vvia"),
    )
    hit = F.col("c").isNotNull()
    via = F.when(hit, F.concat("via", F.array("v"), "vvia")).otherwise(F.col("via")) if paths else F.col("via")
    kept = seen.where("not splice").join(bridge, F.col("n") == F.col("c"), "left")
    kept = kept.select(
        "n",
        F.coalesce("vp", "p").alias("p"),
        (F.col("w") + F.coalesce("vw", F.lit(0))).alias("w"),
        F.least("least", "vleast").alias("least"),
        via.alias("via"),
        F.when(F.col("k").isNull(), "gone").otherwise("live").alias("tag"),
    )
    out = seen.where("splice").select("n", "p", "w", "least", "via", F.lit("gone").alias("tag"))
    watch = Observation()
    todo = (F.col("tag") == "live") & (F.col("p").isNull() | (F.col("p") != F.col("n")))
    both = kept.unionByName(out).observe(watch, F.count(F.when(todo, 1)).alias("left"), F.count(F.when(F.col("tag") == "live", 1)).alias("live"))
    step = scratch.save(both, f"step{r}")
    return step, watch.get["left"], watch.get["live"]


def descendants(tree: DataFrame) -> DataFrame:
    """(id, descendant, distance): every node with all that build on it, from the paths of ``hierarchy(paths=True)``.
    As many rows as the sum of depths. The nodes of a circle build on each other, and what hangs below one on all of them;
    the distance is the shortest, and no node is its own descendant."""
    way = F.coalesce("path", "round")
    return tree.select(F.col("id").alias("descendant"), F.posexplode(way).alias("distance", "id")).where("distance > 0").select("id", "descendant", "distance")


def descendant_counts(tree: DataFrame) -> DataFrame:
    """id, n_descendants for every node of ``tree``; 0 where nothing builds on it."""
    n = descendants(tree).groupBy("id").agg(F.count("*").alias("n"))
    return tree.select("id").join(n, "id", "left").select("id", F.coalesce("n", F.lit(0)).alias("n_descendants"))
