"""Connected components of an edge table, without gathering edges anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.shared import drop_kept, kept

#: Up to so many distinct edges (16 bytes each) one task finds the components; above, star rounds do.
LOCAL_EDGES = 500_000


def _union(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while parent[top] != top:
            top = parent[top]
        while parent[x] != top:
            parent[x], x = top, parent[x]
        return top

    for batch in batches:
        for u, v in zip(batch.u.tolist(), batch.v.tolist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pd.DataFrame({"node": nodes, "component": [root(x) for x in nodes]}, dtype="int64")


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return row[0], int(row[1] or 0)


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """One star operation: neighbours of u move to the smallest of u and its neighbours.

    both: large star, over both directions, moving the larger neighbours only;
    else small star, over edges that point to smaller nodes.
    """
    if both:
        edges = edges.union(edges.select("v", "u")).toDF("u", "v")
    least = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("m"))
    moved = edges.join(least, "u")
    if both:
        moved = moved.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        moved = moved.select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v"))
    return moved.where("u <> v").distinct()


def components(edges: DataFrame, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """(node, component) for each node of edges (u long, v long); component: its smallest node.

    Where the counted edges fit the bound of local_edges, one task unites them.
    Otherwise alternating large-star and small-star rounds, each written to the
    shared folder, until the edges are stars: a hub with a third of all edges is
    one partial sum per task and a join that Spark splits. Self loops, repeated
    edges and nulls are ignored; no edges give no rows.
    """
    ordered = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    current = kept(ordered.where("u <> v").distinct(), "edges")
    state = _state(current)
    if state[0] <= local_edges:
        return current.coalesce(1).mapInPandas(_union, "node long, component long")
    while True:
        after = kept(_star(_star(current, True), False), "edges")
        before, state = state, _state(after)
        drop_kept(current)
        current = after
        if before == state:
            break
    stars = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    centres = stars.select(F.col("component").alias("node"), "component").distinct()
    return stars.union(centres)
