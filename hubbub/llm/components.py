"""Connected components of a graph held as a table of edges."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubbub.llm.common import discard, stage

#: Edges that one task closes at once, whatever the size of the graph: 4 MB of ids.
AT_ONCE = 1 << 18


def _close(batches):
    """Every node of the edges and the smallest node that it reaches."""
    ends = [(b["u"].to_numpy(), b["v"].to_numpy()) for b in batches]
    if not ends:
        return
    u, v = (np.concatenate(x) for x in zip(*ends))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = at[: len(u)], at[len(u) :], np.arange(len(nodes))
    while not np.array_equal(root[a], root[b]):
        x, y = root[a], root[b]
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(root, root[root]):
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(nodes[root], pa.int64())], ["node", "component"])


def connected_components(edges: DataFrame, max_rounds: int = 60, at_once: int = AT_ONCE) -> DataFrame:
    """node, component (its smallest node) of every node that has an edge (u, v).

    In a round every node moves to the first of itself and its neighbours, and edges are drawn anew between the places;
    those whose ends meet are gone. First is the smallest node in round 0, which folds stars around their smallest node,
    and the one of the smallest hash later, which halves ordered chains too. One task closes the edges once at most at_once
    are left. Firsts are combined before the shuffle, staged and joined back as a plain table, so Spark splits a node with
    very many neighbours like any skewed join key. Each round is staged, so no lineage grows; its tables go when they have
    been read. Null ends have no edge; repeated edges count once."""
    now = edges.select(F.greatest("u", "v").cast("long").alias("u"), F.least("u", "v").cast("long").alias("v")).where("u > v").distinct()
    now, moves = stage(now, "edges"), []
    while now.count() > at_once:
        if len(moves) == max_rounds:
            raise RuntimeError(f"edges are left after {max_rounds} rounds")
        rank = (lambda c, seed=len(moves): F.xxhash64(c, F.lit(seed))) if moves else F.col
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = both.groupBy("u").agg(F.min_by("v", rank("v")).alias("v"))
        to = F.when(rank("v") < rank("u"), F.col("v")).otherwise(F.col("u"))
        moves.append(stage(first.select(F.col("u").alias("node"), to.alias("to")), "moves"))
        moved = now
        for end in ("u", "v"):
            moved = moved.join(moves[-1].select(F.col("node").alias(end), F.col("to").alias(f"{end}_to")), end)
        moved = moved.select(F.greatest("u_to", "v_to").alias("u"), F.least("u_to", "v_to").alias("v")).where("u > v").distinct()
        old, now = now, stage(moved, "edges")
        discard(old)
    out = stage(now.coalesce(1).mapInArrow(_close, "node long, component long"), "components")
    discard(now)
    if not moves:
        return out
    for move in reversed(moves):
        out = move.join(out.select(F.col("node").alias("to"), "component"), "to", "left").select("node", F.coalesce("component", "to").alias("component"))
    if len(moves) > 1:  # by hashes a component is not named by its smallest node
        out = stage(out, "components")
        least = stage(out.groupBy("component").agg(F.min("node").alias("least")), "least")
        out = out.join(least, "component").select("node", F.col("least").alias("component"))
    out = stage(out, "components")
    discard(*moves)
    return out
