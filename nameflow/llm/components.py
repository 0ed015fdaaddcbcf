"""Connected components of an edge table, without bringing edges or components to the driver.

Each round first contracts within tasks (a union-find over the edges that a task happens to hold turns
them into stars).  Once the edges are fewer than SMALL_EDGES one task finishes them; until then nodes of
several targets tie these together and every node takes over its target's target, so labels only
fall.  A hub's edges are pre-aggregated before they move.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import shared_folder, written

#: Edges (of 16 bytes) that one task contracts at once.
SMALL_EDGES = 2_000_000


def union_find(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component) of the edges a-b; hooking and pointer jumping
    over arrays."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = flat[: len(a)], flat[len(a) :]
    root = np.arange(len(nodes))
    while len(x):
        lo, hi = np.minimum(root[x], root[y]), np.maximum(root[x], root[y])
        live = lo != hi
        x, y, lo, hi = x[live], y[live], lo[live], hi[live]
        np.minimum.at(root, hi, lo)
        while True:
            up = root[root]
            if (up == root).all():
                break
            root = up
    return nodes, nodes[root]


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def star() -> tuple[np.ndarray, np.ndarray]:
        nodes, root = union_find(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]))
        keep = nodes != root
        return nodes[keep], root[keep]

    for b in batches:
        u, v = (b.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        some = ~np.asarray(b.column(0).is_null()) & ~np.asarray(b.column(1).is_null())
        some &= u != v
        held.append((u[some].astype(np.int64), v[some].astype(np.int64)))
        if sum(len(h[0]) for h in held) > SMALL_EDGES:
            held = [star()]
            if len(held[0][0]) > SMALL_EDGES // 2:
                yield pa.RecordBatch.from_arrays([pa.array(held[0][0]), pa.array(held[0][1])], names=["u", "v"])
                held = []
    if held:
        u, v = star()
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def components(edges: DataFrame, name: str = "components", most_rounds: int = 64, before=None) -> DataFrame:
    """edges (u, v bigint) -> (node, component): the smallest node that each node is connected with.
    Nodes without edges to others, and smallest nodes themselves, do not appear.  Null ends are ignored.
    before: makes edges out of the Arrow batches of `edges`, in the task (and Python worker) that contracts them."""
    folder = shared_folder(edges.sparkSession, name)
    kind = "u bigint, v bigint"
    contract = _stars if before is None else lambda batches: _stars(before(batches))
    given = edges.select("u", "v") if before is None else edges
    pairs = written(given.mapInArrow(contract, kind), f"{folder}/0")
    for k in range(1, most_rounds):
        if pairs.count() <= SMALL_EDGES:
            return written(pairs.coalesce(1).mapInArrow(_stars, kind), f"{folder}/last").toDF("node", "component")
        least = pairs.groupBy("u").agg(F.min("v").alias("m"))
        tied = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        jump = least.join(least.select(F.col("u").alias("m"), F.col("m").alias("w")), "m", "left").select("u", F.coalesce("w", "m").alias("v"), F.col("w").isNotNull().alias("moved"))
        if not tied.limit(1).count() and not jump.where("moved").limit(1).count():
            return pairs.toDF("node", "component")
        direct = least.toDF("u", "v")
        pairs = written(direct.union(tied).union(jump.select("u", "v")).distinct().mapInArrow(_stars, kind), f"{folder}/{k}")
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
