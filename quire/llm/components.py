"""Connected components, on the executors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import Scratch

#: So many links (16 bytes each, a hundred MB of work) are closed within one task; more are worked on by all.
LOCAL = 1 << 20


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, the smallest node that each reaches) for links a-b: roots are hooked to smaller ones, then paths are halved."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    low = np.arange(len(nodes))
    while len(x):
        p, q = low[x], low[y]
        apart = p != q
        x, y, p, q = x[apart], y[apart], p[apart], q[apart]
        np.minimum.at(low, np.maximum(p, q), np.minimum(p, q))
        while (low[low] != low).any():
            low = low[low]
    return nodes, nodes[low]


def connected_components(edges: DataFrame, scratch: Scratch, label: str, max_rounds: int = 64, local: int = LOCAL) -> DataFrame:
    """(node, component) for every node of `edges` (a, b), component being the smallest node reachable.

    Up to `local` different links are closed in the memory of one executor's task. Beyond that large-star and small-star steps
    alternate until nothing changes; each step is a minimum per node, summed before the shuffle, and a join, whose
    skewed keys (the neighbours of a hub) Spark splits, as the other side has a row a node. Every round's links are written to the
    shared folder, so the plan stays short and a lost executor costs one round. Nothing is gathered on the driver but a count
    and a checksum. Null ends and loops are ignored; no edges give no rows.
    """
    state = (
        edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct()
    )
    state = scratch.save(state, f"{label}-0")
    mark = _mark(state)
    if mark[0] <= local:

        def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            held = [(pdf["u"].to_numpy(), pdf["v"].to_numpy()) for pdf in batches]
            u, v = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (zip(*held, strict=True) if held else ((), ())))
            nodes, low = smallest_reachable(u, v)
            yield pd.DataFrame({"node": nodes, "component": low})

        return scratch.save(state.repartition(1).mapInPandas(close, "node long, component long"), f"{label}-closed")
    for k in range(1, max_rounds + 1):
        both = state.union(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min(F.least("u", "v")).alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        inner = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        state = scratch.save(inner.union(low.select("u", F.col("m").alias("v"))).distinct(), f"{label}-{k}")
        scratch.drop(f"{label}-{k - 1}")
        before, mark = mark, _mark(state)
        if before == mark:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def _mark(state: DataFrame) -> tuple:
    return tuple(state.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
