"""Connected components of a distributed edge list.

Alternating large-star and small-star steps: every step is a combinable minimum
per vertex and one join, so a hub with any number of edges is pre-aggregated
before the shuffle and no vertex's neighbours ever meet in one task. Each round
is written to the shared folder, which bounds the lineage. Up to ALONE edges,
whose rounds would be nothing but the start of tasks, are solved by one task; the
result is the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tessella.llm.common import Workspace

#: Edges that one task solves at most: 16 MB.
ALONE = 1_000_000


def solved(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The vertices in order, and the place of the least one that each reaches."""
    vertices, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    of = np.arange(len(vertices))
    while True:
        x, y = of[a], of[b]
        if (x == y).all():
            return vertices, of
        np.minimum.at(of, np.maximum(x, y), np.minimum(x, y))
        while (of[of] != of).any():
            of = of[of]


def _alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    if given := list(batches):
        edges = pa.Table.from_batches(given)
        vertices, of = solved(edges["u"].to_numpy(), edges["v"].to_numpy())
        yield pa.RecordBatch.from_arrays([pa.array(vertices), pa.array(vertices[of])], names=["vertex", "component"])


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def _least(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))


def components(edges: DataFrame, work: Workspace) -> DataFrame:
    """(vertex, component) of every vertex with an edge; component is the least vertex reachable.

    `edges` has columns u and v of BIGINT; loops and nulls are ignored.
    """
    given = work.put(edges.filter("u <> v").select("u", "v"))
    alone = given.count() <= ALONE
    now = work.put(given.coalesce(1).mapInArrow(_alone, "vertex long, component long") if alone else given.distinct())
    work.drop(given)
    if alone:
        return now
    before = None
    while True:
        both = _both_ways(now)
        large = both.join(_least(both).hint("shuffle_merge"), "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = _least(down)
        small = down.join(least.hint("shuffle_merge"), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        after = work.put(small.filter("u <> v").distinct())
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        work.drop(now)
        now = after
        if tuple(state) == before:
            return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(
                now.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct()
            )
        before = tuple(state)
