"""Connected components by alternating large-star and small-star operations, for nodes of any type that has an order.

Large-star links every larger neighbour of a node to the node's smallest neighbour, small-star every smaller one. After a number of steps that
grows with the logarithm of the longest path, each node but the smallest of its component has one edge, to that smallest one.

A hub (one node with a large part of all edges) makes no task larger than others: smallest neighbours are summed up before they are
shuffled, and are a table of their own before they are joined, so that Spark can split the hub's side of the join. Each step's edges are kept: the plan
stays short, and a lost executor costs one step at most. Counts alone reach the driver.

Before the first step every task joins what lies together in its own rows, BLOCK edges at a time: of each block's parts only stars are passed on, as many edges
less those that close a ring. Chains whose links lie in one file one behind the other, as windows and drawings leave them, are stars then, so the steps
have only what crosses blocks left to do.

Defined cases: an edge with a null end, or from a node to itself, joins nothing; repeated edges count once; no edges give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.plans.storage import forget, keep

#: Edges that a task joins at a time.
BLOCK = 500_000
#: Rows that stay together after joins, as a power of two.
NEAR = 18


def _stars(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """The parts that edges make, as edges from each node to one of its part: the smallest, where Arrow has an order for them."""
    codes = pa.chunked_array([u, v]).combine_chunks().dictionary_encode()
    names = codes.dictionary
    try:
        order = pc.sort_indices(names)
    except (pa.ArrowNotImplementedError, pa.ArrowTypeError):
        order = pa.array(np.arange(len(names)))
    place = np.empty(len(names), np.int64)
    place[order.to_numpy()] = np.arange(len(names))
    ends = place[codes.indices.to_numpy()]
    a, b = ends[: len(u)], ends[len(u) :]
    root = np.arange(len(names))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while (far := root[root]).tobytes() != root.tobytes():
            root = far
    nodes = np.flatnonzero(root != np.arange(len(names)))
    names = names.take(order)
    return names.take(pa.array(nodes)), names.take(pa.array(root[nodes]))


def _joined(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK:
                yield whole(held)
                held, n = [], 0
        if n:
            yield whole(held)

    def whole(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held).combine_chunks()
        u, v = (t[c].combine_chunks() if t[c].num_chunks != 1 else t[c].chunk(0) for c in ("u", "v"))
        return pa.RecordBatch.from_arrays(list(_stars(u, v)), schema=held[0].schema)

    if edges.schema["u"].dataType.typeName() == "struct":  # no dictionaries of structs
        return edges
    return edges.mapInArrow(run, edges.schema)


def numbered(df: DataFrame) -> DataFrame:
    """df with at: rows that lie together in a task or file have numbers next to each other."""
    return df.withColumn("at", F.monotonically_increasing_id())


def together(df: DataFrame) -> DataFrame:
    """Rows as they lay when they were numbered, after joins that dealt them out by other columns: what follows finds neighbours in its own rows. Tasks get stretches of NEAR rows."""
    return df.repartition(F.shiftrightunsigned("at", NEAR)).sortWithinPartitions("at")


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _least(edges: DataFrame) -> DataFrame:
    return keep(edges.groupBy("u").agg(F.min("v").alias("m")), "least")


def components(edges: DataFrame) -> DataFrame:
    """edges: (u, v), in any direction. Returns (node, component): every node that has an edge to another, and the smallest node it reaches."""
    own = _joined(edges.select("u", "v").where("u <> v"))
    own = keep(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    state = _state(own)
    while state[0]:
        both = own.unionByName(own.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = _least(both)
        large = keep(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v")).distinct(), "large")
        low2 = _least(large)
        small = large.join(low2, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low2.select("u", F.col("m").alias("v")))
        new = keep(small.distinct(), "edges")
        before, state = state, _state(new)
        for done in (own, low, large, low2):
            forget(done)
        own = new
        if state == before:
            break
    ends = own.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return ends.unionByName(own.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def component_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes: node. edges: source, target, either may be null. node, component for all of nodes; a node without an edge is its own."""
    joined = components(edges.select(F.col("source").alias("u"), F.col("target").alias("v"))).withColumnRenamed("node", "own")
    every = nodes.select("node").distinct()
    return every.join(joined, every["node"] == joined["own"], "left").select("node", F.coalesce("component", "node").alias("component"))
