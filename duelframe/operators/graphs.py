"""Connected components of an entity graph, by written rounds of joins."""

import sys

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F

from ..session import discard, materialize

# Edges that a task gathers before it replaces them by stars.
GATHERED = 1_000_000

# Functions sent to executors carry their code.
cloudpickle.register_pickle_by_value(sys.modules["duelframe.operators"])


def _roots(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The least number that each of n nodes is connected with."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(root, root[root]):
            root = root[root]
    return root


def _star(tables) -> pa.Table:
    """Every node of the edges with one node of its component."""
    edges = pa.concat_tables(tables)
    nodes = pc.unique(pa.chunked_array([*edges.column("u").chunks, *edges.column("v").chunks]))
    u, v = (pc.index_in(edges.column(c), value_set=nodes).to_numpy() for c in ("u", "v"))
    return pa.table({"u": nodes, "v": nodes.take(pa.array(_roots(len(nodes), u, v)))})


def _stars(batches):
    """The edges of a task as stars: as many rows as it has nodes, however many edges."""
    held, size, most = [], 0, GATHERED
    for batch in batches:
        if batch.num_rows:
            held.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
        if size >= most:
            held = [_star(held)]
            size = len(held[0])
            most = max(GATHERED, 2 * size)
    if held:
        yield from _star(held).to_batches(max_chunksize=10_000)


def connected(edges: DataFrame, a="a", b="b") -> DataFrame:
    """(node, component) of every node of an edge: the least node it is connected with.

    Each round a node hears the least label of its neighbours and follows its own label one step; labels only fall, so
    the loop ends when none has. A hub's edges are reduced before they are shuffled by it, and its label is one row.
    The scanning tasks hand on stars, so repeated edges and cycles are neither shuffled nor joined.
    """
    there = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u is not null and v is not null")
    there = there.mapInArrow(_stars, there.schema)
    both = materialize(there.union(there.select("v", "u")).distinct(), "edges")
    written = labels = materialize(both.groupBy("u").agg(F.min("v").alias("least")).select("u", F.least("u", "least").alias("label")), "labels")
    while True:
        heard = both.join(labels.withColumnsRenamed({"u": "v"}), "v").groupBy("u").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, "u").select("u", "label", F.least("label", "heard").alias("lower"))
        ahead = labels.select(F.col("u").alias("lower"), F.col("label").alias("next"))
        after = lower.join(ahead, "lower").select("u", F.least("lower", "next").alias("label"), (F.least("lower", "next") < F.col("label")).alias("fell"))
        after = materialize(after, "labels")
        discard(written)
        written, labels = after, after.select("u", "label")
        if after.where("fell").isEmpty():
            discard(both)
            return labels.withColumnsRenamed({"u": "node", "label": "component"})
