"""Connected components of an edge table, without gathering links or components anywhere.

Alternates two star operations over the whole table: every node hands its smallest
neighbour to its larger neighbours (large star), then to its smaller ones and itself
(small star), until nothing changes; each node then points to the smallest of its
component. Each is one exchange and one pass over sorted edges. Before that, tasks
contract the edges they hold to spanning forests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, textbuf

EDGES = "a long, b long"


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(root, node) for each node that isn't the smallest of its component."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = np.arange(len(nodes))
    u, v = flat[: len(a)], flat[len(a) :]
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)
        np.minimum.at(new, label[v], least)
        new = new[new]
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    moved = label != np.arange(len(nodes))
    return nodes[label[moved]], nodes[moved]


def contracted(edges: DataFrame) -> DataFrame:
    """Per batch a spanning forest (a < b) of the batch's edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                root, node = forest(batch.column(0).to_numpy(), batch.column(1).to_numpy())
                yield pa.RecordBatch.from_arrays([pa.array(root), pa.array(node)], names=["a", "b"])

    return edges.select("a", "b").mapInArrow(textbuf.lean(run), EDGES)


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One star operation over edges (a, b), grouped by ``a``, in one exchange; a group's rows are sorted and spill, none is gathered.

    Large: each ``a`` hands its smallest neighbour (or itself) to its larger ones. Small: all ``b`` are
    smaller than ``a``, which hands the smallest to the others and itself.
    """
    own = Window.partitionBy("a").orderBy("b")
    seen = edges.select("a", "b", F.first("b").over(own).alias("m"), F.lag("b").over(own).alias("before"))
    once = seen.where("before is null or before <> b")
    if large:
        return once.where("b > a").select(F.least("a", "m").alias("a"), "b")
    return once.select(F.col("m").alias("a"), F.when(F.col("before").isNull(), F.col("a")).otherwise(F.col("b")).alias("b"))


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b) that isn't the smallest of its component."""
    spark = edges.sparkSession
    now, folder = common.written(contracted(edges.where("a <> b")), "edges")  # a < b from here on
    state = _state(now)
    while state[0]:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = _stars(both, large=True)
        next_, there = common.written(_stars(large.select(F.col("b").alias("a"), F.col("a").alias("b")), large=False), "edges")
        common.remove(spark, folder)
        before, now, folder = state, next_, there
        state = _state(now)
        if state == before:
            break
    return now.select(F.col("b").alias("node"), F.col("a").alias("component")).distinct()


def _state(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]
