"""Connected components of a graph given as an edge table, without gathering it anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mailquarry.llm.common import batches_of, cut


#: Edges for each task, and the least number of tasks: a small graph is not dealt to more tasks than it needs.
TASK_EDGES, LEAST_TASKS = 100_000, 8


def _least(pairs: DataFrame) -> DataFrame:
    """(node, low): the least of each node and its neighbours."""
    return pairs.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("low"))


def contracted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the edges (a, b), and the least node of the component of each."""
    nodes, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = ends[: a.size], ends[a.size :]
    label = np.arange(nodes.size)
    while True:
        low, now = np.minimum(label[x], label[y]), label.copy()
        np.minimum.at(now, label[x], low)
        np.minimum.at(now, label[y], low)
        while (now[now] != now).any():
            now = now[now]
        if (now == label).all():
            return nodes, nodes[label]
        label = now


def _contracted_batches(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = list(batches_of(source))
    if held:
        found = contracted(*(np.concatenate([b.column(k).to_numpy() for b in held]) for k in range(2)))
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["node", "label"])


def components(edges: DataFrame, most_rounds: int = 60, one_task: int = 0) -> DataFrame:
    """Labels every node of an edge table (a, b) with the least node of its component: (node, label).

    Alternates two star contractions ("large star": larger neighbours move to the least neighbour; "small star": the
    smaller ones do) until the edges form one star for each component. The number of rounds grows with the logarithm of
    the longest path. Each round aggregates with partial minima and joins on the node; a hot centre is left to skew
    handling of the join. Every round is checkpointed. Self edges and repeated edges are allowed; nulls are dropped;
    no edges give no rows. A graph of long nodes that has at most `one_task` edges is contracted in one task instead.
    """
    kind = edges.schema["a"].dataType
    now = cut(edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state, n = None, now.count()
    if n <= one_task and kind.simpleString() == "bigint":
        return now.coalesce(1).mapInArrow(_contracted_batches, "node long, label long")
    tasks = LEAST_TASKS + n // TASK_EDGES
    for _ in range(most_rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b"))).coalesce(tasks)
        large = both.join(_least(both).coalesce(tasks), "a").where("b > a").select(F.col("b").alias("a"), F.col("low").alias("b")).coalesce(tasks).distinct().coalesce(tasks)
        pulled = large.join(_least(large).coalesce(tasks), "a").coalesce(tasks)
        now = cut(
            pulled.select(F.col("b").alias("a"), F.col("low").alias("b"))
            .unionByName(pulled.select("a", F.col("low").alias("b")))
            .where("a <> b")
            .coalesce(tasks)
            .distinct()
            .coalesce(tasks)
        )
        was, state = state, tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state == was or not state[0]:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    leaves = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    roots = now.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct()
    return leaves.unionByName(roots).select(F.col("node").cast(kind), F.col("label").cast(kind))
