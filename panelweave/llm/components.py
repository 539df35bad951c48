"""Connected components of an edge table by randomised contraction."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .shared import settle

#: So few edges are finished in one task, whatever number there was at first;
#: more go through another round.
FEW_EDGES = 1 << 16


def _moves_of_few(edges: DataFrame) -> DataFrame:
    """``from``, ``to`` for the nodes of a counted, small edge table: ``to`` is
    the least node of the component."""
    kind = edges.schema["a"].dataType
    schema = T.StructType([T.StructField("from", kind), T.StructField("to", kind)])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above: dict = {}

        def root(node):
            while (up := above.setdefault(node, node)) != node:
                above[node] = node = above[up]
            return node

        for batch in batches:
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = root(a), root(b)
                above[max(a, b)] = min(a, b)
        nodes = list(above)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, arrow), pa.array(list(map(root, nodes)), arrow)], schema.names)

    arrow = to_arrow_type(kind)
    return edges.select("a", "b").coalesce(1).mapInArrow(work, schema)


def components(edges: DataFrame, left: str = "a", right: str = "b") -> DataFrame:
    """``node``, ``root``: one row per node of an edge, the root being some
    node of its component.

    In each round every node joins its neighbour with the least random number
    (or stays), and edges are redrawn between what is left.  A constant share of
    the nodes goes each round, whatever the shape, so chains take no longer
    than stars.  Labels are rewritten by joins; nothing is collected.  The last
    :data:`FEW_EDGES` edges, which rounds of their own would outlast, are joined
    in one task.
    """
    edges = settle(edges.select(F.col(left).alias("a"), F.col(right).alias("b")).where("a <> b").distinct())
    labels = None
    turn = 0
    while (left_over := edges.limit(FEW_EDGES + 1).count()) > 0:
        turn += 1
        if left_over <= FEW_EDGES:
            moves = settle(_moves_of_few(edges))
            return _relabelled(labels, moves)
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        draw = F.xxhash64("b", F.lit(turn))
        best = both.groupBy("a").agg(F.min(F.struct(draw.alias("draw"), F.col("b").alias("to"))).alias("best"))
        own = F.xxhash64("a", F.lit(turn))
        moves = settle(
            best.select(F.col("a").alias("from"), F.when(F.col("best.draw") < own, F.col("best.to")).otherwise(F.col("a")).alias("to"))
        )
        labels = _relabelled(labels, moves)
        ends = moves.select(F.col("from").alias("f"), F.col("to").alias("t"))
        edges = settle(
            edges.join(moves, edges["a"] == moves["from"])
            .select(F.col("to").alias("a"), "b")
            .join(ends, F.col("b") == F.col("f"))
            .select("a", F.col("t").alias("b"))
            .where("a <> b")
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
            .distinct()
        )
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels


def _relabelled(labels: DataFrame | None, moves: DataFrame) -> DataFrame:
    if labels is None:
        return moves.select(F.col("from").alias("node"), F.col("to").alias("root"))
    moved = labels.join(moves, labels["root"] == moves["from"], "left")
    return settle(moved.select("node", F.coalesce("to", "root").alias("root")))
