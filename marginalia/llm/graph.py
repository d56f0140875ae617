"""Connected components of an edge table by contraction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.common import written_small

#: Rounds in the order of the nodes.
ORDERED = 3


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node`` and ``root`` (smallest node of its component) for every node of the edges.

    In each round a node moves to the first among itself and its neighbours, and the edges are drawn anew between the places
    moved to; edges within a place are gone, equal ones are one. The order is that of the nodes in the first rounds, which
    contracts what hangs on few nodes at once, and a new random one in each later round, so that long chains shrink by a
    share as well. Rounds end when no edge is left.
    All joins are between written tables, which lets adaptive execution split the rows of a node with very many edges.
    """
    left = written_small(
        edges.select(F.least(a, b).alias("x"), F.greatest(a, b).alias("y")).where("x <> y").distinct(), "edges")
    moves: list[DataFrame] = []
    while left.limit(1).count():

        def place(node: Column, turn: int = len(moves)) -> Column:
            order = node if turn < ORDERED else F.xxhash64(node, F.lit(turn))
            return F.struct(order.alias("order"), node.alias("node"))

        ends = left.select("x", "y").union(left.select("y", "x"))
        low = written_small(
            ends.groupBy(F.col("x").alias("node")).agg(F.min(place(F.col("y"))).alias("near"))
            .select("node", F.least("near", place(F.col("node")))["node"].alias("to")), "moves")
        moves.append(low)
        first = left.join(low.toDF("x", "to_x"), "x").select("to_x", "y")
        both = first.join(low.toDF("y", "to_y"), "y").select(F.least("to_x", "to_y").alias("x"), F.greatest("to_x", "to_y").alias("y"))
        left = written_small(both.where("x <> y").distinct(), "edges")
    if not moves:
        return left.select(F.col("x").alias("node"), F.col("y").alias("root"))
    # The place of the place of ... the place of each node.
    known = moves[0].toDF("node", "root")
    for i, move in enumerate(moves[1:], 1):
        known = known.join(move.toDF("root", "next"), "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        if i % 4 == 0:
            known = written_small(known, "places")
    known = written_small(known, "places")
    least = written_small(known.groupBy("root").agg(F.min(F.least("node", "root")).alias("least")), "roots")
    return written_small(known.join(least, "root").select("node", F.col("least").alias("root")), "components")
