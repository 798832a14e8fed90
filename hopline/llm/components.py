"""Connected components of an edge table by alternating large and small stars.

Each step replaces a node's edges by edges to its least neighbour; the number of edges never grows, and after a few
rounds every node hangs on the least node of its component. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hopline.llm._shared import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (a > b). Large: each node joins its larger neighbours to its least; small: its smaller ones and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else edges
    least = both.groupBy("a").agg(F.min("b").alias("least")).select(F.col("a").alias("of"), F.least("least", "a").alias("least"))
    joined = both.join(least, F.col("a") == F.col("of"))
    if large:
        out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = joined.select(F.explode(F.array("a", "b")).alias("a"), F.col("least").alias("b"))
    return out.where("a <> b").distinct()


def connected(edges: DataFrame) -> DataFrame:
    """node, root for each node of ``edges`` (a, b: long) that is not the least of its component."""
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    e = written(e, "edges")
    before = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before or not state[0]:
            return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        e = written(_star(_star(e, True), False), "edges")
