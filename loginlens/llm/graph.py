"""Connected components with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loginlens.llm.common import delete_stored, stored

MAX_ROUNDS = 60


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _joined_with_least(edges: DataFrame, both_ways: bool) -> DataFrame:
    """Edges with ``m``, the least neighbour (or itself) of ``a``.

    The least neighbours are written before the join: its sides are then plain shuffles, which Spark can split where one
    node has very many edges.
    """
    if both_ways:
        edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), "least")
    return edges.join(least, "a")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of the edges (a, b), the component being its smallest node.

    Alternating star contraction: every node's larger neighbours move to its least neighbour, then its smaller ones do;
    the edges shrink to one star per component in a number of rounds that grows with the logarithm of the node count.
    Loops and repeated edges do no harm, edges with a null end are left out; no edges give no rows. Every round is
    written to the shared folder.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a is not null and b is not null and a != b").distinct()
    # greatest and least ignore nulls, so an edge with one null end has become a loop.
    edges = stored(edges, "edges")
    state = _state(edges)
    for _ in range(MAX_ROUNDS):
        if state[0] == 0:
            break
        large = _joined_with_least(edges, True).filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = stored(large.filter("a != b").distinct(), "large")
        small = _joined_with_least(large, False)
        moved = small.select(F.col("a"), F.col("m").alias("b")).unionByName(small.filter("b != m").select(F.col("b").alias("a"), F.col("m").alias("b")))
        after = stored(moved.distinct(), "edges")
        delete_stored(large)
        delete_stored(edges)
        new_state = _state(after)
        edges = after
        if new_state == state:
            break
        state = new_state
    else:
        raise RuntimeError(f"no fixed point after {MAX_ROUNDS} rounds")
    roots = edges.select(F.col("b").alias("node")).distinct().withColumn("component", F.col("node"))
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
