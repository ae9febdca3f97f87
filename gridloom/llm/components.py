"""Connected components of an edge table, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from gridloom.session import scratch_folder

MOST_ROUNDS = 60


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a long, b long); the component is its least node.

    Large-star and small-star steps in turn: first each node's larger neighbours, then its smaller
    ones, are linked to the least node it knows, until every edge leads to its component. The number
    of rounds grows with the logarithm of the longest path. A round aggregates before it joins, and
    the adaptive skew join splits the edges of a hub. Each round is written by ``checkpoint()`` to the
    shared folder, so a lost executor costs one round at most and nothing is gathered on the driver.

    Null ends and loops are dropped, repeated and reversed edges count once, no edges give no rows.
    """
    scratch_folder(edges.sparkSession)
    ordered = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    current = ordered.filter("a is not null and b is not null and a <> b").distinct().checkpoint()
    state = _state(current)
    if not state[0]:
        return current.select(F.col("a").alias("node"), F.col("b").alias("component"))
    for _ in range(MOST_ROUNDS):
        both = current.select("a", "b").unionByName(current.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.filter("a <> b").distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(least, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        following = small.unionByName(least.select("a", F.col("m").alias("b"))).distinct().checkpoint()
        before, state, current = state, _state(following), following
        if state == before:
            roots = current.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
            return current.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots)
    raise RuntimeError(f"components did not settle in {MOST_ROUNDS} rounds")
