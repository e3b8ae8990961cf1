"""Connected components by alternating star contraction (shuffle joins and aggregates only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrygraph.sources.tables import cut


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """``(node, component)`` for every node on an edge; component = smallest node reachable.

    Each round contracts the neighbours of a node onto the smallest one, first over both directions
    and then over the edges that point down, until the edge set no longer changes.  The number of
    rounds is logarithmic in the diameter.  Nothing is gathered per node: the minimum is a partially
    aggregated ``min`` joined back, so a hub with many neighbours is no single-task group.  Every
    round is cut with a checkpoint.  Null ends are ignored, self loops give singletons.
    """
    pairs = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).dropna()
    nodes = pairs.select("u").union(pairs.select(F.col("v").alias("u"))).distinct()
    now = cut(_down(pairs))
    state = _state(now)
    for _ in range(max_rounds):
        if state[0] == 0:
            break
        now = cut(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    # At the fixed point every edge (u, v) has v the smallest node of u's component.
    return nodes.join(now, "u", "left").select(F.col("u").alias("node"), F.coalesce("v", "u").alias("component"))


def _down(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()


def _state(pairs: DataFrame) -> tuple:
    row = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], row["h"]


def _large_star(pairs: DataFrame) -> DataFrame:
    both = pairs.union(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # A neighbour above u moves to the smallest node around u.
    return _down(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")))


def _small_star(pairs: DataFrame) -> DataFrame:
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    moved = pairs.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return _down(moved.union(least.select("u", F.col("m").alias("v"))))
