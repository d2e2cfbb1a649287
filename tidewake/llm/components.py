"""Connected components by label propagation with pointer jumping, all on DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewake.llm.common import stored


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable, for every id in edges (a, b), which need not be distinct.

    Each round gives a vertex the smallest label among its own and its neighbours', hands that label on to the vertex
    its old label names, and then follows labels once, so long chains take a logarithmic number of rounds. Group sizes
    do not matter: minima are taken on the map side, and only joins split by AQE carry hubs. No edges, no rows.
    """
    pairs = edges.where("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").distinct()
    both = stored(pairs.union(pairs.select("b", "a")).toDF("a", "b").distinct(), "edges")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("id"), F.least("a", "m").alias("component")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.hint("merge"), F.col("b") == F.col("id")).select(F.col("a").alias("id"), "component")
        best = near.groupBy("id").agg(F.min("component").alias("m"))
        joined = labels.join(best.hint("merge"), "id").select("id", F.col("component").alias("old"), F.least("component", "m").alias("new"))
        joined = stored(joined, "labels")
        if joined.where("new < old").isEmpty():
            return joined.select("id", F.col("new").alias("component"))
        # hand the label on to the vertex that the old label names, then follow it once
        handed = joined.where("new < old").groupBy(F.col("old").alias("id")).agg(F.min("new").alias("m"))
        hooked = joined.join(handed.hint("merge"), "id", "left").select("id", F.least("new", "m").alias("component"))
        hooked = stored(hooked, "labels")
        names = hooked.select(F.col("id").alias("_id"), F.col("component").alias("_next"))
        labels = stored(hooked.join(names.hint("merge"), F.col("component") == F.col("_id")).select("id", F.least("component", "_next").alias("component")), "labels")
    raise RuntimeError(f"no fixed point after {max_rounds} rounds")
