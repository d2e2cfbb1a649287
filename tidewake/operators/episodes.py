"""Episodes of a token and its life cycle."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def token_episodes(flows: DataFrame, gap: int = 600, chunk: int = 3600) -> DataFrame:
    """ST-3: flows with episode, numbered from 1 per token; a pause of more than gap seconds starts the next.

    Starts are counted per chunk of time first and their running sum is taken over chunks, so a hot token does not sit
    in one task. A row's pause is measured to the latest earlier flow, found in its chunk or in the chunks before.
    """
    x = flows.withColumn("_chunk", F.floor(F.col("bt") / chunk))
    ends = x.groupBy("token", "_chunk").agg(F.max("bt").alias("_end"))
    over = Window.partitionBy("token").orderBy("_chunk")
    ends = ends.select(F.col("token").alias("_t"), F.col("_chunk").alias("_c"), F.lag("_end").over(over).alias("_before"))
    x = x.join(ends.hint("merge"), (F.col("token") == F.col("_t")) & (F.col("_chunk") == F.col("_c"))).drop("_t", "_c")
    inside = Window.partitionBy("token", "_chunk").orderBy("bt", "seq")
    previous = F.coalesce(F.lag("bt").over(inside), F.col("_before"))
    x = x.withColumn("_start", F.when(previous.isNull() | (F.col("bt") - previous > gap), 1).otherwise(0))
    starts = x.groupBy("token", "_chunk").agg(F.sum("_start").alias("_n"))
    starts = starts.select(F.col("token").alias("_t"), F.col("_chunk").alias("_c"), F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_earlier"))
    x = x.join(starts.hint("merge"), (F.col("token") == F.col("_t")) & (F.col("_chunk") == F.col("_c")))
    number = F.col("_earlier") + F.sum("_start").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("episode", number).drop("_chunk", "_before", "_start", "_t", "_c", "_earlier")
