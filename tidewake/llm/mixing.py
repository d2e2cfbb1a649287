"""Mixing sources to target weights with hash-threshold histograms, in DataFrame functions only.

Each document has a hash of its id and text. Token sums by source and hash bucket give, by running sums, the bucket in
which a source's budget ends; only that bucket is refined, by its next hash bits, until the prefix is so long
that it holds about one document. Everything below the threshold is taken: a filter, without a sort. A source
whose target exceeds its size is taken in whole passes, and the threshold gives the rest, so thresholds for
growing budgets are nested.

Defined results: a null text has size 0; a null source is a source of its own, last in order; rows that share an id, or
have none, are told apart by their texts; rows equal in both are taken together; an empty table gives an empty mix; a
source of size 0 has target 0; a column _mix of the input is refused. The order of the sources is found over one row for
each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.llm.common import WHITE, free_name, stored

BITS, LEVELS = 10, 4
#: Up to so many sources their thresholds are broadcast; beyond, they are joined by sort and merge.
BROADCAST_SOURCES = 10_000
WEIGHTS = (5, 2, 1)
CAP = 3


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(f"[^{WHITE}]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, text: Column, seed: str = "mix") -> Column:
    """60 bits of a digest of seed, id and text."""
    parts = F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.md5(F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("long")


def bucket(h: Column, level: int) -> Column:
    return F.shiftright(h, 60 - BITS * level).bitwiseAND((1 << BITS) - 1)


def prefix(h: Column, levels: int = LEVELS) -> Column:
    return F.shiftright(h, 60 - BITS * levels)


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """sizes: (source, source_size), a row for each source. Adds weight and target.

    Targets share 100% of all sizes by weight; none exceeds cap times its source's size, the excess is reshared
    by weight among the others. In order of cap / weight, the sources below the level are capped and the rest get
    level * weight, so the level follows from running sums.
    """
    order = Window.orderBy(F.col("source").isNull(), F.col("source").cast("binary"))
    kinds = F.array(*[F.lit(w) for w in weights])
    x = sizes.withColumn("weight", F.get(kinds, ((F.row_number().over(order) - 1) % len(weights)).cast("int")).cast("long"))
    x = x.withColumn("_cap", F.col("source_size") * cap).withColumn("_all", F.sum("source_size").over(Window.partitionBy()))
    by = Window.orderBy(F.col("_cap") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    x = x.withColumn("_before", F.coalesce(F.sum("_cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    x = x.withColumn("_weights", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    # the first source, in that order, that the level leaves below its cap fixes the level
    free = (F.col("_all") - F.col("_before")) * F.col("weight") <= F.col("_cap") * F.col("_weights")
    first = F.min(F.when(free, F.struct(F.col("_cap") / F.col("weight"), F.col("_before"), F.col("_weights")))).over(Window.partitionBy())
    x = x.withColumn("_first", first)
    level = (F.col("weight") * (F.col("_all") - F.col("_first")["_before"])).cast("double") / F.col("_first")["_weights"]
    return x.select("source", "source_size", "weight", F.coalesce(F.least(F.col("_cap").cast("double"), level), F.lit(0.0)).alias("target"))


def _joined(left: DataFrame, right: DataFrame, n_sources: int, on: Column, how: str = "inner") -> DataFrame:
    return left.join(right.hint("broadcast" if n_sources <= BROADCAST_SOURCES else "merge"), on, how)


def thresholds(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> tuple[DataFrame, int]:
    """sized: a stored table with source, size, h. Returns (source, source_size, target, passes, below) and its number of rows.

    A document is taken passes times, and once more if the first BITS * LEVELS bits of its hash are less than below.
    """
    level1 = stored(sized.groupBy("source", bucket(F.col("h"), 1).alias("b")).agg(F.sum("size").alias("n")), "mix-histogram")
    goals = targets(level1.groupBy("source").agg(F.sum("n").alias("source_size")), weights, cap)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    goals = stored(goals.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size")), "mix-targets")
    n_sources = goals.count()
    at = goals.select(F.col("source").alias("_s"), F.lit(0).cast("long").alias("_p"), F.col("rest").alias("_rest"))
    sums = level1
    for level in range(1, LEVELS + 1):
        if level > 1:
            inside = _joined(sized, at, n_sources, F.col("source").eqNullSafe(F.col("_s")) & (prefix(F.col("h"), level - 1) == F.col("_p")))
            sums = inside.groupBy("source", bucket(F.col("h"), level).alias("b")).agg(F.sum("size").alias("n"))
        before = Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
        running = sums.withColumn("c", F.coalesce(F.sum("n").over(before), F.lit(0)))
        running = _joined(running, at, n_sources, F.col("source").eqNullSafe(F.col("_s")))
        # the last bucket that starts within the budget holds its end
        end = running.where(F.col("c") <= F.col("_rest")).groupBy("source", "_p", "_rest").agg(F.max(F.struct("b", "c", "n")).alias("x"))
        new = (F.col("_p") * (1 << BITS) + F.col("x.b")).alias("_p")
        if level < LEVELS:
            at = stored(end.select(F.col("source").alias("_s"), new, (F.col("_rest") - F.col("x.c")).alias("_rest")), f"mix-boundary-{level}")
        else:
            whole = F.when((F.col("_rest") - F.col("x.c")) * 2 >= F.col("x.n"), 1).otherwise(0)
            at = end.select(F.col("source").alias("_s"), (new + whole).alias("below"))
    out = _joined(goals, at, n_sources, F.col("source").eqNullSafe(F.col("_s")), "left")
    return stored(out.select("source", "source_size", "target", "passes", F.coalesce("below", F.lit(0)).alias("below")), "mix-thresholds"), n_sources


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """docs (doc_id, text, source, others) with a struct column _mix: size, source_size, target, copies, taken."""
    free_name(docs, "_mix")
    h = hash_of(F.col("doc_id"), F.col("text"), seed)
    sized = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), h.alias("h")), "mix-sizes")
    limits, n_sources = thresholds(sized, weights, cap)
    limits = limits.select(F.col("source").alias("_s"), "source_size", "target", "passes", "below")
    cols = [F.col(f"`{c}`") for c in docs.columns]
    x = docs.select(F.struct(*cols).alias("_doc"), F.col("source").alias("_source"), size_of(F.col("text")).alias("_size"), h.alias("_h"))
    return _picked(x, limits, n_sources).select("_doc.*", "_mix")


def mix_table(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP, seed: str = "mix") -> DataFrame:
    """As mix(), but only doc_id and source beside _mix: texts are read once."""
    sized = stored(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), hash_of(F.col("doc_id"), F.col("text"), seed).alias("h")), "mix-sizes")
    limits, n_sources = thresholds(sized, weights, cap)
    limits = limits.select(F.col("source").alias("_s"), "source_size", "target", "passes", "below")
    x = sized.select(F.struct("doc_id", "source").alias("_doc"), F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("h").alias("_h"))
    return _picked(x, limits, n_sources).select("_doc.*", "_mix")


def _picked(x: DataFrame, limits: DataFrame, n_sources: int) -> DataFrame:
    x = _joined(x, limits, n_sources, F.col("_source").eqNullSafe(F.col("_s")))
    copies = (F.col("passes") + F.when(prefix(F.col("_h")) < F.col("below"), 1).otherwise(0)).cast("long")
    return x.select("_doc", F.struct(F.col("_size").alias("size"), "source_size", "target", copies.alias("copies"), (F.col("_size") * copies).alias("taken")).alias("_mix"))
