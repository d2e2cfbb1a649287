"""Network report: what a list of seed wallets has in common (entry 2 of the reference's life cycle)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators import joins as J
from tidewake.operators import windows as W
from tidewake.operators.pair_blocks import key_figures_in_blocks
from tidewake.sources.shared import kept


def episode_metrics(flows: DataFrame, parts: int | None = None) -> DataFrame:
    """AGG-13 part: flows per episode of each wallet, median and nearest-rank p90. parts as in episodes()."""
    e = W.episodes(flows, parts=parts)
    return e.groupBy("wallet").agg(F.median("n_flows").alias("attempts_median"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY n_flows)").alias("attempts_p90"), F.count("*").alias("n_episodes"))


def pair_metrics(stats: DataFrame, wallets: DataFrame, least_shared: int = 20) -> DataFrame:
    """AGG-13 part: mean lead power, median delay and mean overlap of each wallet over its pairs with enough shared tokens; signs turn where it is the second one."""
    a = stats.where(F.col("shared") >= least_shared)
    one = a.select(F.col("a").alias("wallet"), F.col("lead_rate").alias("power"), F.col("median_delta").alias("delay"), "overlap")
    two = a.select(F.col("b").alias("wallet"), (1 - F.col("lead_rate")).alias("power"), (-F.col("median_delta")).alias("delay"), "overlap")
    x = one.unionAll(two).join(wallets.select("wallet").hint("merge"), "wallet", "left_semi")
    return x.groupBy("wallet").agg(F.count("*").alias("n_pairs"), F.round(F.avg("power"), 6).alias("lead_power"), F.median("delay").alias("lead_delay"), F.round(F.avg("overlap"), 6).alias("overlap_power"))


def dealt(df: DataFrame, parts: int | None, *keys: str) -> DataFrame:
    """df by keys, in so many partitions or, if None, those of the session."""
    return df.repartition(*keys) if parts is None else df.repartition(parts, *keys)


def episode_lengths(trades: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each wallet, token and length of its episodes (n_flows): their number _c, first and last time, and in the row of the shortest ones hold, b and s (time held, buys and sells of the token), else null. Trades are dealt once, by wallet and token."""
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("n_flows")).otherwise(0))
    x = W.episodes(dealt(trades.where("wallet IS NOT NULL").withColumn("direction", F.col("flow_direction")), parts, "wallet", "token"))
    x = x.groupBy("wallet", "token", "n_flows").agg(F.count("*").alias("_c"), side("in").alias("_b"), side("out").alias("_s"), F.min("start_bt").alias("_from"), F.max("end_bt").alias("_to"))
    own = Window.partitionBy("wallet", "token")
    shortest = F.min("n_flows").over(own) == F.col("n_flows")
    once = lambda figure, name: F.when(shortest, figure).alias(name)
    return x.select("wallet", "n_flows", "_c", "_from", "_to", once(F.max("_to").over(own) - F.min("_from").over(own), "hold"), once(F.sum("_b").over(own), "b"), once(F.sum("_s").over(own), "s"))


def seed_metrics(trades: DataFrame, parts: int | None = None) -> DataFrame:
    """AGG-13: per wallet: episode lengths, holding time per token, buys per token, share of sold tokens sold more than once, tokens entered per hour. Rows without a wallet are left out.

    All of it comes from episode_lengths(). parts: how many partitions trades and lengths are dealt to.
    """
    w = Window.partitionBy("wallet")
    x = dealt(episode_lengths(trades, parts), parts, "wallet")
    x = x.withColumn("_upto", F.sum("_c").over(w.orderBy("n_flows").rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(w))
    x = x.groupBy("wallet").agg(
        F.median("hold").alias("median_hold"), F.median(F.when(F.col("b") > 0, F.col("b"))).alias("median_buys"), (F.count_if(F.col("s") >= 2) / F.greatest(F.count_if(F.col("s") > 0), F.lit(1))).alias("partial_exit_rate"), F.count_if(F.col("b") > 0).alias("n_entered"),
        F.percentile("n_flows", F.lit(0.5), F.col("_c")).alias("attempts_median"), F.min(F.when(F.col("_upto") >= F.ceil(F.col("_n") * 0.9), F.col("n_flows"))).cast("double").alias("attempts_p90"), F.greatest(F.max("_to") - F.min("_from"), F.lit(1)).alias("_span"),
    )
    return x.withColumn("per_hour", F.col("n_entered") / (F.col("_span") / 3600.0)).drop("_span")


def seed_archetype() -> Column:
    """FN-17: how a wallet trades."""
    return (
        F.when((F.col("median_buys") <= 1.5) & (F.col("attempts_median") <= 1.5), "sniper").when((F.col("median_buys") >= 6) | (F.col("attempts_p90") >= 8), "ladder_accumulator")
        .when((F.col("median_hold") <= 30) & (F.col("per_hour") >= 20), "recycler").when(F.col("partial_exit_rate") >= 0.5, "hybrid").otherwise("controlled_scaler")
    )


def suspicion() -> Column:
    """FN-17: high if the wallet leads, leads quickly and overlaps with others; medium if two of these hold."""
    met = (F.col("lead_power") >= 0.7).cast("int") + (F.col("lead_delay") <= 10).cast("int") + (F.col("overlap_power") >= 0.4).cast("int")
    return F.when(met == 3, "high").when(met == 2, "medium").otherwise("low")


def replicable() -> Column:
    """FN-17: whether the wallet's lead can be copied."""
    sharp = (F.col("lead_power") >= 0.8) & (F.abs("lead_delay") <= 5)
    return F.when((F.col("suspicion") == "high") & sharp, F.when(F.col("n_shared") >= 2, "no").otherwise("partial")).when(F.col("suspicion") == "high", "partial").otherwise("yes")


def lead_metrics(firsts: DataFrame, wallets: DataFrame, least_shared: int = 20, blocks: bool | None = None) -> DataFrame:
    """pair_metrics() of all pairs of stored first buys. Where nearly all pairs are formed, in blocks, they end there as figures of their wallets; blocks as in sharing_pairs()."""
    if (blocks or not J.prefix_pays(firsts, least_shared)) and (n := J.blocks_for(firsts, "wallet", "token", blocks)):
        x = key_figures_in_blocks(firsts, "wallet", "token", "first_buy", least_shared, n).join(wallets.select("wallet").hint("merge"), "wallet", "left_semi")
        return x.select("wallet", "n_pairs", F.round("power", 6).alias("lead_power"), F.col("delay").alias("lead_delay"), F.round("overlap", 6).alias("overlap_power"))
    stats = J.pair_stats(firsts, least_shared=least_shared, blocks=blocks)
    sizes = firsts.groupBy("wallet").agg(F.count("*").alias("n"))
    na, nb = sizes.select(F.col("wallet").alias("a"), F.col("n").alias("na")), sizes.select(F.col("wallet").alias("b"), F.col("n").alias("nb"))
    stats = stats.join(na.hint("merge"), "a").join(nb.hint("merge"), "b").withColumn("overlap", F.col("shared") / F.least("na", "nb"))
    return pair_metrics(stats, wallets, least_shared)


def network_report(trades: DataFrame, edges: DataFrame, members: DataFrame, seeds: DataFrame, k: int = 20, least_shared: int = 20, parts: int | None = None) -> DataFrame:
    """One row for each seed: trading metrics, degree, shared groups, lead power, delay and overlap over pairs with at least least_shared tokens in common, and labels.

    Pairs are taken among the seeds and the k heaviest neighbours of each. parts as in seed_metrics().
    """
    # read twice: neighbours and degrees
    edges = kept(edges, "edges")
    around = seeds.union(J.neighbours(edges, seeds, k).select(F.col("neighbour").alias("wallet"))).distinct()
    firsts = kept(J.first_buys(trades.join(around.hint("merge"), "wallet", "left_semi")), "pair-firsts")
    own = trades.join(seeds.hint("merge"), "wallet", "left_semi")
    x = seeds.join(seed_metrics(own, parts).hint("merge"), "wallet", "left").join(J.degrees(edges, seeds).hint("merge"), "wallet", "left").join(J.shared_groups(members, seeds).hint("merge"), "wallet", "left")
    x = x.join(lead_metrics(firsts, seeds, least_shared).hint("merge"), "wallet", "left").fillna(0, ["lead_power", "lead_delay", "overlap_power", "n_pairs"])
    x = x.withColumn("archetype", seed_archetype()).withColumn("suspicion", suspicion())
    return x.withColumn("replicable", replicable())
