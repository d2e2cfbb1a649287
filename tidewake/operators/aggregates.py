"""Aggregate operators over trades (wallet, token, bt, flow_direction in/out, lamports, dex, signature).

Money is summed in whole lamports. Each of the reference's percentile rules has a function of its own. Empty groups are
emitted where a report lists all its buckets; otherwise an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.operators.windows import best
from tidewake.sources.files import read_ordered, write_ordered
from tidewake.sources.shared import kept, new_path

SOL = 1e9


def is_in() -> Column:
    return F.col("flow_direction") == "in"


def is_out() -> Column:
    return F.col("flow_direction") == "out"


def nearest_rank(value: str, p: float) -> Column:
    """The ceil(p * n)-th smallest value, as an aggregate."""
    return F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})")


def linear(value: str, p: float) -> Column:
    """Linear interpolation between closest ranks, as an aggregate."""
    return F.percentile(value, F.lit(p))


def token_pnl(trades: DataFrame) -> DataFrame:
    """AGG-1: spent, received, net, holding time and counts of each wallet in each token it bought."""
    x = trades.groupBy("wallet", "token").agg(
        F.sum(F.when(is_in(), F.col("lamports")).otherwise(0)).alias("spent"), F.sum(F.when(is_out(), F.col("lamports")).otherwise(0)).alias("received"),
        (F.max("bt") - F.min("bt")).alias("hold"), F.count_if(is_in()).alias("n_buys"), F.count_if(is_out()).alias("n_sells"),
    )
    return x.where("n_buys > 0").withColumn("net", F.col("received") - F.col("spent"))


def profit_factor(net: str = "net", no_loss: float | None = 0.0) -> Column:
    """Gains by losses; no_loss where nothing was lost (0, null or infinity, as the report wants)."""
    gain, loss = F.sum(F.greatest(F.col(net), F.lit(0))), -F.sum(F.least(F.col(net), F.lit(0)))
    return F.when(loss > 0, gain / loss).otherwise(F.lit(no_loss).cast("double"))


def wallet_summary(pnl: DataFrame) -> DataFrame:
    """AGG-2: a wallet's trades: counts, win rate, mean, median, population deviation, extremes, partial exits, top-5 share of profits."""
    w = Window.partitionBy("wallet").orderBy(F.desc("net"), "token")
    x = pnl.withColumn("_n", F.row_number().over(w)).withColumn("_sol", F.col("net") / SOL)
    gain = F.sum(F.when(F.col("net") > 0, F.col("net")).otherwise(0))
    top = F.sum(F.when((F.col("net") > 0) & (F.col("_n") <= 5), F.col("net")).otherwise(0))
    return x.groupBy("wallet").agg(
        F.count("*").alias("n_tokens"), (F.count_if(F.col("net") > 0) / F.count("*")).alias("win_rate"), (F.sum("net") / SOL).alias("total_net"), F.round(F.sum("net") / F.count("*") / SOL, 6).alias("mean_net"),
        F.round(F.median("_sol"), 6).alias("median_net"), F.round(F.stddev_pop("_sol"), 4).alias("std_net"), F.max("_sol").alias("best"), F.min("_sol").alias("worst"), F.median("hold").alias("median_hold"),
        (F.count_if(F.col("n_sells") > 1) / F.count("*")).alias("partial_exit_rate"), F.when(gain > 0, top / gain).otherwise(0.0).alias("top5_share"), F.round(profit_factor(), 6).alias("profit_factor"),
    )


#: Bins of a group's range in at_index().
BINS = 1024
#: Bins of a doubling in gini().
OCTAVE = 64


def at_index(rows: DataFrame, keys: tuple[str, ...], value: str, index) -> DataFrame:
    """keys and _at: the value at index(n), from 0, of the n numbers of each group in order. Nulls are left out.

    Values are counted first, so no list of them is gathered. A group's range is cut into BINS; their counts tell in which of
    them the value lies, and only the values of that one are put in order.
    """
    x = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    number = F.col(value).cast("double")
    x = _beside(x, x.groupBy(*keys).agg(F.min(number).alias("_lo"), F.max(number).alias("_hi"), F.sum("_c").alias("_n")), keys)
    # the bin never falls as the value grows; where it can't be told (NaN, infinity) it is the last one
    share = F.when(F.col("_hi") > F.col("_lo"), (number - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * BINS).otherwise(F.lit(0.0))
    x = x.withColumn("_bin", F.when(F.isnan(share), BINS).otherwise(F.floor(share).cast("int")))
    bins = x.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_b"), F.max("_n").alias("_n"))
    before = F.sum("_b").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_b")
    bins = bins.withColumn("_before", before).withColumn("_index", F.least(index(F.col("_n")), F.col("_n") - 1))
    bins = bins.where((F.col("_before") <= F.col("_index")) & (F.col("_index") < F.col("_before") + F.col("_b")))
    x = _beside(x.drop("_n"), bins.select(*keys, F.col("_bin").alias("_wanted"), "_before", "_index"), keys).where(F.col("_bin") == F.col("_wanted"))
    upto = F.col("_before") + F.sum("_c").over(Window.partitionBy(*keys).orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("_upto", upto).where(F.col("_upto") > F.col("_index")).groupBy(*keys).agg(F.min(value).alias("_at"))


def _beside(x: DataFrame, y: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """x with the other columns of y for the same keys, null keys included."""
    y = y.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[c for c in y.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    return x.join(y.hint("merge"), on, "left").drop(*[f"_k{i}" for i in range(len(keys))])


def delta_summary(deltas: DataFrame, keys: tuple[str, ...], value: str = "delta") -> DataFrame:
    """AGG-3: median, mean, p90 by index, extremes and shares within 10 to 300 seconds (four decimals)."""
    share = lambda s: F.round(F.count_if(F.col(value) <= s) / F.count("*"), 4).alias(f"within_{s}")
    x = deltas.groupBy(*keys).agg(F.count("*").alias("n"), F.median(value).alias("median"), F.round(F.sum(value) / F.count("*"), 3).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), *[share(s) for s in (10, 30, 60, 120, 300)])
    return _beside(x, at_index(deltas, keys, value, lambda n: F.floor(n * 0.9)).withColumnRenamed("_at", "p90"), keys)


def linear_summary(deltas: DataFrame, keys: tuple[str, ...], value: str = "delta", listed: int = 10) -> DataFrame:
    """AGG-4: linear p10 to p90, shares, negatives and the first negative tokens by name."""
    x = deltas.groupBy(*keys).agg(
        F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("missing"), *[F.round(linear(value, p / 100), 4).alias(f"p{p}") for p in (10, 25, 50, 75, 90)],
        *[F.round(F.count_if(F.col(value) <= s) / F.count(value), 6).alias(f"within_{s}") for s in (10, 30, 60, 120)], F.count_if(F.col(value) < 0).alias("negatives"),
    )
    below = deltas.where(F.col(value) < 0).select(*keys, "token").distinct()
    below = below.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy("token"))).where(F.col("_n") <= listed)
    first = below.groupBy(*keys).agg(F.array_join(F.array_sort(F.collect_list("token")), ",").alias("first_negative"))
    return _beside(x, first, keys).withColumn("first_negative", F.coalesce("first_negative", F.lit("")))


def share_summary(shares: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """AGG-5: median, p90 by index and largest share of liquidity, and how many exceed 1, 3 and 5 %."""
    above = lambda p: (F.count_if(F.col("share") > p / 100) / F.count("*")).alias(f"above_{p}pct")
    p90 = at_index(shares, keys, "share", lambda n: F.floor(n * 0.9)).select(*keys, F.round("_at", 6).alias("p90"))
    x = shares.groupBy(*keys).agg(F.count("*").alias("n"), F.round(F.median("share"), 6).alias("median"), F.round(F.max("share"), 6).alias("most"), *[above(p) for p in (1, 3, 5)])
    return _beside(x, p90, keys)


def listed(df: DataFrame, column: str, values: tuple[str, ...]) -> DataFrame:
    """The given values as a one-column table."""
    spark = df.sparkSession
    return spark.createDataFrame([(v,) for v in values], f"{column} string")


def bucket_summary(rows: DataFrame, buckets: tuple[str, ...] = ("FAST", "MID", "SLOW")) -> DataFrame:
    """AGG-6: per entry bucket, all emitted: count, win rate, medians, profit factor (null without losses), share of locked pools, most frequent dex."""
    x = rows.groupBy("bucket").agg(
        F.count("*").alias("n"), F.round(F.count_if(F.col("net") > 0) / F.count("*"), 6).alias("win_rate"), F.round(F.median(F.col("net") / SOL), 6).alias("median_net"), F.median("delta").alias("median_delta"),
        F.round(profit_factor(no_loss=None), 6).alias("profit_factor"), F.round(F.count_if(F.col("locked") == 1) / F.count("*"), 6).alias("locked_share"),
    )
    x = x.join(mode(rows, ["bucket"], "dex").withColumnRenamed("dex", "top_dex").hint("merge"), "bucket")
    out = listed(rows, "bucket", buckets).join(x.hint("merge"), "bucket", "left")
    return out.withColumn("n", F.coalesce("n", F.lit(0))).withColumn("top_dex_share", F.round(F.col("_count") / F.col("n"), 6)).drop("_count")


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """AGG-8: the most frequent value of each group, of ties the first by name, with its _count."""
    x = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    best = x.groupBy(*keys).agg(F.min(F.struct((-F.col("_c")).alias("c"), F.col(value).alias("v"))).alias("_b"))
    return best.select(*keys, F.col("_b.v").alias(value), (-F.col("_b.c")).alias("_count"))


def breakdown(rows: DataFrame, key: str = "bucket", value: str = "dex") -> DataFrame:
    """AGG-7: rows by value within each key, with their share of all rows of the key."""
    x = rows.groupBy(key, value).agg(F.count("*").alias("n"))
    return x.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(key)), 6))


def reconstruct(trades: DataFrame) -> DataFrame:
    """AGG-9: one trade per wallet and token: first buy, last sell, cost, proceeds, return (null at no cost), OPEN or CLOSED, sells before any buy."""
    x = trades.groupBy("wallet", "token").agg(
        F.min(F.when(is_in(), F.col("bt"))).alias("entry"), F.max(F.when(is_out(), F.col("bt"))).alias("exit"), F.sum(F.when(is_in(), F.col("lamports")).otherwise(0)).alias("cost"), F.sum(F.when(is_out(), F.col("lamports")).otherwise(0)).alias("proceeds"),
        F.count_if(is_in()).alias("n_buys"), F.count_if(is_out()).alias("n_sells"), F.min(F.when(is_out(), F.col("bt"))).alias("_first_sell"),
    )
    early = F.col("_first_sell").isNotNull() & (F.col("entry").isNull() | (F.col("_first_sell") < F.col("entry")))
    roi = F.when(F.col("cost") > 0, (F.col("proceeds") - F.col("cost")) / F.col("cost"))
    return x.withColumn("roi", roi).withColumn("status", F.when(F.col("n_sells") > 0, "CLOSED").otherwise("OPEN")).withColumn("sell_before_buy", early).drop("_first_sell")


def linear_percentiles(rows: DataFrame, wanted: dict[str, tuple[float, ...]]) -> DataFrame:
    """One row with a column name_p (p in percent) for each column of rows and share: linear interpolation between closest ranks, null without values.

    The values of all columns are put in order in range partitions with their numbers, so no task and no map holds all of them.
    """
    spark = rows.sparkSession
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("_m"), F.col(c).cast("double").alias("_v")) for c in wanted])).alias("_x")).select("_x.*").where("_v IS NOT NULL")
    path = new_path(spark, "percentiles")
    write_ordered(long, [F.asc("_m"), F.asc("_v")], path)
    x = read_ordered(spark, path)
    # a row for each column, and one or two for each percentile
    n = x.groupBy("_m").agg(F.count("*").alias("_n"), F.min("row_no").alias("_first"))
    shares = spark.createDataFrame([(c, p, float(p) / 100) for c, ps in wanted.items() for p in ps], "_m string, _p int, _share double")
    at = n.join(F.broadcast(shares), "_m").withColumn("_pos", (F.col("_n") - 1) * F.col("_share"))
    at = at.select(F.col("_m").alias("_of"), "_p", "_pos", F.explode(F.array_distinct(F.array(F.floor("_pos"), F.ceil("_pos")))).alias("_at"), "_first").withColumn("_wanted", F.col("_first") + F.col("_at"))
    found = x.join(F.broadcast(at), F.col("row_no") == F.col("_wanted")).groupBy("_of", "_p").agg(F.min(F.struct("_at", "_v")).alias("lo"), F.max(F.struct("_at", "_v")).alias("hi"), F.max("_pos").alias("_pos"))
    between = (F.col("hi._at") - F.col("_pos")) * F.col("lo._v") + (F.col("_pos") - F.col("lo._at")) * F.col("hi._v")
    found = found.withColumn("_value", F.when(F.col("lo._v") == F.col("hi._v"), F.col("lo._v")).otherwise(between))
    return found.groupBy().agg(*[F.max(F.when((F.col("_of") == c) & (F.col("_p") == p), F.col("_value"))).alias(f"{c}_{p}") for c, ps in wanted.items() for p in ps])


#: Percentiles of a distribution, and those of holding times and entries.
TAILS, SPREAD = (1, 5, 10, 25, 50, 75, 90, 95, 99), (10, 25, 50, 75, 90, 95, 99)


def distribution(closed: DataFrame) -> DataFrame:
    """AGG-10: report over closed trades (net, roi, hold, cost): win rate, profit factor (infinite without losses, null without either), mean and median of wins and losses, expectancy, linear percentiles.

    A trade without a gain or loss is neither a win nor a loss.
    """
    win, loss = F.when(F.col("net") > 0, F.col("net")), F.when(F.col("net") < 0, F.col("net"))
    factor = F.when(F.count(loss) > 0, F.sum(win) / -F.sum(loss)).when(F.count(win) > 0, F.lit(float("inf")))
    factor = F.when((F.count(loss) > 0) & (F.count(win) == 0), F.lit(0.0)).otherwise(factor)
    closed = kept(closed.select("net", "roi", "hold", "cost"), "closed")
    ranked = closed.select("*", (win / SOL).alias("win"), (loss / SOL).alias("loss"))
    at_p = linear_percentiles(ranked, {"roi": TAILS, "net": TAILS, "hold": SPREAD, "cost": SPREAD, "win": (50,), "loss": (50,)})
    at = lambda c, ps, scale, digits: [F.round(F.col(f"{c}_{p}") / scale, digits).alias(f"{'entry' if c == 'cost' else c}_p{p}") for p in ps]
    x = closed.groupBy().agg(
        F.count("*").alias("n"), F.count(win).alias("n_wins"), F.count(loss).alias("n_losses"), F.round(F.count(win) / F.count("*"), 6).alias("win_rate"), F.round(F.avg(win) / SOL, 4).alias("mean_win"),
        F.round(F.avg(loss) / SOL, 4).alias("mean_loss"), F.round(F.sum("net") / F.count("*") / SOL, 4).alias("expectancy"), F.round(factor, 6).alias("profit_factor"),
    )
    # a row each
    x = x.crossJoin(F.broadcast(at_p))
    return x.select(
        "n", "n_wins", "n_losses", "win_rate", "mean_win", "mean_loss", F.round("win_50", 6).alias("median_win"), F.round("loss_50", 6).alias("median_loss"), "expectancy", "profit_factor",
        *at("roi", TAILS, 1, 6), *at("net", TAILS, SOL, 7), *at("hold", SPREAD, 1, 2), *at("cost", SPREAD, SOL, 7),
    )


def exits_by_hour(closed: DataFrame) -> DataFrame:
    """AGG-10: number of exits in each of the 24 hours of the day (UTC), 0 included."""
    x = closed.where("exit IS NOT NULL").groupBy((F.floor(F.col("exit") / 3600) % 24).alias("hour")).agg(F.count("*").alias("n"))
    return closed.sparkSession.range(24).toDF("hour").join(x.hint("merge"), "hour", "left").fillna(0, ["n"])


def wallet_activity(trades: DataFrame) -> DataFrame:
    """AGG-11: first and last time and number of tokens entered of each wallet."""
    return trades.groupBy("wallet").agg(F.min("bt").alias("first_bt"), F.max("bt").alias("last_bt"), F.countDistinct(F.when(is_in(), F.col("token"))).alias("n_tokens"), F.count("*").alias("n_flows"))


def panel_statistics(rows: DataFrame, panels: tuple[str, ...] = ("New Pairs", "Final Stretch", "Migrated", "Unknown")) -> DataFrame:
    """AGG-14: per panel, all emitted: positions, win rate, linear quartiles of the return."""
    x = rows.groupBy("panel").agg(F.count("*").alias("n"), F.round(F.count_if(F.col("net") > 0) / F.count("*"), 6).alias("win_rate"), *[F.round(linear("roi", p / 100), 6).alias(f"roi_p{p}") for p in (25, 50, 75)])
    return listed(rows, "panel", panels).join(x.hint("merge"), "panel", "left").fillna(0, ["n"])


def session_report(rows: DataFrame) -> DataFrame:
    """AGG-15: one row over a recording: totals, errors, rate per minute, class counts, size percentiles, capital."""
    minutes = F.greatest((F.max("bt") - F.min("bt")) / 60.0, F.lit(1.0))
    buys = F.when(F.col("direction") == "buy", F.col("lamports"))
    return rows.groupBy().agg(F.count("*").alias("n"), F.round(F.count("*") / minutes, 6).alias("per_minute"), F.count(buys).alias("n_buys"), (F.count("*") - F.count(buys)).alias("n_sells"), (F.sum(buys) / SOL).alias("bought"), F.round(F.median(buys / SOL), 6).alias("median_buy"), F.round(F.percentile(buys / SOL, F.lit(0.9)), 6).alias("p90_buy"))


def fee_report(tx: DataFrame) -> DataFrame:
    """AGG-15: one row over recorded transactions (fee, err, side, unit_limit, unit_price): errors, fees and their median and p90, rows of each class, and share with a compute budget."""
    failed, sides = F.coalesce(F.col("err") != "", F.lit(False)), ("BUY", "SELL", "OTHER")
    budget = F.col("unit_limit").isNotNull() | F.col("unit_price").isNotNull()
    return tx.groupBy().agg(
        F.count("*").alias("n"), F.count_if(failed).alias("n_errors"), F.round(F.count_if(failed) / F.count("*"), 6).alias("error_rate"), F.sum("fee").alias("fees"), F.median("fee").alias("median_fee"), F.percentile("fee", F.lit(0.9)).alias("p90_fee"),
        *[F.count_if(F.col("side") == s).alias(f"n_{s.lower()}") for s in sides], F.round(F.count_if(budget) / F.count("*"), 6).alias("budget_share"), F.median("unit_limit").alias("median_limit"), F.median("unit_price").alias("median_price"),
    )


def price_histogram(tx: DataFrame, price: str = "unit_price") -> DataFrame:
    """AGG-27: rows by compute-unit price; those without one count as null."""
    return tx.groupBy(F.col(price).alias("price")).agg(F.count("*").alias("n"))


def size_buckets(buys: DataFrame, k: int = 5) -> DataFrame:
    """AGG-16: the k most frequent sizes (SOL to three decimals) of each wallet's buys, ties by size."""
    x = buys.groupBy("wallet", F.round(F.col("lamports") / SOL + 1e-12, 3).alias("size")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("wallet").orderBy(F.desc("n"), "size")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def size_consistency(buys: DataFrame, within: float = 0.01) -> DataFrame:
    """AGG-16: share of a wallet's buys within one percent of its most frequent size."""
    top = size_buckets(buys, 1).select("wallet", F.col("size").alias("top"))
    near = F.abs(F.col("lamports") / SOL - F.col("top")) <= F.col("top") * within
    return buys.join(top.hint("merge"), "wallet").groupBy("wallet", "top").agg(F.round(F.count_if(near) / F.count("*"), 6).alias("share"))


def pool_summary(flows: DataFrame) -> DataFrame:
    """AGG-17: per token: flows, wallets, buys and sells with volumes, time span."""
    buy, sell = F.col("direction") == "buy", F.col("direction") == "sell"
    return flows.groupBy("token").agg(F.count("*").alias("n"), F.countDistinct("wallet").alias("n_wallets"), F.count_if(buy).alias("n_buys"), F.count_if(sell).alias("n_sells"), (F.sum(F.when(buy, F.col("lamports")).otherwise(0)) / SOL).alias("bought"), (F.sum(F.when(sell, F.col("lamports")).otherwise(0)) / SOL).alias("sold"), (F.max("bt") - F.min("bt")).alias("span"))


def feature_effects(rows: DataFrame, booleans: tuple[str, ...], numbers: tuple[str, ...], k: int = 15) -> DataFrame:
    """AGG-18: effect of features on the boolean win: odds ratio with half counts added, or difference of medians by the sample deviation; the k largest by size."""
    one = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.lit(f in booleans).alias("is_boolean"), F.col(f).cast("double").alias("x")) for f in (*booleans, *numbers)]))
    x = rows.select("win", one.alias("f")).select("win", "f.*").where("x IS NOT NULL")
    n = lambda win, value: F.count_if((F.col("win") == win) & (F.col("x") == value)) + 0.5
    odds = (n(True, 1) * n(False, 0)) / (n(True, 0) * n(False, 1))
    spread = F.stddev_samp("x")
    effect = (F.median(F.when(F.col("win"), F.col("x"))) - F.median(F.when(~F.col("win"), F.col("x")))) / spread
    y = x.groupBy("feature", "is_boolean").agg(F.count("*").alias("coverage"), odds.alias("_odds"), F.when(spread > 0, effect).otherwise(0.0).alias("_effect"))
    y = y.select("feature", "is_boolean", "coverage", F.round(F.when(F.col("is_boolean"), F.col("_odds")).otherwise(F.col("_effect")), 6).alias("effect"))
    return y.orderBy(F.desc(F.abs("effect")), "feature").limit(k)


def gini(balances: DataFrame, keys: tuple[str, ...], value: str = "balance") -> DataFrame:
    """AGG-21: Gini coefficient of positive balances in each group, from ranks.

    Equal balances are counted first. Ranks start from totals of bins of OCTAVE parts of a doubling, so the balances of a
    group are put in order bin by bin.
    """
    x = balances.where(F.col(value) > 0).groupBy(*keys, value).agg(F.count("*").alias("_c"))
    x = x.withColumn("_bin", F.floor(F.log2(F.col(value)) * OCTAVE))
    bins = x.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_b"))
    upto = F.sum("_b").over(Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    x = _beside(x, bins.select(*keys, "_bin", (upto - F.col("_b")).alias("_below")), (*keys, "_bin"))
    inside = Window.partitionBy(*keys, "_bin").orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    first = F.col("_below") + F.sum("_c").over(inside) - F.col("_c")
    # the ranks of equal balances add up to c * first + c * (c + 1) / 2
    x = x.withColumn("_ranks", F.col("_c") * first + F.expr("_c * (_c + 1) div 2"))
    n, total = F.sum("_c"), F.sum(F.col("_c") * F.col(value))
    return x.groupBy(*keys).agg(n.alias("n"), F.round((2 * F.sum(F.col("_ranks") * F.col(value)) / (n * total) - (n + 1) / n), 6).alias("gini"))


def busiest_share(counts: DataFrame, k: int = 10) -> DataFrame:
    """Share of a token's events that its k busiest wallets have; counts: token, wallet, c."""
    top = best(counts, ["token"], "c", k).groupBy("token").agg(F.sum("c").alias("_top"))
    x = _beside(counts.groupBy("token").agg(F.sum("c").alias("_all")), top, ("token",))
    return x.select("token", (F.col("_top") / F.col("_all")).alias("density"))


def mean_absolute_deviation(rows: DataFrame, keys: tuple[str, ...], value: str) -> DataFrame:
    """AGG-22: mean distance to the group's mean, in two passes."""
    mean = rows.groupBy(*keys).agg((F.sum(value) / F.count(value)).alias("_mean"))
    x = rows.join(mean.hint("merge"), list(keys))
    return x.groupBy(*keys).agg(F.avg(F.abs(F.col(value) - F.col("_mean"))).alias("mad"))


def thin_threshold(rows: DataFrame, keys: tuple[str, ...], value: str, p: float = 0.2) -> DataFrame:
    """AGG-23: the value at index int(p (n - 1)) of each group."""
    return at_index(rows, keys, value, lambda n: F.floor(F.lit(p) * (n - 1))).withColumnRenamed("_at", "threshold")


def token_totals(flows: DataFrame) -> DataFrame:
    """AGG-24: buy and sell volume and counts, net flow and share of sells of each token."""
    buy, sell = F.col("direction") == "buy", F.col("direction") == "sell"
    b, s = F.sum(F.when(buy, F.col("lamports")).otherwise(0)), F.sum(F.when(sell, F.col("lamports")).otherwise(0))
    return flows.groupBy("token").agg((b / SOL).alias("bought"), (s / SOL).alias("sold"), ((b - s) / SOL).alias("net"), F.count_if(buy).alias("n_buys"), F.count_if(sell).alias("n_sells"), (F.count_if(sell) / F.count("*")).alias("sell_ratio"))


def wallet_primitives(flows: DataFrame) -> DataFrame:
    """AGG-25: flows, first and last time of each wallet in each token."""
    return flows.groupBy("token", "wallet").agg(F.count("*").alias("n"), F.min("bt").alias("first_seen"), F.max("bt").alias("last_seen"))


def slot_timing(rows: DataFrame, delta: str = "delta", tipped: str | None = None) -> DataFrame:
    """AGG-27: share of entries at most 2 slots after the first, the median by integer halves, and the share of tipped entries where a boolean column says so.

    Deltas are counted by value first, so the exact percentiles need no list of them.
    """
    x = rows.where(F.col(delta).isNotNull())
    low, high = (F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {delta}{way})") for way in ("", " DESC"))
    tip = [F.round(F.count_if(F.col(tipped)) / F.count("*"), 6).alias("tipped_share")] if tipped else []
    y = x.groupBy().agg(F.count("*").alias("n"), F.round(F.count_if(F.col(delta) <= 2) / F.count("*"), 6).alias("within_2"), low.alias("_low"), high.alias("_high"), *tip)
    return y.select("n", "within_2", F.floor((F.col("_low") + F.col("_high")) / 2).cast("long").alias("median"), *([] if not tipped else ["tipped_share"]))


def delta_histogram(rows: DataFrame, delta: str = "delta", bounds: tuple[int, ...] = (0, 1, 2, 5, 10, 50)) -> DataFrame:
    """AGG-27: entries by the smallest bound that their delta does not exceed; beyond the last it is null. All bounds are emitted."""
    bound = F.coalesce(*[F.when(F.col(delta) <= b, F.lit(b)) for b in bounds])
    x = rows.where(F.col(delta).isNotNull()).groupBy(bound.alias("_b")).agg(F.count("*").alias("n"))
    listed_ = rows.sparkSession.createDataFrame([(b,) for b in (*bounds, None)], "up_to int")
    return listed_.join(x.hint("merge"), F.col("up_to").eqNullSafe(F.col("_b")), "left").select("up_to", F.coalesce("n", F.lit(0)).alias("n"))


def silence_summary(curve: DataFrame, share: float = 0.6) -> DataFrame:
    """AGG-28: for each token and gap, the first time at which that share of the wallets seen is silent, and the largest share."""
    quiet = F.col("n_silent") / F.col("n_seen") >= share
    return curve.where("n_seen > 0").groupBy("token", "gap").agg(F.min(F.when(quiet, F.col("at"))).alias("first_quiet"), F.round(F.max(F.col("n_silent") / F.col("n_seen")), 6).alias("most"))


def silence_lead(curve: DataFrame, exhaustion: DataFrame, flows: DataFrame, share: float = 0.6) -> DataFrame:
    """AGG-28: silence_summary() of every token and gap with its exhaustion (token, exhausted_at, may lack tokens): seconds from the first quiet time to it, whether quiet was hit, and the wallets active after it (null without one)."""
    x = silence_summary(curve, share).join(exhaustion.select("token", "exhausted_at").hint("merge"), "token", "left")
    after = flows.join(exhaustion.select("token", "exhausted_at").hint("merge"), "token").where("bt > exhausted_at").groupBy("token").agg(F.countDistinct("wallet").alias("_n"))
    x = x.join(after.hint("merge"), "token", "left")
    active = F.when(F.col("exhausted_at").isNotNull(), F.coalesce("_n", F.lit(0)))
    return x.withColumn("lead_time", F.col("exhausted_at") - F.col("first_quiet")).withColumn("hit", F.col("first_quiet").isNotNull()).withColumn("active_after", active).drop("_n")


def duplicate_signals(signals: DataFrame) -> DataFrame:
    """AGG-29: signals against distinct (wallet, bt) by combination of kinds (array signals)."""
    combo = F.array_join(F.array_sort("signals"), "+")
    return signals.groupBy(combo.alias("combination")).agg(F.count("*").alias("n"), F.countDistinct("wallet", "bt").alias("n_distinct"))


def discovery_features(trades: DataFrame, fast: int = 5, mid: int = 60) -> DataFrame:
    """AGG-30: per wallet and token: first buy and its signature, first sell at or after it, holding time and its bucket, clips (sells from the first buy on), partial exit, and FAST_WIN or FAST_LOSS of the fast bucket."""
    from tidewake.functions.scalar import entry_bucket

    first = Window.partitionBy("wallet", "token")
    x = trades.withColumn("first_buy", F.min(F.when(is_in(), F.col("bt"))).over(first))
    after = is_out() & (F.col("bt") >= F.col("first_buy"))
    y = x.where("first_buy IS NOT NULL").groupBy("wallet", "token", "first_buy").agg(
        F.min(F.when(after, F.col("bt"))).alias("first_sell"), F.count_if(after).alias("clips"), (F.count_if(after) > 1).alias("partial_exit"),
        F.min(F.when(is_in() & (F.col("bt") == F.col("first_buy")), F.col("signature"))).alias("first_signature"), F.sum(F.when(is_out(), F.col("lamports")).otherwise(-F.col("lamports"))).alias("net"),
    )
    y = y.withColumn("hold", F.col("first_sell") - F.col("first_buy"))
    y = y.withColumn("bucket", entry_bucket(F.col("hold"), fast, mid))
    is_fast = F.col("bucket") == "FAST"
    return y.withColumn("label", F.when(is_fast & (F.col("net") > 0), "FAST_WIN").when(is_fast, "FAST_LOSS"))


def flow_diagnostics(flows: DataFrame, threshold: float = 10) -> DataFrame:
    """PRJ-13: one row of counters: smallest, largest and mean flow, share at or over the threshold, repeated signatures, time span."""
    big = F.count_if(F.col("lamports") >= int(threshold * SOL))
    return flows.groupBy().agg(F.count("*").alias("n"), (F.min("lamports") / SOL).alias("least"), (F.max("lamports") / SOL).alias("most"), F.round(F.sum("lamports") / F.count("*") / SOL, 6).alias("mean"), big.alias("n_big"), F.round(big / F.count("*"), 6).alias("big_share"), (F.count("*") - F.countDistinct("signature")).alias("n_repeats"), (F.max("bt") - F.min("bt")).alias("span"))
