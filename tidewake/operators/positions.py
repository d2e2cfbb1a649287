"""Positions of a wallet in a token from signed balance changes, in window functions only.

A balance that is reset to 0 whenever it would fall below follows from running sums: S - least(0, running minimum of S).
So positions with over-sells need no row-by-row fold. Changes are whole units.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["wallet", "token"]


def signed(trades: DataFrame) -> DataFrame:
    """Trades with delta (units, + in) and sol (lamports, - in)."""
    buy = F.col("flow_direction") == "in"
    return trades.withColumn("delta", F.when(buy, F.col("units")).otherwise(-F.col("units"))).withColumn("sol", F.when(buy, -F.col("lamports")).otherwise(F.col("lamports")))


def running_balance(changes: DataFrame, order: tuple[str, ...] = ("bt", "seq", "line")) -> DataFrame:
    """WIN-16: each change with the balance before and after it; over_sold where it would have fallen below 0."""
    w = Window.partitionBy(*KEY).orderBy(*order)
    x = changes.withColumn("_s", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    x = x.withColumn("after", F.col("_s") - F.least(F.lit(0), F.min("_s").over(w.rowsBetween(Window.unboundedPreceding, 0))))
    x = x.withColumn("before", F.coalesce(F.lag("after").over(w), F.lit(0)))
    return x.withColumn("over_sold", F.col("before") + F.col("delta") < 0).drop("_s")


def positions(changes: DataFrame, order: tuple[str, ...] = ("bt", "seq", "line")) -> DataFrame:
    """WIN-16, WIN-17: one row for each position, numbered per wallet and token: entry, exit (null while open), counts, gross SOL in and out, largest size, anomaly flag.

    A position opens when the balance leaves 0 and closes when it is back at 0; changes outside one are ignored.
    """
    w = Window.partitionBy(*KEY).orderBy(*order)
    x = running_balance(changes, order)
    opened = (F.col("before") == 0) & (F.col("after") > 0)
    x = x.withColumn("position", F.sum(opened.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))).where((F.col("before") > 0) | opened)
    buy, sell = (F.col("delta") > 0) & (F.col("sol") < 0), (F.col("delta") < 0) & (F.col("sol") > 0)
    shut = (F.col("before") > 0) & (F.col("after") == 0)
    y = x.groupBy(*KEY, "position").agg(
        F.min("bt").alias("entry"), F.max(F.when(shut, F.col("bt"))).alias("exit"), F.count_if(buy).alias("n_buys"), F.count_if(sell).alias("n_sells"), F.sum(F.when(buy, -F.col("sol")).otherwise(0)).alias("sol_out"),
        F.sum(F.when(sell, F.col("sol")).otherwise(0)).alias("sol_in"), F.count("*").alias("n_tx"), F.max("after").alias("max_size"), F.max("over_sold").alias("over_sold"),
    )
    return y.withColumn("net", F.col("sol_in") - F.col("sol_out")).withColumn("hold", F.col("exit") - F.col("entry"))


def book_metrics(book: DataFrame) -> DataFrame:
    """AGG-31: closed and open positions, winners, losers, net, mean return and extremes of the closed ones, per wallet."""
    done = F.col("exit").isNotNull()
    net = F.when(done, F.col("net"))
    return book.groupBy("wallet").agg(
        F.count_if(done).alias("n_closed"), F.count_if(~done).alias("n_open"), F.count_if(net > 0).alias("n_winners"), F.count_if(net <= 0).alias("n_losers"), (F.coalesce(F.sum(net), F.lit(0)) / 1e9).alias("net_sol"),
        F.round(F.sum(net) / F.count(net) / 1e9, 6).alias("mean_net"), (F.max(net) / 1e9).alias("best"), (F.min(net) / 1e9).alias("worst"), F.median("hold").alias("median_hold"),
    )


def allocate(changes: DataFrame) -> DataFrame:
    """FN-18: a transaction's SOL change dealt to its tokens by absolute change. changes: signature, token, delta, sol (of the transaction)."""
    w = Window.partitionBy("signature")
    total = F.sum(F.abs("delta")).over(w)
    return changes.withColumn("share", F.when(total > 0, F.col("sol") * F.abs("delta") / total).otherwise(0.0))


def drawdown(closed: DataFrame) -> DataFrame:
    """WIN-14: a wallet's final and highest running net over exits in time order (token breaks ties) and its largest fall from a high (0 before the first)."""
    w = Window.partitionBy("wallet").orderBy("exit", "token").rowsBetween(Window.unboundedPreceding, 0)
    x = closed.withColumn("_c", F.sum("net").over(w)).withColumn("_peak", F.greatest(F.lit(0), F.max("_c").over(w)))
    return x.groupBy("wallet").agg((F.sum("net") / 1e9).alias("total"), (F.max("_peak") / 1e9).alias("peak"), (F.max(F.col("_peak") - F.col("_c")) / 1e9).alias("max_drawdown"))
