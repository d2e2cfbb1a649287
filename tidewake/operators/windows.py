"""Window operators over flows (wallet, token, bt, direction, lamports, signature, seq).

Finite look-back windows are evaluated in time chunks: a row is dealt to its own chunk and, as a halo, to later chunks
that look back on it. A token that holds a third of all rows then spreads over as many tasks as it has chunks. Unbounded
running values over a token use two levels: chunk totals first, then rows within their chunk.

Nulls in bt or a key drop out of ranges as in SQL; ties in bt are broken by seq everywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEY = ["token", "wallet"]


def sol(x: Column) -> Column:
    return x / F.lit(1e9)


def halo(df: DataFrame, time: str, back: int, chunk: int | None = None) -> DataFrame:
    """df with _chunk and _own: each row in its chunk of time and, with _own false, in the chunks that look back on it."""
    chunk = chunk or 16 * max(back, 1)
    first = F.floor(F.col(time) / chunk)
    return df.withColumn("_chunk", F.explode(F.sequence(first, F.floor((F.col(time) + back) / chunk)))).withColumn("_own", F.col("_chunk") == first)


def own(df: DataFrame) -> DataFrame:
    return df.where("_own").drop("_chunk", "_own")


def _range(keys: list[str], back: int):
    return Window.partitionBy(*keys, "_chunk").orderBy("bt").rangeBetween(-back, 0)


def rolling_sums(flows: DataFrame, short: int = 300, long: int = 900) -> DataFrame:
    """WIN-1: sums of lamports in [t - short, t] and [t - long, t] per token and wallet, in arrival order within a second."""
    x = halo(flows, "bt", long)
    later = Window.partitionBy(*KEY, "_chunk", "bt").orderBy("seq").rowsBetween(1, Window.unboundedFollowing)
    after = F.coalesce(F.sum("lamports").over(later), F.lit(0))
    x = x.withColumn("_after", after)
    for name, back in (("sum_5m", short), ("sum_15m", long)):
        x = x.withColumn(name, F.greatest(F.sum("lamports").over(_range(KEY, back)) - F.col("_after"), F.lit(0)))
    return own(x).drop("_after")


def running_totals(flows: DataFrame) -> DataFrame:
    """WIN-4: first and last seen, number of flows and buy/sell totals as of each flow of a wallet in a token."""
    w = Window.partitionBy(*KEY).orderBy("bt", "seq").rowsBetween(Window.unboundedPreceding, 0)
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("lamports")).otherwise(0)).over(w)
    return flows.select("*", F.min("bt").over(w).alias("first_seen"), F.max("bt").over(w).alias("last_seen"), F.count("*").over(w).alias("n_flows"), side("buy").alias("bought"), side("sell").alias("sold"))


def whale_crossings(flows: DataFrame, thresholds: tuple[float, float, float] = (10, 25, 50), per_token: DataFrame | None = None, scope: tuple[str, ...] = ()) -> DataFrame:
    """WIN-2, WIN-3: the first flow of a wallet at which each of three sums reaches its threshold (SOL).

    per_token: (token, whale_tx, whale_5m, whale_15m) replaces the thresholds; scope: further columns (an episode) within
    which crossings count anew.
    """
    x = rolling_sums(flows)
    if per_token is not None:
        x = x.join(per_token.select("token", "whale_tx", "whale_5m", "whale_15m").hint("merge"), "token")
        limits = [F.col(c) for c in ("whale_tx", "whale_5m", "whale_15m")]
    else:
        limits = [F.lit(float(t)) for t in thresholds]
    kinds = [("WHALE_TX", "lamports"), ("WHALE_CUM_5M", "sum_5m"), ("WHALE_CUM_15M", "sum_15m")]
    hits = F.array(*[F.struct(F.lit(k).alias("event_type"), sol(F.col(c)).alias("amount_sol"), t.cast("double").alias("threshold")) for (k, c), t in zip(kinds, limits, strict=True)])
    x = x.withColumn("_hit", F.explode(F.filter(hits, lambda h: h["amount_sol"] >= h["threshold"])))
    first = Window.partitionBy(*KEY, *scope, "_hit.event_type").orderBy("bt", "seq")
    x = x.withColumn("_n", F.row_number().over(first)).where("_n = 1")
    return x.select(*KEY, *scope, "bt", "seq", "direction", "_hit.event_type", "_hit.amount_sol", "_hit.threshold")


def direction_history(flows: DataFrame, rows: int = 20, back: int = 120) -> DataFrame:
    """WIN-5: net lamports (buys less sells) of a wallet's last flows that are at most back seconds old, among its last rows."""
    signed = F.when(F.col("direction") == "buy", F.col("lamports")).otherwise(-F.col("lamports"))
    w = Window.partitionBy(*KEY).orderBy("bt", "seq").rowsBetween(-(rows - 1), 0)
    recent = F.collect_list(F.struct(F.col("bt").alias("t"), signed.alias("x"))).over(w)
    net = F.aggregate(F.filter("_recent", lambda r: r["t"] >= F.col("bt") - back), F.lit(0).cast("long"), lambda a, r: a + r["x"])
    return flows.withColumn("_recent", recent).withColumn("net_2m", net).drop("_recent")


def sell_majority(flows: DataFrame, rows: int = 3) -> DataFrame:
    """WIN-6: at least two of a wallet's last rows flows are sells, and they outweigh the buys among them."""
    w = Window.partitionBy(*KEY).orderBy("bt", "seq").rowsBetween(-(rows - 1), 0)
    side = lambda d: F.sum(F.when(F.col("direction") == d, F.col("lamports")).otherwise(0)).over(w)
    sells = F.sum(F.when(F.col("direction") == "sell", 1).otherwise(0)).over(w)
    return flows.select("*", ((sells >= 2) & (side("sell") > side("buy"))).alias("sell_confirmed"))


def distinct_in_range(events: DataFrame, back: int, name: str = "n_wallets", direction: str | None = None) -> DataFrame:
    """WIN-7: distinct wallets of a token's events in [t - back, t], and their density per second."""
    wallet = F.col("wallet") if direction is None else F.when(F.col("direction") == direction, F.col("wallet"))
    x = halo(events, "bt", back).withColumn(name, F.size(F.collect_set(wallet).over(_range(["token"], back))).cast("long"))
    return own(x)




def prior_maximum(df: DataFrame, value: str, chunk: int = 3600) -> DataFrame:
    """WIN-8: the largest value of a token before each row (by bt, seq), null at its first row, in two levels."""
    x = df.withColumn("_chunk", F.floor(F.col("bt") / chunk))
    tops = x.groupBy("token", "_chunk").agg(F.max(value).alias("_top"))
    before = Window.partitionBy("token").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    tops = tops.select(F.col("token").alias("_t"), F.col("_chunk").alias("_c"), F.max("_top").over(before).alias("_earlier"))
    x = x.join(tops.hint("merge"), (F.col("token") == F.col("_t")) & (F.col("_chunk") == F.col("_c")))
    inside = Window.partitionBy("token", "_chunk").orderBy("bt", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return x.withColumn("prior_max", F.greatest("_earlier", F.max(value).over(inside))).drop("_chunk", "_t", "_c", "_earlier")


def coordination(events: DataFrame, back: int = 60, least: int = 3) -> DataFrame:
    """WIN-9: rows at which at least so many distinct wallets of the token acted in [t - back, t]; sorted wallets and the common side."""
    r = _range(["token"], back)
    x = halo(events, "bt", back)
    x = x.withColumn("wallets", F.array_sort(F.collect_set("wallet").over(r))).withColumn("_sides", F.collect_set("direction").over(r))
    x = x.withColumn("side", F.when(F.size("_sides") > 1, "mixed").otherwise(F.element_at("_sides", 1)))
    return own(x).drop("_sides").where(F.size("wallets") >= least)


def persistence(flows: DataFrame, least: int = 2, gap: int = 300, bucket: int = 60, mode: str = "gap") -> DataFrame:
    """WIN-10: wallets active in at least so many distinct minutes of a token.

    mode gap: at most gap seconds between consecutive minutes; span: at most gap seconds from first to last; expiry: minutes
    count for gap seconds only, so two of them at most so far apart are enough.
    """
    minutes = flows.select(*KEY, (F.floor(F.col("bt") / bucket) * bucket).alias("minute")).distinct()
    w = Window.partitionBy(*KEY).orderBy("minute")
    x = minutes.withColumn("_gap", F.col("minute") - F.lag("minute").over(w))
    x = x.groupBy(*KEY).agg(F.count("*").alias("n_minutes"), F.max("_gap").alias("max_gap"), F.min("_gap").alias("min_gap"), (F.max("minute") - F.min("minute")).alias("span"))
    return x.where((F.col("n_minutes") >= least) & (F.col({"gap": "max_gap", "span": "span", "expiry": "min_gap"}[mode]) <= gap)).drop("min_gap")


def episodes(flows: DataFrame, gap: int = 90, keys: tuple[str, ...] = ("wallet", "token", "direction"), parts: int | None = None) -> DataFrame:
    """WIN-11: runs of flows with no pause longer than gap: start, end, length. parts: how many partitions the keys are dealt to; None: as the flows are, or those of the session."""
    flows = flows if parts is None else flows.repartition(parts, *keys)
    w = Window.partitionBy(*keys).orderBy("bt", "seq")
    new = (F.col("bt") - F.lag("bt").over(w) > gap).cast("int")
    x = flows.withColumn("_new", F.coalesce(new, F.lit(1))).withColumn("episode", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return x.groupBy(*keys, "episode").agg(F.min("bt").alias("start_bt"), F.max("bt").alias("end_bt"), F.count("*").alias("n_flows"), F.sum("lamports").alias("lamports"))


def activity_gaps(flows: DataFrame, keys: tuple[str, ...] = ("wallet",)) -> DataFrame:
    """WIN-12: seconds since the previous flow of the same keys."""
    x = with_previous(flows, keys)
    return x.withColumn("gap", F.col("bt") - F.col("_before")).where("gap IS NOT NULL").drop("_before")


def longest_pauses(flows: DataFrame, keys: tuple[str, ...] = ("token",)) -> DataFrame:
    """The longest time between two flows in a row of the same keys; 0 where there is one flow."""
    x = with_previous(flows, keys)
    return x.groupBy(*keys).agg(F.coalesce(F.max(F.col("bt") - F.col("_before")), F.lit(0)).alias("gap"))


def peak_rate(flows: DataFrame, back: int = 10) -> DataFrame:
    """WIN-13: the largest number of flows of a side in back seconds, per token."""
    x = halo(flows, "bt", back).withColumn("_n", F.count("*").over(_range(["token", "direction"], back)))
    return own(x).groupBy("token", "direction").agg(F.max("_n").alias("peak"))


def longest_run(flows: DataFrame, keys: tuple[str, ...] = ("wallet",)) -> DataFrame:
    """WIN-15: the longest run of flows of one side without the other between, per keys and side."""
    all_, side = Window.partitionBy(*keys).orderBy("bt", "seq"), Window.partitionBy(*keys, "direction").orderBy("bt", "seq")
    x = flows.withColumn("_island", F.row_number().over(all_) - F.row_number().over(side))
    return x.groupBy(*keys, "direction", "_island").agg(F.count("*").alias("_n")).groupBy(*keys, "direction").agg(F.max("_n").alias("longest"))


def early_wallets(flows: DataFrame, within: int = 300) -> DataFrame:
    """WIN-18: wallets first seen in a token within so many seconds of its first flow."""
    start = flows.groupBy("token").agg(F.min("bt").alias("t0"))
    first = flows.groupBy(*KEY).agg(F.min("bt").alias("first_seen"))
    x = first.join(start.hint("merge"), "token").withColumn("delta", F.col("first_seen") - F.col("t0"))
    return x.where(F.col("delta").between(0, within))


def silence_curve(flows: DataFrame, gaps: tuple[int, ...] = (60, 120, 180), step: int = 30) -> DataFrame:
    """WIN-19: at every step of a token's span and for each gap G: wallets seen so far, and those silent for more than G.

    A wallet is silent from its flow + G (exclusive) until its next flow, so each pause gives two changes of a counter at
    steps; running sums over changes replace the product of steps and wallets.
    """
    w = Window.partitionBy(*KEY).orderBy("bt", "seq")
    span = flows.groupBy("token").agg(F.min("bt").alias("t0"), F.max("bt").alias("t1"))
    x = flows.select(*KEY, "bt", F.lead("bt").over(w).alias("_next"), F.row_number().over(w).alias("_n")).join(span.hint("merge"), "token")
    at = lambda t: F.ceil((t - F.col("t0")) / step).cast("long")  # noqa: E731  the first step at or after t
    steps = lambda k, g, seen, silent: F.struct(k.alias("k"), F.lit(g).alias("g"), F.lit(seen).alias("seen"), F.lit(silent).alias("silent"))
    changes = []
    for g in gaps:
        changes.append(F.when(F.col("_n") == 1, steps(at(F.col("bt")), g, 1, 0)))
        quiet = at(F.col("bt") + g + 1)
        changes.append(F.when(F.col("_next").isNull() | (quiet < at(F.col("_next"))), steps(quiet, g, 0, 1)))
        changes.append(F.when(F.col("_next").isNotNull() & (quiet < at(F.col("_next"))), steps(at(F.col("_next")), g, 0, -1)))
    x = x.select("token", F.explode(F.array_compact(F.array(*changes))).alias("c")).select("token", "c.*").groupBy("token", "g", "k").agg(F.sum("seen").alias("seen"), F.sum("silent").alias("silent"))
    grid = span.select("token", "t0", F.explode(F.sequence(F.lit(0), F.floor((F.col("t1") - F.col("t0")) / step))).alias("k")).withColumn("g", F.explode(F.array(*[F.lit(g) for g in gaps])))
    run = Window.partitionBy("token", "g").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    y = grid.join(x.hint("merge"), ["token", "g", "k"], "left").fillna(0, ["seen", "silent"])
    return y.select("token", F.col("g").alias("gap"), (F.col("t0") + F.col("k") * step).alias("at"), F.sum("seen").over(run).alias("n_seen"), F.sum("silent").over(run).alias("n_silent"))


def _running_in_chunks(rows: DataFrame, chunk: int, sums: dict[str, str]) -> DataFrame:
    """rows (token, bt) with the sum of each column over all rows of the token up to bt: within chunks of time, on totals of the chunks before."""
    x = rows.withColumn("_chunk", F.floor(F.col("bt") / chunk))
    totals = x.groupBy("token", "_chunk").agg(*[F.sum(c).alias(f"_n_{c}") for c in sums])
    before = Window.partitionBy("token").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(F.col("token").alias("_t"), F.col("_chunk").alias("_c"), *[F.coalesce(F.sum(f"_n_{c}").over(before), F.lit(0)).alias(f"_earlier_{c}") for c in sums])
    x = x.join(totals.hint("merge"), (F.col("token") == F.col("_t")) & (F.col("_chunk") == F.col("_c")))
    inside = Window.partitionBy("token", "_chunk").orderBy("bt").rangeBetween(Window.unboundedPreceding, 0)
    x = x.select("*", *[(F.col(f"_earlier_{c}") + F.sum(c).over(inside)).alias(name) for c, name in sums.items()])
    return x.drop("_chunk", "_t", "_c", *[f"_earlier_{c}" for c in sums])


def with_previous(flows: DataFrame, keys: tuple[str, ...] = ("token",), chunk: int = 86_400) -> DataFrame:
    """flows with _before: the time of the flow before with the same keys (by bt, seq), from the chunk of time or the last one before it; null at the first."""
    x = flows.withColumn("_chunk", F.floor(F.col("bt") / chunk))
    last = x.groupBy(*keys, "_chunk").agg(F.max("bt").alias("_last"))
    earlier = Window.partitionBy(*keys).orderBy("_chunk")
    last = last.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_chunk").alias("_c"), F.lag("_last").over(earlier).alias("_last"))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    x = x.join(last.hint("merge"), [*on, F.col("_chunk") == F.col("_c")])
    within = Window.partitionBy(*keys, "_chunk").orderBy("bt", "seq")
    return x.withColumn("_before", F.coalesce(F.lag("bt").over(within), "_last")).drop("_chunk", "_c", "_last", *[f"_k{i}" for i in range(len(keys))])


def silence_carried(flows: DataFrame, back: int = 120) -> DataFrame:
    """flows with carried: a sell by a wallet that is silent, which leaves it silent.

    A wallet turns silent once its token is active more than back seconds after its last flow; a buy ends that.
    """
    own = Window.partitionBy(*KEY).orderBy("bt", "seq")
    x = with_previous(flows, ("token",), 16 * back)
    turned = (F.col("direction") == "sell") & F.coalesce(F.col("_before") > F.lag("bt").over(own) + back, F.lit(False))
    x = x.withColumn("_turned", turned).withColumn("_island", F.count_if(F.col("direction") == "buy").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    island = Window.partitionBy(*KEY, "_island").orderBy("bt", "seq").rowsBetween(Window.unboundedPreceding, 0)
    return x.withColumn("carried", (F.col("direction") == "sell") & F.max("_turned").over(island)).drop("_before", "_turned", "_island")


def cohort_silence(flows: DataFrame, back: int = 120) -> DataFrame:
    """WIN-20, counting form: at each flow, wallets of the token seen so far, those active in [t - back, t], and the silent ones.

    Silent are wallets that are not active, and active ones that a sell left silent (silence_carried). The latter count from
    their sell to their next flow, or until they are not active any more.
    """
    first = Window.partitionBy(*KEY).orderBy("bt", "seq")
    x = flows.withColumn("_first", (F.row_number().over(first) == 1).cast("long"))
    marked = silence_carried(flows, back).withColumn("_next", F.lead("bt").over(first))
    end = F.least(F.coalesce(F.col("_next"), F.col("bt") + back + 1), F.col("bt") + back + 1)
    spans = marked.where("carried").select("token", F.col("bt").alias("_a"), end.alias("_b")).where("_b > _a")
    spans = spans.select("token", F.explode(F.array(F.struct(F.col("_a").alias("bt"), F.lit(1).cast("long").alias("_held")), F.struct(F.col("_b").alias("bt"), F.lit(-1).cast("long").alias("_held")))).alias("x")).select("token", "x.*")
    y = distinct_in_range(x, back, "n_recent").withColumn("_held", F.lit(0).cast("long")).withColumn("_own", F.lit(True))
    y = y.unionByName(spans.withColumn("_own", F.lit(False)).withColumn("_first", F.lit(0).cast("long")), allowMissingColumns=True)
    y = _running_in_chunks(y, 16 * back, {"_first": "n_seen", "_held": "_n_held"}).where("_own")
    return y.withColumn("n_silent", F.col("n_seen") - F.col("n_recent") + F.col("_n_held")).drop("_first", "_held", "_n_held", "_own")


def stopped_before(flows: DataFrame, transitions: DataFrame, back: int = 120) -> DataFrame:
    """WIN-21: wallets whose last flow up to a transition (token, at) is more than back seconds before it."""
    x = flows.join(transitions.select("token", "at").hint("merge"), "token").where("bt <= at")
    return x.groupBy("token", "at", "wallet").agg(F.max("bt").alias("last_seen")).where(F.col("last_seen") < F.col("at") - back)


def activity_drop(flows: DataFrame, recent: int = 180, history: int = 300, least: int = 5, drop: float = 0.85) -> DataFrame:
    """WIN-22: at each flow the wallet's rate over its life and over the last recent seconds, and why a drop was (not) found."""
    life = Window.partitionBy(*KEY).orderBy("bt", "seq").rowsBetween(Window.unboundedPreceding, 0)
    x = flows.withColumn("_n", F.count("*").over(life)).withColumn("_age", F.col("bt") - F.min("bt").over(life))
    y = halo(x, "bt", recent).withColumn("_recent", F.count("*").over(_range(KEY, recent)))
    y = own(y)
    rate, now = F.col("_n") / F.col("_age"), F.col("_recent") / F.lit(float(recent))
    reason = F.when(F.col("_n") < least, "FEW_TRADES").when(F.col("_age") < history, "SHORT_HISTORY").when(F.col("_recent") < 2, "NO_RECENT").when(now <= rate * (1 - drop), "DROP").otherwise("STEADY")
    return y.withColumn("n_flows", F.col("_n")).withColumn("age", F.col("_age")).withColumn("n_recent", F.col("_recent")).withColumn("reason", reason).drop("_n", "_age", "_recent")


def fixed_silence(flows: DataFrame, at: DataFrame, after: int = 540, eligible: int = 0) -> DataFrame:
    """WIN-23: at the time at of each token: wallets whose last flow is at least after seconds old, of those with more than eligible flows."""
    x = flows.join(at.select("token", "at").hint("merge"), "token").where("bt <= at").groupBy("token", "at", "wallet").agg(F.max("bt").alias("last"), F.count("*").alias("n"))
    x = x.where(F.col("n") > eligible)
    return x.groupBy("token", "at").agg(F.count("*").alias("n_wallets"), F.count_if(F.col("at") - F.col("last") >= after).alias("n_silent"))


def replacement(flows: DataFrame, early: DataFrame, at: DataFrame, back: int = 300) -> DataFrame:
    """WIN-24: whether a wallet that is not early was active in (at - back, at], per token."""
    new = flows.join(early.select("token", "wallet").hint("merge"), KEY, "left_anti").select(F.col("token").alias("_t"), "bt").distinct()
    x = at.select("token", "at").join(new.hint("merge"), (F.col("token") == F.col("_t")) & (F.col("bt") <= F.col("at")), "left")
    return x.groupBy("token", "at").agg(F.coalesce(F.max(F.col("bt") > F.col("at") - back), F.lit(False)).alias("replaced"))


def verdict_flips(verdicts: DataFrame) -> DataFrame:
    """WIN-28: rows at which a wallet's verdict turns from ACCUMULATING or BUILDING to FLIPPING."""
    w = Window.partitionBy(*KEY).orderBy("bt", "seq")
    x = verdicts.withColumn("previous", F.lag("verdict").over(w))
    return x.where("previous IN ('ACCUMULATING', 'BUILDING') AND verdict = 'FLIPPING'")


def quiet_markers(events: DataFrame, least: int = 60) -> DataFrame:
    """WIN-29: whole minutes of quiet before an event of a token that follows the one before by more than least seconds."""
    x = with_previous(events, ("token",), 3600).withColumn("gap", F.col("bt") - F.col("_before")).where(F.col("gap") > least)
    return x.drop("_before").withColumn("quiet_minutes", F.floor(F.col("gap") / 60).cast("long"))


#: Parts of the rows of a key that are ranked on their own before the best of all parts are.
PARTS = 64


def best(rows: DataFrame, keys: list[str], order: str, k: int, tie: str = "wallet") -> DataFrame:
    """The k rows of each key with the largest order, ties by the column tie, which tells the rows of a key apart. Parts of a key are ranked first, so no task sees all wallets of a key."""
    rank = lambda *by: F.row_number().over(Window.partitionBy(*keys, *by).orderBy(F.desc(order), tie))
    x = rows.withColumn("_part", F.pmod(F.xxhash64(tie), F.lit(PARTS))).withColumn("_r", rank("_part")).where(F.col("_r") <= k)
    return x.withColumn("_r", rank()).where(F.col("_r") <= k).drop("_part", "_r")


#: Seconds of a chunk in which rows of a key are numbered.
NUMBER_CHUNK = 86_400


def numbered(rows: DataFrame, key: str, time: str, seq: str, chunk: int = NUMBER_CHUNK) -> DataFrame:
    """rows with _row: their number from 0 within the key by time and seq. Chunks of time are counted first and rows numbered within them, so a hot key spreads over its chunks."""
    x = rows.withColumn("_chunk", F.floor(F.col(time) / chunk))
    before = Window.partitionBy(key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = x.groupBy(key, "_chunk").agg(F.count("*").alias("_c")).select(F.col(key).alias("_k"), F.col("_chunk").alias("_h"), F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_base"))
    x = x.join(base.hint("merge"), (F.col(key) == F.col("_k")) & (F.col("_chunk") == F.col("_h")))
    within = F.row_number().over(Window.partitionBy(key, "_chunk").orderBy(time, seq))
    return x.withColumn("_row", F.col("_base") + within - 1).drop("_chunk", "_k", "_h", "_base")
