"""Operators over transactions and creators. Lists are array columns; membership tests stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewake.functions import scalar as S
from tidewake.operators import windows as W
from tidewake.operators.joins import interval


def signed_by(wallet: Column) -> Column:
    """PRJ-4: the wallet signs or pays (columns signers, feePayer)."""
    return (F.col("feePayer") == wallet) | F.coalesce(F.array_contains(F.col("signers"), wallet), F.lit(False))


def creation_evidence(tx: DataFrame) -> DataFrame:
    """FN-23: whether instructions (kinds) initialise a mint or create an account, and a status."""
    x = tx.withColumn("initialized", F.exists("kinds", lambda k: k.startswith("initializeMint"))).withColumn("created", F.exists("kinds", lambda k: k.startswith("createAccount")))
    return x.withColumn("status", F.when(F.col("initialized"), "CONFIRMED").when(F.col("created"), "PARTIAL").otherwise("NONE"))


def created_tokens(tx: DataFrame, metadata: DataFrame) -> DataFrame:
    """PRJ-15: tokens whose creation a wallet signed, first time, and their pool."""
    x = creation_evidence(tx).where((F.col("status") == "CONFIRMED") & signed_by(F.col("wallet")))
    x = x.groupBy("wallet", "token").agg(F.min("bt").alias("created_at"))
    m = metadata.groupBy("token").agg(F.min("pool").alias("pool"))
    return x.join(m.hint("merge"), "token", "left")


def programs_of(tx: DataFrame, declared: DataFrame) -> DataFrame:
    """JOIN-15, SET-5: programs parsed and declared for each signature, sorted."""
    x = tx.join(declared.hint("merge"), "signature", "left")
    return x.withColumn("programs", F.array_sort(F.array_union("programs", F.coalesce("declared", F.array().cast("array<string>"))))).drop("declared")


def route(programs: Column, dex: Column) -> Column:
    """PRJ-8: aggregator if a known router is among the programs, else the dex."""
    return F.when(F.exists(programs, lambda p: p.like("%jup%")), "aggregator").otherwise(dex)


def tips(tx: DataFrame, accounts: DataFrame) -> DataFrame:
    """JOIN-16: native transfers to tip accounts, number and sum by wallet."""
    x = tx.select("wallet", F.explode("transfers").alias("t")).select("wallet", "t.dst", "t.amount")
    x = x.join(accounts.select(F.col("account").alias("dst")).hint("merge"), "dst", "left_semi")
    return x.groupBy("wallet").agg(F.count("*").alias("n_tips"), F.sum("amount").alias("tipped"))


def first_row(df: DataFrame, keys: str | tuple[str, ...], order: list[str]) -> DataFrame:
    """WIN-30: the first row of each key, by aggregation, so a hot key is reduced on the map side."""
    keys = (keys,) if isinstance(keys, str) else tuple(keys)
    rest = [c for c in df.columns if c not in keys and c not in order]
    x = df.groupBy(*keys).agg(F.min(F.struct(*order, *rest)).alias("_x"))
    return x.select(*keys, "_x.*")


def creators(trades: DataFrame) -> DataFrame:
    """The wallet of each token's first trade."""
    return first_row(trades.select("token", "bt", "signature", "wallet"), "token", ["bt", "signature", "wallet"]).select("token", F.col("wallet").alias("creator"))


def creator_totals(trades: DataFrame, creators_: DataFrame, early: int = 2_592_000) -> DataFrame:
    """AGG-19: lamports a creator bought and sold of its token, its first sell, and whether that came early."""
    x = trades.join(creators_.hint("merge"), "token")
    own, buy = F.col("wallet") == F.col("creator"), F.col("flow_direction") == "in"
    first = F.min(F.when(own & ~buy, F.col("bt")))
    return x.groupBy("token", "creator").agg(F.sum(F.when(own & buy, F.col("lamports")).otherwise(0)).alias("bought"), F.sum(F.when(own & ~buy, F.col("lamports")).otherwise(0)).alias("sold"), first.alias("first_sell"), F.coalesce(first - F.min("bt") <= early, F.lit(False)).alias("exited_early"))


def creator_summary(trades: DataFrame, creators_: DataFrame) -> DataFrame:
    """AGG-20: tokens of each creator, those it sold, and the median delay of its first sell."""
    x = trades.join(creators_.hint("merge"), "token").groupBy("token", "creator").agg(F.min("bt").alias("t0"), F.min(F.when((F.col("wallet") == F.col("creator")) & (F.col("flow_direction") == "out"), F.col("bt"))).alias("first_sell"))
    return x.groupBy("creator").agg(F.count("*").alias("n_tokens"), F.count("first_sell").alias("n_sold"), F.median(F.col("first_sell") - F.col("t0")).alias("median_delay"))


def repeated_wallets(funded: DataFrame, most: int = 10) -> DataFrame:
    """AGG-20: of early buyers (token, creator, wallet, direct, indirect), the wallets that a creator funded or that bought in several of its tokens: tokens of each, the most frequent ones of each creator."""
    x = funded.groupBy("creator", "wallet").agg(F.countDistinct("token").alias("n_tokens"), F.max("direct").alias("direct"), F.max("indirect").alias("indirect")).where("n_tokens > 1 OR direct OR indirect")
    w = Window.partitionBy("creator").orderBy(F.desc("n_tokens"), "wallet")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def funding_summary(funded: DataFrame) -> DataFrame:
    """AGG-20: for each creator, its tokens with early buyers and those among them with directly and indirectly funded ones."""
    x = funded.groupBy("creator", "token").agg(F.max("direct").alias("direct"), F.max("indirect").alias("indirect"))
    return x.groupBy("creator").agg(F.count("*").alias("n_tokens"), F.count_if("direct").alias("n_direct"), F.count_if("indirect").alias("n_indirect"))


def intermediaries(funded: DataFrame, most: int = 10) -> DataFrame:
    """AGG-20: of funded_buyers() with path: the wallets through which a creator funded early buyers, with how many early buys and tokens; the most frequent ones of each creator, ties by name."""
    x = funded.where("indirect").select("creator", "token", F.explode("path").alias("wallet"))
    x = x.groupBy("creator", "wallet").agg(F.count("*").alias("n"), F.countDistinct("token").alias("n_tokens"))
    w = Window.partitionBy("creator").orderBy(F.desc("n"), "wallet")
    return x.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def creator_flows(trades: DataFrame, creators_: DataFrame, before: int, after: int, is_transfer: Column) -> DataFrame:
    """FN-25: a creator's flows in its token around the launch, typed BUY, SELL or TRANSFER_OUT."""
    start = trades.groupBy("token").agg(F.min("bt").alias("_t0"))
    x = trades.join(creators_.hint("merge"), "token").join(start.hint("merge"), "token").where((F.col("wallet") == F.col("creator")) & F.col("bt").between(F.col("_t0") - before, F.col("_t0") + after))
    return x.withColumn("kind", F.when(F.col("flow_direction") == "in", "BUY").when(is_transfer, "TRANSFER_OUT").otherwise("SELL")).drop("_t0")


def slot_audit(buys: DataFrame, triggers: DataFrame, swaps: DataFrame, back: int = 300) -> DataFrame:
    """WIN-31: delay of each first buy to the token's trigger if there is one by then, else to the first swap of the last back seconds."""
    g = triggers.select("token", F.col("bt").alias("_g"))
    seen = interval(buys.select("wallet", "token", F.col("first_buy").alias("at")), swaps.select("token", "bt"), back, 0)
    h = seen.groupBy("wallet", "token").agg(F.min("bt").alias("_h"))
    x = buys.join(g.hint("merge"), "token", "left").join(h.hint("merge"), ["wallet", "token"], "left")
    first = F.coalesce(F.when(F.col("_g") <= F.col("first_buy"), F.col("_g")), F.col("_h"))
    return x.select("wallet", "token", "first_buy", first.alias("first_swap"), (F.col("first_buy") - first).alias("delta"))


def trigger_rows(swaps: DataFrame, k: int = 3) -> DataFrame:
    """WIN-32: first swap of each token, its wallet, and the programs of its first k rows."""
    w = Window.partitionBy("token").orderBy("bt", "signature", "wallet")
    x = swaps.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k)
    return x.groupBy("token").agg(F.min("bt").alias("first_swap"), F.min(F.struct("_n", "wallet"))["wallet"].alias("deployer"), F.array_join(F.array_sort(F.collect_set("dex")), ",").alias("programs"))


def signal_rows(flows: DataFrame, early: int = 300, back: int = 60, least: int = 3, persistence_gap: int = 300) -> DataFrame:
    """ST-9: one row for each flow with a whale crossing: TIMING, COORDINATION and PERSISTENCE as they hold."""
    first = W.whale_crossings(flows).groupBy("token", "wallet", "bt", "seq", "direction").agg(F.min("event_type").alias("event_type"))
    mark = lambda df, name: df.select("token", "wallet").distinct().withColumn(name, F.lit(True)).hint("merge")
    group = W.coordination(first, back, least).select("token", "seq").withColumn("_c", F.lit(True)).hint("merge")
    x = first.join(mark(W.early_wallets(flows, early), "_t"), ["token", "wallet"], "left").join(group, ["token", "seq"], "left").join(mark(W.persistence(flows, gap=persistence_gap), "_p"), ["token", "wallet"], "left")
    return x.withColumn("signals", F.array_compact(F.array(F.when(F.col("_t"), "TIMING"), F.when(F.col("_c"), "COORDINATION"), F.when(F.col("_p"), "PERSISTENCE")))).drop("_t", "_c", "_p")


def exhaustion_steps(curve: DataFrame, share: float = 0.6) -> DataFrame:
    """ST-8: times at which the silent share first reaches 60 % and then each further tenth."""
    x = curve.where("n_seen > 0").withColumn("share", F.col("n_silent") / F.col("n_seen")).withColumn("_s", F.floor(F.col("share") * 10))
    x = W.prior_maximum(x.withColumns({"bt": F.col("at"), "seq": F.lit(0)}), "_s", 86_400).withColumnRenamed("prior_max", "_before")
    return x.where((F.col("share") >= share) & (F.col("_before").isNull() | (F.col("_before") < 6) | (F.col("_s") > F.col("_before")))).select("token", "at", "share")


def alerts(kinds: dict[str, DataFrame]) -> DataFrame:
    """ST-12: the latest row of each kind of alert and token."""
    out = None
    for kind, df in kinds.items():
        x = df.select("token", F.lit(kind).alias("kind"), "wallet", "bt", "seq")
        out = x if out is None else out.unionAll(x)
    return out.groupBy("token", "kind").agg(F.max(F.struct("bt", "seq", "wallet")).alias("x")).select("token", "kind", "x.wallet", "x.bt")


def verdict_record(flows: DataFrame, silent: int = 120) -> DataFrame:
    """ST-11: capital direction (sign, doubled if strong), silent share of a token's wallets at its last flow, and exhaustion label."""
    buy = F.col("direction") == "buy"
    cap = flows.groupBy("token").agg(F.sum(F.when(buy, F.col("lamports")).otherwise(-F.col("lamports"))).alias("net"), F.sum("lamports").alias("vol"), F.max("bt").alias("t1"))
    last = flows.groupBy("token", "wallet").agg(F.max("bt").alias("last")).join(cap.hint("merge"), "token")
    quiet = F.count_if(F.col("t1") - F.col("last") > silent) / F.count("*")
    sign = F.signum("net").cast("int")
    strong = F.when((F.col("vol") > 0) & (F.abs("net") / F.col("vol") >= 0.15), 2).otherwise(1)
    x = last.groupBy("token", "net", "vol").agg(quiet.alias("silent_share"))
    return x.select("token", (sign * strong).alias("capital"), "silent_share", S.exhaustion_label(F.col("silent_share")).alias("exhaustion"))


def full_verdicts(flows: DataFrame, changes: DataFrame, cohorts: DataFrame) -> DataFrame:
    """ST-11 in full: verdict_record() with the token's last wave (trend, cliff, ghost), and its last entry signal: buyers and time of the last peak of pressure that no exhaustion or end has followed."""
    from tidewake.operators import machine as M

    last = lambda df, order, cols: df.groupBy("token").agg(F.max(F.struct(*order, *cols)).alias("_x")).select("token", *[F.col(f"_x.{c}").alias(c) for c in cols])
    trend = last(M.wave_trend(cohorts), ("wave",), ("trend", "cliff", "ghost", "peak"))
    now = changes.groupBy("token").agg(F.max(F.struct("bt", "seq", "to_state", "n")).alias("_x"))
    entry = now.select("token", (F.col("_x.to_state") == "PRESSURE_PEAKING").alias("entry"), F.when(F.col("_x.to_state") == "PRESSURE_PEAKING", F.col("_x.n")).alias("entry_buyers"))
    x = verdict_record(flows).join(trend.hint("merge"), "token", "left").join(entry.hint("merge"), "token", "left")
    return x.withColumn("entry", F.coalesce("entry", F.lit(False))).withColumn("cliff", F.coalesce("cliff", F.lit(False))).withColumn("ghost", F.coalesce("ghost", F.lit(False))).withColumn("trend", F.coalesce("trend", F.lit("INSUFFICIENT_DATA")))


def transitions_v2(flows: DataFrame, back: int = 60, least: int = 3, end: int = 600) -> DataFrame:
    """ST-5: the second generation's rules as windows: per episode of whale flows, ignition at the first and coordination at the first flow with so many distinct whales in back seconds."""
    from tidewake.operators.episodes import token_episodes

    whales = W.whale_crossings(flows).groupBy("token", "wallet", "bt", "seq", "direction").agg(F.count("*").alias("n"))
    x = token_episodes(whales, end)
    together = W.coordination(x, back, least).select("token", "seq").withColumn("_c", F.lit(True))
    x = x.join(together.hint("merge"), ["token", "seq"], "left")
    pick = lambda c: F.min(F.when(c, F.struct("bt", "seq")))
    y = x.groupBy("token", "episode").agg(pick(F.lit(True)).alias("a"), pick(F.col("_c")).alias("b"))
    first = y.select("token", "episode", F.lit("QUIET").alias("from_state"), F.lit("IGNITION").alias("to_state"), "a.bt", "a.seq")
    return first.unionAll(y.where("b IS NOT NULL AND b > a").select("token", "episode", F.lit("IGNITION"), F.lit("COORDINATION_SPIKE"), "b.bt", "b.seq"))


def conflict(level: Column, dominant: Column, risk_on: Column, risk_high: Column) -> Column:
    """FN-12: text where an alert and risk contradict; empty otherwise."""
    text = lambda k: F.when(dominant == "PUMP", S.CONFLICTS[k].format("pump")).otherwise(S.CONFLICTS[k].format("dump"))
    return F.when((level == "SHOUT") & risk_high, text(0)).when(level.isin("WARNING", "SHOUT") & risk_on, text(1)).otherwise("")


def creator_transfers(transfers: DataFrame, creators_: DataFrame, buyers: DataFrame) -> DataFrame:
    """JOIN-19: token transfers (token, src, dst, bt, signature) from a creator to early buyers (token, wallet); the last counts."""
    x = transfers.join(creators_.hint("merge"), "token").where("src = creator")
    x = x.join(buyers.select("token", F.col("wallet").alias("dst")).distinct().hint("merge"), ["token", "dst"])
    return x.groupBy("token", "creator", "dst").agg(F.max(F.struct("bt", "signature"))["signature"].alias("signature"), F.count("*").alias("n"))


def funded_buyers(buyers: DataFrame, paths: DataFrame) -> DataFrame:
    """JOIN-20: early buyers (token, creator, wallet) with flags for direct and indirect funding by the creator. paths: (source, target, hops), with path it stays."""
    rest = [c for c in ("path",) if c in paths.columns]
    p = paths.groupBy(F.col("source").alias("creator"), F.col("target").alias("wallet")).agg(F.min(F.struct("hops", *rest)).alias("p"))
    x = buyers.join(p.select("creator", "wallet", "p.*").hint("merge"), ["creator", "wallet"], "left")
    return x.withColumn("direct", F.coalesce(F.col("hops") == 1, F.lit(False))).withColumn("indirect", F.coalesce(F.col("hops") > 1, F.lit(False)))


def first_buy_programs(firsts: DataFrame, tx: DataFrame) -> DataFrame:
    """JOIN-22: program path of the transaction of each first buy (signature, program_path text separated by |)."""
    t = tx.groupBy("signature").agg(F.min("program_path").alias("program_path"))
    x = firsts.join(t.hint("merge"), "signature", "left").withColumn("programs", F.split("program_path", "\\|"))
    return x.withColumn("via_router", F.coalesce(F.exists("programs", lambda p: p.like("%jup%")), F.lit(False)))


def retained_supply(holders: DataFrame, creators_: DataFrame) -> DataFrame:
    """JOIN-23: share of a token's supply that its creator holds in its largest account (token, wallet, balance)."""
    total = holders.groupBy("token").agg(F.sum(F.greatest("balance", F.lit(0))).alias("supply"))
    own = holders.join(creators_.select("token", F.col("creator").alias("wallet")).hint("merge"), ["token", "wallet"]).groupBy("token").agg(F.max("balance").alias("held"))
    x = total.join(own.hint("merge"), "token", "left")
    return x.withColumn("retained", F.when(F.col("supply") > 0, F.coalesce(F.greatest("held", F.lit(0)), F.lit(0)) / F.col("supply")))


def seed_verification(seeds: DataFrame, evidence: DataFrame) -> DataFrame:
    """FN-24: status of each seed mint: VERIFIED with creation evidence, else UNVERIFIED."""
    e = evidence.where("initialized").groupBy("token").agg(F.min("bt").alias("created_at"))
    return seeds.join(e.hint("merge"), "token", "left").withColumn("status", F.when(F.col("created_at").isNotNull(), "VERIFIED").otherwise("UNVERIFIED"))


def cleaned(wallet_rows: DataFrame, now: DataFrame, idle: int = 900) -> DataFrame:
    """ST-15: wallets of a token whose last flow is not older than idle seconds at its time (token, at)."""
    x = wallet_rows.join(now.hint("merge"), "token")
    return x.where(F.col("at") - F.col("last_seen") <= idle)
