"""Queries over trades: joins, aggregates and rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import scalar as S
from tidewake.operators import aggregates as A
from tidewake.operators import joins as J
from tidewake.operators import windows as W
from tidewake.plans.registry import query
from tidewake.sources.canonical import oracle

PNL = """SELECT *, received - spent AS net FROM (SELECT wallet, token, sum(CASE WHEN flow_direction = 'in' THEN lamports ELSE 0 END)::BIGINT AS spent, sum(CASE WHEN flow_direction = 'out' THEN lamports ELSE 0 END)::BIGINT AS received,
  max(bt) - min(bt) AS hold, count(*) FILTER (flow_direction = 'in') AS n_buys, count(*) FILTER (flow_direction = 'out') AS n_sells FROM valid GROUP BY wallet, token) WHERE n_buys > 0"""


@query("join1_valid_flows", oracle("SELECT t.signature, t.wallet, t.line, t.lamports FROM trades t LEFT JOIN trades x ON t.signature = x.signature AND t.wallet = x.wallet WHERE x.err IS NULL OR x.err = ''", "trades"))
def join1(t):
    return J.valid_flows(t.trades, t.trades.select("signature", "wallet", "err")).select("signature", "wallet", "line", "lamports")


@query("agg1_token_pnl", oracle("SELECT * FROM pnl", "valid", pnl=PNL))
def agg1(t):
    return A.token_pnl(t.valid)


@query("agg2_wallet_summary", oracle("""SELECT wallet, count(*) AS n_tokens, count(*) FILTER (net > 0) / count(*) AS win_rate, sum(net) / 1e9 AS total_net, round(sum(net)::DOUBLE / count(*) / 1e9, 6) AS mean_net, round(median(net / 1e9), 6) AS median_net,
  round(stddev_pop(net / 1e9), 4) AS std_net, max(net / 1e9) AS best, min(net / 1e9) AS worst, median(hold) AS median_hold, count(*) FILTER (n_sells > 1) / count(*) AS partial_exit_rate,
  CASE WHEN sum(greatest(net, 0)) > 0 THEN sum(CASE WHEN net > 0 AND n <= 5 THEN net ELSE 0 END) / sum(greatest(net, 0)) ELSE 0 END AS top5_share,
  round(CASE WHEN sum(least(net, 0)) < 0 THEN sum(greatest(net, 0)) / -sum(least(net, 0)) ELSE 0 END, 6) AS profit_factor
  FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY net DESC, token) AS n FROM pnl) GROUP BY wallet""", "valid", pnl=PNL))  # fmt: skip
def agg2(t):
    return A.wallet_summary(A.token_pnl(t.valid))


ENTRY = """SELECT wallet, token, first_buy, first_trade, first_buy - first_trade AS delta FROM (SELECT wallet, token, min(bt) AS first_buy FROM valid WHERE flow_direction = 'in' GROUP BY wallet, token)
  JOIN (SELECT token, min(bt) AS first_trade FROM valid GROUP BY token) USING (token)"""


@query("join2_entry_delta", oracle("SELECT * FROM entry", "valid", entry=ENTRY))
def join2(t):
    return J.entry_delta(t.valid).select("wallet", "token", "first_buy", "first_trade", "delta")


_SHARES = ", ".join(f"round(count(*) FILTER (delta <= {s}) / count(*), 4) AS within_{s}" for s in (10, 30, 60, 120, 300))


@query("agg3_entry_timing", oracle(f"""SELECT wallet, count(*) AS n, median(delta) AS median, round(sum(delta)::DOUBLE / count(*), 3) AS mean, list_sort(list(delta))[least((floor(count(*) * 0.9))::INT, count(*) - 1) + 1] AS p90, min(delta) AS least, max(delta) AS most, {_SHARES}
  FROM entry GROUP BY wallet""", "valid", entry=ENTRY))  # fmt: skip
def agg3(t):
    return A.delta_summary(J.entry_delta(t.valid), ("wallet",))


SWAPS = "SELECT * FROM valid WHERE dex <> 'orca' AND flow_direction = 'out'"
FSD = "SELECT v.wallet, v.token, v.bt, v.bt - first_swap AS delta FROM (SELECT * FROM valid WHERE flow_direction = 'in') v LEFT JOIN (SELECT token, min(bt) AS first_swap FROM swaps GROUP BY token) USING (token)"


@query("join3_first_swap_delta", oracle("SELECT wallet, token, bt, delta FROM fsd", "valid", swaps=SWAPS, fsd=FSD))
def join3(t):
    return J.first_swap_delta(t.valid.where("flow_direction = 'in'"), t.valid.where("dex <> 'orca' AND flow_direction = 'out'")).select("wallet", "token", "bt", "delta")


_P = ", ".join(f"round(quantile_cont(delta, {p / 100}), 4) AS p{p}" for p in (10, 25, 50, 75, 90))
_WITHIN = ", ".join(f"round(count(*) FILTER (delta <= {s}) / count(delta), 6) AS within_{s}" for s in (10, 30, 60, 120))


@query("agg4_first_swap_summary", oracle(f"""SELECT wallet, count(delta) AS n, count(*) FILTER (delta IS NULL) AS missing, {_P}, {_WITHIN}, count(*) FILTER (delta < 0) AS negatives,
  coalesce(array_to_string(list_sort(list(DISTINCT token) FILTER (delta < 0))[1:10], ','), '') AS first_negative FROM fsd GROUP BY wallet""", "valid", swaps=SWAPS, fsd=FSD))  # fmt: skip
def agg4(t):
    x = J.first_swap_delta(t.valid.where("flow_direction = 'in'"), t.valid.where("dex <> 'orca' AND flow_direction = 'out'"))
    return A.linear_summary(x, ("wallet",))


LIQ = "SELECT p.wallet, p.token, p.spent, l.liquidity, p.spent / (l.liquidity * 10000000) AS share FROM pnl p JOIN mint_liquidity l USING (token) WHERE l.liquidity > 0"


def shares(t):
    spends = A.token_pnl(t.valid).select("wallet", "token", "spent")
    return J.liquidity_share(spends, t.mint_liquidity.withColumn("liquidity", F.col("liquidity") * 10_000_000))


@query("join4_liquidity_share", oracle("SELECT wallet, token, spent, share FROM liq", "valid", "mint_liquidity", pnl=PNL, liq=LIQ))
def join4(t):
    return shares(t).select("wallet", "token", "spent", "share")


@query("agg5_share_summary", oracle("""SELECT wallet, count(*) AS n, round(median(share), 6) AS median, round(list_sort(list(share))[least(floor(count(*) * 0.9)::INT, count(*) - 1) + 1], 6) AS p90, round(max(share), 6) AS most,
  count(*) FILTER (share > 0.01) / count(*) AS above_1pct, count(*) FILTER (share > 0.03) / count(*) AS above_3pct, count(*) FILTER (share > 0.05) / count(*) AS above_5pct FROM liq GROUP BY wallet""", "valid", "mint_liquidity", pnl=PNL, liq=LIQ))  # fmt: skip
def agg5(t):
    return A.share_summary(shares(t), ("wallet",))


@query("join5_deltas_by_signature", oracle("""SELECT w.wallet, w.token, sum(x.delta)::BIGINT AS delta, count(*) AS n_tx FROM (SELECT DISTINCT wallet, token, signature FROM valid) w JOIN (SELECT wallet, signature, CASE WHEN flow_direction = 'out' THEN lamports ELSE -lamports END AS delta FROM trades) x
  USING (wallet, signature) GROUP BY w.wallet, w.token""", "valid"))  # fmt: skip
def join5(t):
    tx = t.trades.select("wallet", "signature", F.when(A.is_out(), F.col("lamports")).otherwise(-F.col("lamports")).alias("delta"))
    return J.deltas_by_signature(t.valid.select("wallet", "token", "signature").distinct(), tx)


BUCKETED = """SELECT p.wallet, p.token, p.net, e.delta // 86400 AS delta, CASE WHEN e.delta // 86400 <= 5 THEN 'FAST' WHEN e.delta // 86400 <= 60 THEN 'MID' ELSE 'SLOW' END AS bucket, l.lp_lock_flag AS locked, d.dex FROM pnl p JOIN entry e USING (wallet, token) LEFT JOIN mint_liquidity l USING (token)
  JOIN (SELECT wallet, token, dex FROM (SELECT wallet, token, dex, row_number() OVER (PARTITION BY wallet, token ORDER BY count(*) DESC, dex) AS n FROM valid GROUP BY wallet, token, dex) WHERE n = 1) d USING (wallet, token)"""


def bucketed(t):
    """Wallet and token rows with entry bucket (delay in days here), lock flag and most frequent dex."""
    x = A.token_pnl(t.valid).join(J.entry_delta(t.valid).hint("merge"), ["wallet", "token"]).withColumn("delta", F.floor(F.col("delta") / 86_400))
    x = x.withColumn("bucket", S.entry_bucket(F.col("delta"))).join(t.mint_liquidity.select("token", F.col("lp_lock_flag").alias("locked")).hint("merge"), "token", "left")
    return x.join(A.mode(t.valid, ["wallet", "token"], "dex").drop("_count").hint("merge"), ["wallet", "token"]).select("wallet", "token", "net", "delta", "bucket", "locked", "dex")


@query("agg6_bucket_summary", oracle("""SELECT b.bucket, coalesce(n, 0) AS n, win_rate, median_net, median_delta, profit_factor, locked_share, top_dex, round(c / n, 6) AS top_dex_share FROM (SELECT unnest(['FAST', 'MID', 'SLOW']) AS bucket) b LEFT JOIN (
  SELECT bucket, count(*) AS n, round(count(*) FILTER (net > 0) / count(*), 6) AS win_rate, round(median(net / 1e9), 6) AS median_net, median(delta) AS median_delta,
  round(CASE WHEN sum(least(net, 0)) < 0 THEN sum(greatest(net, 0)) / -sum(least(net, 0)) END, 6) AS profit_factor, round(count(*) FILTER (locked = 1) / count(*), 6) AS locked_share FROM r GROUP BY bucket) USING (bucket)
  LEFT JOIN (SELECT bucket, dex AS top_dex, c FROM (SELECT bucket, dex, count(*) AS c, row_number() OVER (PARTITION BY bucket ORDER BY count(*) DESC, dex) AS k FROM r GROUP BY bucket, dex) WHERE k = 1) USING (bucket)""", "valid", "mint_liquidity", pnl=PNL, entry=ENTRY, r=BUCKETED))  # fmt: skip
def agg6(t):
    return A.bucket_summary(bucketed(t))


@query("agg7_dex_breakdown", oracle("SELECT bucket, dex, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY bucket), 6) AS share FROM r GROUP BY bucket, dex", "valid", "mint_liquidity", pnl=PNL, entry=ENTRY, r=BUCKETED))
def agg7(t):
    return A.breakdown(bucketed(t))


@query("agg8_mode_dex", oracle("SELECT wallet, dex, c AS n FROM (SELECT wallet, dex, count(*) AS c, row_number() OVER (PARTITION BY wallet ORDER BY count(*) DESC, dex) AS k FROM valid GROUP BY wallet, dex) WHERE k = 1", "valid"))
def agg8(t):
    return A.mode(t.valid, ["wallet"], "dex").withColumnRenamed("_count", "n")


RECON = """SELECT *, CASE WHEN cost > 0 THEN (proceeds - cost) / cost END AS roi, CASE WHEN n_sells > 0 THEN 'CLOSED' ELSE 'OPEN' END AS status, fs IS NOT NULL AND (entry IS NULL OR fs < entry) AS sell_before_buy FROM (
  SELECT wallet, token, min(bt) FILTER (flow_direction = 'in') AS entry, max(bt) FILTER (flow_direction = 'out') AS exit, sum(CASE WHEN flow_direction = 'in' THEN lamports ELSE 0 END)::BIGINT AS cost, sum(CASE WHEN flow_direction = 'out' THEN lamports ELSE 0 END)::BIGINT AS proceeds,
  count(*) FILTER (flow_direction = 'in') AS n_buys, count(*) FILTER (flow_direction = 'out') AS n_sells, min(bt) FILTER (flow_direction = 'out') AS fs FROM valid GROUP BY wallet, token)"""
CLOSED = "SELECT *, proceeds - cost AS net, exit - entry AS hold FROM recon WHERE status = 'CLOSED' AND entry IS NOT NULL AND cost > 0"


def closed(t):
    x = A.reconstruct(t.valid).where("status = 'CLOSED' AND entry IS NOT NULL AND cost > 0")
    return x.withColumn("net", F.col("proceeds") - F.col("cost")).withColumn("hold", F.col("exit") - F.col("entry"))


@query("agg9_reconstruct", oracle("SELECT * EXCLUDE (fs) FROM recon", "valid", recon=RECON))
def agg9(t):
    return A.reconstruct(t.valid)


def _at(c: str, name: str, ps: tuple[int, ...], scale: str, digits: int) -> str:
    return ", ".join(f"round(quantile_cont({c}, {p / 100}){scale}, {digits}) AS {name}_p{p}" for p in ps)


_TAILS = ", ".join((_at("roi", "roi", A.TAILS, "", 6), _at("net", "net", A.TAILS, " / 1e9", 7), _at("hold", "hold", A.SPREAD, "", 2), _at("cost", "entry", A.SPREAD, " / 1e9", 7)))


@query("agg10_distribution", oracle(f"""SELECT count(*) AS n, count(*) FILTER (net > 0) AS n_wins, count(*) FILTER (net < 0) AS n_losses, round(avg(net) FILTER (net > 0) / 1e9, 4) AS mean_win, round(avg(net) FILTER (net < 0) / 1e9, 4) AS mean_loss, round(median(net / 1e9) FILTER (net > 0), 6) AS median_win,
  round(median(net / 1e9) FILTER (net < 0), 6) AS median_loss, round(sum(net) / count(*) / 1e9, 4) AS expectancy, round(CASE WHEN count(*) FILTER (net < 0) > 0 THEN sum(greatest(net, 0)) / -sum(least(net, 0)) WHEN count(*) FILTER (net > 0) > 0 THEN 'inf'::DOUBLE END, 6) AS profit_factor, {_TAILS}, round(count(*) FILTER (net > 0) / count(*), 6) AS win_rate FROM closed""", "valid", recon=RECON, closed=CLOSED))  # fmt: skip
def agg10(t):
    return A.distribution(closed(t))


@query("agg10_exits_by_hour", oracle("SELECT h.hour, count(c.exit) AS n FROM (SELECT unnest(range(24)) AS hour) h LEFT JOIN closed c ON c.exit // 3600 % 24 = h.hour GROUP BY h.hour", "valid", recon=RECON, closed=CLOSED))
def agg10_hours(t):
    return A.exits_by_hour(closed(t))


@query("agg11_wallet_activity", oracle("SELECT wallet, min(bt) AS first_bt, max(bt) AS last_bt, count(DISTINCT token) FILTER (flow_direction = 'in') AS n_tokens, count(*) AS n_flows FROM valid GROUP BY wallet", "valid"))
def agg11(t):
    return A.wallet_activity(t.valid)


FB = "SELECT wallet, token, min(bt) AS first_buy FROM valid WHERE flow_direction = 'in' GROUP BY wallet, token"
LEAD = "SELECT a.wallet AS a, b.wallet AS b, count(*) AS shared, count(*) FILTER (b.first_buy > a.first_buy) / count(*) AS lead_rate, median(b.first_buy - a.first_buy) AS median_delta, quantile_disc(b.first_buy - a.first_buy, 0.9) AS p90_delta FROM fb a JOIN fb b ON a.token = b.token AND a.wallet < b.wallet GROUP BY ALL"


#: The wallets that a report compares: the 40 that entered the most tokens.
LEADERS = "SELECT wallet FROM (SELECT wallet, count(*) AS n FROM fb GROUP BY wallet) ORDER BY n DESC, wallet LIMIT 40"


def leaders(t, k: int = 40):
    return J.first_buys(t.valid).groupBy("wallet").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "wallet").limit(k).select("wallet")


@query("join10_lead_follow", oracle(LEAD, "valid", fb0=FB, leaders=LEADERS.replace("fb", "fb0"), fb="SELECT * FROM fb0 WHERE wallet IN (SELECT wallet FROM leaders)"))
def join10(t):
    return J.pair_stats(J.first_buys(t.valid), leaders(t))


@query("join10_lead_follow_all", oracle(LEAD, "valid", fb=FB))
def join10_all(t):
    return J.pair_stats(J.first_buys(t.valid))


SEEDS = "SELECT DISTINCT wallet FROM valid"


def wallets(t):
    """All wallets."""
    return t.valid.select("wallet").distinct()


_OVERLAP = "SELECT a.wallet AS a, b.wallet AS b, count(*) AS shared, count(*) / least(any_value(n1.n), any_value(n2.n)) AS overlap FROM fb a JOIN fb b ON a.token = b.token AND a.wallet {} b.wallet JOIN n n1 ON n1.wallet = a.wallet JOIN n n2 ON n2.wallet = b.wallet GROUP BY ALL"
_SIZES = "SELECT wallet, count(*) AS n FROM fb GROUP BY wallet"


@query("join11_token_overlap", oracle(_OVERLAP.format("<="), "valid", fb=FB, n=_SIZES))
def join11(t):
    return J.token_overlap(J.first_buys(t.valid), wallets(t))


@query("join11_overlap_join", oracle(f"SELECT * FROM ({_OVERLAP.format('<')}) WHERE overlap >= 0.85::DOUBLE", "valid", fb=FB, n=_SIZES))
def join11_similar(t):
    """All wallets whose shared tokens are 85 % or more of the smaller one's."""
    return J.overlap_join(J.first_buys(t.valid), 0.85)


@query("join10_lead_follow_least", oracle(f"SELECT * FROM ({LEAD}) WHERE shared >= 20", "valid", fb=FB))
def join10_least(t):
    """Lead and delay of every pair of wallets with at least 20 tokens in common."""
    return J.pair_stats(J.first_buys(t.valid), least_shared=20)


BOTH = "SELECT wallet_a AS wallet, wallet_b AS neighbour, weight FROM edges UNION ALL SELECT wallet_b, wallet_a, weight FROM edges WHERE wallet_a <> wallet_b"


@query("join12_top_neighbours", oracle("SELECT wallet, neighbour, weight FROM (SELECT wallet, neighbour, sum(weight)::BIGINT AS weight, row_number() OVER (PARTITION BY wallet ORDER BY sum(weight) DESC, neighbour) AS n FROM both_ JOIN seeds USING (wallet) GROUP BY wallet, neighbour) WHERE n <= 5", "valid", "edges", both_=BOTH, seeds=SEEDS))
def join12(t):
    return J.neighbours(t.edges, wallets(t), 5, 2 * t.parts("lineitem"))


@query("join13_degrees", oracle("SELECT s.wallet, count(e.w) AS degree FROM seeds s LEFT JOIN (SELECT wallet_a AS w FROM edges UNION ALL SELECT wallet_b FROM edges) e ON e.w = s.wallet GROUP BY s.wallet", "valid", "edges", seeds=SEEDS))
def join13(t):
    return J.degrees(t.edges, wallets(t))


@query("join14_shared_groups", oracle("SELECT s.wallet, count(DISTINCT b.wallet) AS n_shared FROM seeds s LEFT JOIN members a ON a.wallet = s.wallet LEFT JOIN (SELECT * FROM members WHERE wallet IN (SELECT wallet FROM seeds)) b ON a.group_id = b.group_id AND b.wallet <> a.wallet GROUP BY s.wallet", "valid", "members", seeds=SEEDS))
def join14(t):
    return J.shared_groups(t.members, wallets(t))


@query("join6_nearest_mcap", oracle("""SELECT wallet, token, first_buy, mcap, mcap_time FROM (SELECT f.*, m.mcap, m.mcap_time, row_number() OVER (PARTITION BY f.wallet, f.token ORDER BY abs(f.first_buy - m.mcap_time), m.mcap_time DESC, m.mcap DESC) AS n
  FROM fb f LEFT JOIN mcap m ON m.token = f.token AND abs(f.first_buy - m.mcap_time) <= 43200) WHERE n = 1""", "valid", "mcap", fb=FB))  # fmt: skip
def join6(t):
    return J.nearest(J.first_buys(t.valid), t.mcap, 43_200, time="first_buy", parts=t.parts("lineitem"))


ANCHORS = "SELECT wallet AS anchor, token, bt AS at FROM buys"
BUYS = "SELECT * FROM valid WHERE flow_direction = 'in'"


@query("join7_co_wallets", oracle("SELECT anchor, wallet, count(DISTINCT a.token) AS n_tokens, count(*) AS n_pairs FROM anchors a JOIN buys b ON a.token = b.token AND b.bt BETWEEN a.at - 21600 AND a.at + 21600 AND b.wallet <> a.anchor GROUP BY anchor, wallet", "valid", buys=BUYS, anchors=ANCHORS))
def join7(t):
    buys = t.valid.where("flow_direction = 'in'")
    return J.co_wallets(buys, buys, 21_600)


@query("join8_pre_entry", oracle("""SELECT e.signature AS entry, e.token, e.bt AS at, count(DISTINCT f.wallet) FILTER (f.bt BETWEEN e.bt - 10 AND e.bt - 1 AND f.direction = 'buy') AS buyers_before, count(*) FILTER (f.direction = 'buy') AS n_buys, count(*) FILTER (f.direction = 'sell') AS n_sells,
  (count(*) FILTER (f.direction = 'buy') - count(*) FILTER (f.direction = 'sell')) / count(*) AS imbalance FROM (SELECT * FROM flows WHERE direction = 'buy' AND lamports >= 25000000000) e JOIN flows f ON f.token = e.token AND f.bt BETWEEN e.bt - 30 AND e.bt + 30 GROUP BY ALL""", "flows"))  # fmt: skip
def join8(t):
    entries = t.flows.where("direction = 'buy' AND lamports >= 25000000000").select(F.col("signature").alias("entry"), "token", F.col("bt").alias("at"))
    return J.pre_entry(entries, t.flows)


@query("join9_trade_windows", oracle("""SELECT r.wallet || ':' || r.token AS trade, r.token, count(*) AS n_swaps, sum(v.lamports)::BIGINT AS lamports FROM (SELECT * FROM closed WHERE hold BETWEEN 0 AND 864000) r JOIN valid v ON v.token = r.token AND v.bt BETWEEN r.entry - 60 AND r.exit + 60 GROUP BY ALL""", "valid", recon=RECON, closed=CLOSED))
def join9(t):
    x = closed(t).where("hold BETWEEN 0 AND 864000").select(F.concat_ws(":", "wallet", "token").alias("trade"), "token", "entry", "exit")
    return J.trade_windows(x, t.valid)


TRANSFERS = "SELECT DISTINCT wallet AS src, ((line * 13 + seq) % 100 + 1)::VARCHAR AS dst, bt FROM valid"


def transfers(trades):
    """Distinct transfers (src, dst, bt) of trades; dst is made from line and sequence number."""
    return repeated_transfers(trades).distinct()


def repeated_transfers(trades):
    """Transfers (src, dst, bt) as they come, for operators that need no distinct ones."""
    return trades.select(F.col("wallet").alias("src"), ((F.col("line") * 13 + F.col("seq")) % 100 + 1).cast("string").alias("dst"), "bt")


@query("join18_funding_paths", oracle("""SELECT source, w AS target, min(hops)::INT AS hops, arg_min(since, hops) AS arrival FROM (
    SELECT src AS source, dst AS w, 1 AS hops, min(bt) AS since FROM tr WHERE dst <> src GROUP BY ALL UNION ALL
    SELECT h.source, t.dst, 2, min(t.bt) FROM (SELECT src AS source, dst AS w, min(bt) AS since FROM tr WHERE dst <> src GROUP BY ALL) h JOIN tr t ON t.src = h.w AND t.bt >= h.since AND t.dst <> h.source GROUP BY h.source, t.dst)
  GROUP BY source, w""", "valid", tr=TRANSFERS))  # fmt: skip
def join18(t):
    tr = repeated_transfers(t.valid)
    return J.funding_paths(tr, tr.select(F.col("src").alias("wallet")).distinct(), tr.select(F.col("dst").alias("wallet")))


@query("join21_deployer_history", oracle("SELECT deployer, count(*) AS n_tokens, avg((net > 0)::INT) AS fast_win_rate FROM (SELECT token, arg_min(wallet, (bt, signature, wallet)) AS deployer FROM valid GROUP BY token) JOIN (SELECT token, sum(net) AS net FROM pnl GROUP BY token) USING (token) GROUP BY deployer", "valid", pnl=PNL))
def join21(t):
    first = t.valid.groupBy("token").agg(F.min(F.struct("bt", "signature", "wallet")).alias("x")).select("token", F.col("x.wallet").alias("deployer"))
    wins = A.token_pnl(t.valid).groupBy("token").agg((F.sum("net") > 0).alias("fast_win"))
    return J.deployer_history(first, wins)


@query("join24_names", oracle("SELECT v.wallet, coalesce(min(n.name), v.wallet) AS name, count(DISTINCT v.signature) AS n FROM valid v LEFT JOIN names n ON n.address = v.wallet GROUP BY v.wallet", "valid", "names"))
def join24(t):
    return J.named(t.valid.groupBy("wallet").agg(F.countDistinct("signature").alias("n")), t.names).select("wallet", "name", "n")


@query("join25_diff", oracle("""SELECT wallet, token, CASE WHEN n > 0 THEN 'left' ELSE 'right' END AS side, abs(n) AS n FROM (SELECT wallet, token, sum(k)::BIGINT AS n FROM (SELECT wallet, token, 1 AS k FROM valid WHERE flow_direction = 'in' UNION ALL SELECT wallet, token, -1 FROM valid WHERE flow_direction = 'out') GROUP BY ALL) WHERE n <> 0""", "valid"))
def join25(t):
    side = lambda d: t.valid.where(F.col("flow_direction") == d).select("wallet", "token")
    return J.diff(side("in"), side("out"))


@query("agg14_panel_statistics", oracle("""SELECT p.panel, coalesce(n, 0) AS n, win_rate, roi_p25, roi_p50, roi_p75 FROM (SELECT unnest(['New Pairs', 'Final Stretch', 'Migrated', 'Unknown']) AS panel) p LEFT JOIN (
  SELECT panel, count(*) AS n, round(count(*) FILTER (net > 0) / count(*), 6) AS win_rate, round(quantile_cont(roi, 0.25), 6) AS roi_p25, round(quantile_cont(roi, 0.5), 6) AS roi_p50, round(quantile_cont(roi, 0.75), 6) AS roi_p75 FROM (
    SELECT c.*, CASE WHEN m IS NULL THEN 'Unknown' WHEN m < 10000 THEN 'New Pairs' WHEN m < 35000 THEN 'Final Stretch' ELSE 'Migrated' END AS panel FROM closed c LEFT JOIN (SELECT token, min(mcap) / 100 AS m FROM mcap WHERE token::INT % 3 > 0 GROUP BY token) USING (token)) GROUP BY panel) USING (panel)""", "valid", "mcap", recon=RECON, closed=CLOSED))  # fmt: skip
def agg14(t):
    m = t.mcap.where("cast(token as int) % 3 > 0").groupBy("token").agg((F.min("mcap") / 100).alias("m"))
    return A.panel_statistics(closed(t).join(m.hint("merge"), "token", "left").withColumn("panel", S.panel(F.col("m"))))


@query("agg15_session_report", oracle("""SELECT count(*) AS n, round(count(*) / greatest((max(bt) - min(bt)) / 60.0::DOUBLE, 1.0), 6) AS per_minute, count(*) FILTER (direction = 'buy') AS n_buys, count(*) FILTER (direction <> 'buy') AS n_sells, sum(lamports) FILTER (direction = 'buy') / 1e9 AS bought,
  round(median(lamports / 1e9) FILTER (direction = 'buy'), 6) AS median_buy, round(quantile_cont(lamports / 1e9, 0.9) FILTER (direction = 'buy'), 6) AS p90_buy FROM flows""", "flows"))  # fmt: skip
def agg15(t):
    return A.session_report(t.flows)


SIZES = "SELECT * FROM (SELECT wallet, round(lamports / 1e9 + 1e-12, 3) AS size, count(*) AS n, row_number() OVER (PARTITION BY wallet ORDER BY count(*) DESC, round(lamports / 1e9 + 1e-12, 3)) AS rank FROM flows WHERE direction = 'buy' GROUP BY wallet, size) WHERE rank <= 5"


@query("agg16_size_buckets", oracle("SELECT wallet, size, n, rank::INT AS rank FROM sizes", "flows", sizes=SIZES))
def agg16(t):
    return A.size_buckets(t.flows.where("direction = 'buy'"))


@query("agg16_size_consistency", oracle("SELECT f.wallet, s.size AS top, round(count(*) FILTER (abs(f.lamports / 1e9 - s.size) <= s.size * 0.01) / count(*), 6) AS share FROM flows f JOIN sizes s ON s.wallet = f.wallet AND s.rank = 1 WHERE f.direction = 'buy' GROUP BY ALL", "flows", sizes=SIZES))
def agg16b(t):
    return A.size_consistency(t.flows.where("direction = 'buy'"))


@query("agg17_pool_summary", oracle("SELECT token, count(*) AS n, count(DISTINCT wallet) AS n_wallets, count(*) FILTER (direction = 'buy') AS n_buys, count(*) FILTER (direction = 'sell') AS n_sells, sum(CASE WHEN direction = 'buy' THEN lamports ELSE 0 END) / 1e9 AS bought, sum(CASE WHEN direction = 'sell' THEN lamports ELSE 0 END) / 1e9 AS sold, max(bt) - min(bt) AS span FROM flows GROUP BY token", "flows"))
def agg17(t):
    return A.pool_summary(t.flows)


_FEATURES = """SELECT p.net > 0 AS win, (l.lp_lock_flag = 1) AS locked, (m.mint_authority IS NOT NULL) AS mintable, p.hold::DOUBLE AS hold, p.n_buys::DOUBLE AS n_buys, p.spent / 1e9 AS spent FROM pnl p LEFT JOIN mint_liquidity l USING (token) LEFT JOIN mint_metadata m USING (token)"""


@query("agg18_feature_effects", oracle("""SELECT feature, is_boolean, coverage, round(effect, 6) AS effect FROM (
    SELECT k AS feature, true AS is_boolean, count(*) AS coverage, (count(*) FILTER (win AND x) + 0.5) * (count(*) FILTER (NOT win AND NOT x) + 0.5) / ((count(*) FILTER (win AND NOT x) + 0.5) * (count(*) FILTER (NOT win AND x) + 0.5)) AS effect
    FROM (SELECT win, 'locked' AS k, locked AS x FROM f UNION ALL SELECT win, 'mintable', mintable FROM f) WHERE x IS NOT NULL GROUP BY k UNION ALL
    SELECT k, false, count(*), (median(x) FILTER (win) - median(x) FILTER (NOT win)) / stddev_samp(x) FROM (SELECT win, 'hold' AS k, hold AS x FROM f UNION ALL SELECT win, 'n_buys', n_buys FROM f UNION ALL SELECT win, 'spent', spent FROM f) GROUP BY k)""", "valid", "mint_liquidity", "mint_metadata", pnl=PNL, f=_FEATURES))  # fmt: skip
def agg18(t):
    x = A.token_pnl(t.valid).join(t.mint_liquidity.hint("merge"), "token", "left").join(t.mint_metadata.hint("merge"), "token", "left")
    x = x.select((F.col("net") > 0).alias("win"), (F.col("lp_lock_flag") == 1).alias("locked"), F.col("mint_authority").isNotNull().alias("mintable"), "hold", "n_buys", (F.col("spent") / 1e9).alias("spent"))
    return A.feature_effects(x, ("locked", "mintable"), ("hold", "n_buys", "spent"))


BAL = "SELECT token, wallet, sum(CASE WHEN flow_direction = 'in' THEN units ELSE -units END)::BIGINT AS balance FROM valid GROUP BY token, wallet"


def balances(t):
    return t.valid.groupBy("token", "wallet").agg(F.sum(F.when(A.is_in(), F.col("units")).otherwise(-F.col("units"))).alias("balance"))


@query("agg21_gini", oracle("SELECT token, count(*) AS n, round(2 * sum(i * balance) / (count(*) * sum(balance)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY balance, wallet) AS i FROM bal WHERE balance > 0) GROUP BY token", "valid", bal=BAL))
def agg21(t):
    return A.gini(balances(t), ("token",))


@query("agg22_mean_deviation", oracle("SELECT token, round(avg(abs(lamports - m)) / 1e9, 6) AS mad FROM flows JOIN (SELECT token, sum(lamports)::DOUBLE / count(*) AS m FROM flows GROUP BY token) USING (token) GROUP BY token", "flows"))
def agg22(t):
    return A.mean_absolute_deviation(t.flows, ("token",), "lamports").select("token", F.round(F.col("mad") / 1e9, 6).alias("mad"))


@query("agg23_thin_threshold", oracle("SELECT token, list_sort(list(amount))[floor((count(*) - 1) * 0.2)::INT + 1] AS threshold FROM liquidity_events GROUP BY token", "liquidity_events"))
def agg23(t):
    return A.thin_threshold(t.liquidity_events, ("token",), "amount")


@query("agg24_token_totals", oracle("""SELECT token, sum(CASE WHEN direction = 'buy' THEN lamports ELSE 0 END) / 1e9 AS bought, sum(CASE WHEN direction = 'sell' THEN lamports ELSE 0 END) / 1e9 AS sold, sum(CASE WHEN direction = 'buy' THEN lamports ELSE -lamports END) / 1e9 AS net,
  count(*) FILTER (direction = 'buy') AS n_buys, count(*) FILTER (direction = 'sell') AS n_sells, count(*) FILTER (direction = 'sell') / count(*) AS sell_ratio FROM flows GROUP BY token""", "flows"))  # fmt: skip
def agg24(t):
    return A.token_totals(t.flows)


@query("agg25_wallet_primitives", oracle("SELECT token, wallet, count(*) AS n, min(bt) AS first_seen, max(bt) AS last_seen FROM flows GROUP BY token, wallet", "flows"))
def agg25(t):
    return A.wallet_primitives(t.flows)


@query("agg27_slot_timing", oracle("SELECT n, within_2, CASE WHEN n % 2 = 1 THEN o[n // 2 + 1] ELSE floor((o[n // 2] + o[n // 2 + 1]) / 2)::BIGINT END AS median FROM (SELECT count(*) AS n, round(count(*) FILTER (d <= 2) / count(*), 6) AS within_2, list_sort(list(d)) AS o FROM (SELECT delta // 86400 AS d FROM entry))", "valid", entry=ENTRY))
def agg27(t):
    return A.slot_timing(J.entry_delta(t.valid).withColumn("delta", F.floor(F.col("delta") / 86_400)))


@query("agg27_tipped_share", oracle("SELECT n, within_2, CASE WHEN n % 2 = 1 THEN o[n // 2 + 1] ELSE floor((o[n // 2] + o[n // 2 + 1]) / 2)::BIGINT END AS median, tipped_share FROM (SELECT count(*) AS n, round(count(*) FILTER (d <= 2) / count(*), 6) AS within_2, list_sort(list(d)) AS o, round(count(*) FILTER (tipped) / count(*), 6) AS tipped_share FROM (SELECT delta // 86400 AS d, EXISTS (SELECT 1 FROM valid v WHERE v.wallet = e.wallet AND v.token = e.token AND v.bt = e.first_buy AND v.dex = 'orca') AS tipped FROM entry e))", "valid", entry=ENTRY))
def agg27_tipped(t):
    """Slot timing of all entries with the share of those whose first buy came with a tip, here: by way of one exchange."""
    tips = t.valid.where("dex = 'orca'").select("wallet", "token", F.col("bt").alias("first_buy"), F.lit(True).alias("_tip")).distinct()
    x = J.entry_delta(t.valid).withColumn("delta", F.floor(F.col("delta") / 86_400)).join(tips.hint("merge"), ["wallet", "token", "first_buy"], "left")
    return A.slot_timing(x.withColumn("tipped", F.col("_tip").isNotNull()), tipped="tipped")


@query("agg27_delta_histogram", oracle("SELECT b.up_to, count(d.d) AS n FROM (SELECT unnest([0, 1, 2, 5, 10, 50, NULL]) AS up_to) b LEFT JOIN (SELECT delta // 86400 AS d FROM entry) d ON b.up_to IS NOT DISTINCT FROM CASE WHEN d <= 0 THEN 0 WHEN d <= 1 THEN 1 WHEN d <= 2 THEN 2 WHEN d <= 5 THEN 5 WHEN d <= 10 THEN 10 WHEN d <= 50 THEN 50 END AND d.d IS NOT NULL GROUP BY b.up_to", "valid", entry=ENTRY))
def agg27_histogram(t):
    return A.delta_histogram(J.entry_delta(t.valid).withColumn("delta", F.floor(F.col("delta") / 86_400)))


@query("agg28_silence_summary", oracle("""SELECT token, gap, min("at") FILTER (n_silent / n_seen >= 0.6) AS first_quiet, round(max(n_silent / n_seen), 6) AS most FROM (SELECT g.token, x.gap, g.at, count(*) AS n_seen, count(*) FILTER (last < g.at - x.gap) AS n_silent FROM (
    SELECT s.token, s.at, f.wallet, max(f.bt) AS last FROM (SELECT token, unnest(range(t0, t1 + 1, 600)) AS at FROM (SELECT token, min(bt) AS t0, max(bt) AS t1 FROM flows GROUP BY token)) s
    JOIN flows f ON f.token = s.token AND f.bt <= s.at GROUP BY ALL) g CROSS JOIN (SELECT unnest([60, 600]) AS gap) x GROUP BY ALL) GROUP BY token, gap""", "flows"))  # fmt: skip
def agg28(t):
    return A.silence_summary(W.silence_curve(t.flows, (60, 600), 600))


@query("agg30_discovery_features", oracle("""SELECT *, CASE WHEN hold <= 5 THEN 'FAST' WHEN hold <= 60 THEN 'MID' WHEN hold IS NOT NULL THEN 'SLOW' END AS bucket, CASE WHEN hold <= 5 AND net > 0 THEN 'FAST_WIN' WHEN hold <= 5 THEN 'FAST_LOSS' END AS label FROM (SELECT wallet, token, fb AS first_buy, min(bt) FILTER (flow_direction = 'out' AND bt >= fb) AS first_sell, count(*) FILTER (flow_direction = 'out' AND bt >= fb) AS clips,
  count(*) FILTER (flow_direction = 'out' AND bt >= fb) > 1 AS partial_exit, min(signature) FILTER (flow_direction = 'in' AND bt = fb) AS first_signature, sum(CASE WHEN flow_direction = 'out' THEN lamports ELSE -lamports END)::BIGINT AS net, min(bt) FILTER (flow_direction = 'out' AND bt >= fb) - fb AS hold
  FROM (SELECT *, min(bt) FILTER (flow_direction = 'in') OVER (PARTITION BY wallet, token) AS fb FROM valid) WHERE fb IS NOT NULL GROUP BY wallet, token, fb)""", "valid"))  # fmt: skip
def agg30(t):
    return A.discovery_features(t.valid)


@query("prj13_flow_diagnostics", oracle("SELECT count(*) AS n, min(lamports) / 1e9 AS least, max(lamports) / 1e9 AS most, round(sum(lamports)::DOUBLE / count(*) / 1e9, 6) AS mean, count(*) FILTER (lamports >= 10000000000) AS n_big, round(count(*) FILTER (lamports >= 10000000000) / count(*), 6) AS big_share, count(*) - count(DISTINCT signature) AS n_repeats, max(bt) - min(bt) AS span FROM flows", "flows"))
def prj13(t):
    return A.flow_diagnostics(t.flows)
