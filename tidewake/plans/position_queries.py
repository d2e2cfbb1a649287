"""Queries over positions, rankings, sets and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import scalar as S
from tidewake.operators import aggregates as A
from tidewake.operators import joins as J
from tidewake.operators import positions as P
from tidewake.operators import rankings as R
from tidewake.operators import windows as W
from tidewake.plans import trade_queries as T
from tidewake.plans import window_queries as Q
from tidewake.plans.registry import query
from tidewake.sources.canonical import oracle

_W = "PARTITION BY wallet, token ORDER BY bt, seq, line"
SIGNED = "SELECT *, CASE WHEN flow_direction = 'in' THEN units ELSE -units END AS delta, CASE WHEN flow_direction = 'in' THEN -lamports ELSE lamports END AS sol FROM valid"
RUN = f"SELECT *, s - least(0, min(s) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS after FROM (SELECT *, sum(delta) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS s FROM signed)"
BALANCE = f"SELECT *, before + delta < 0 AS over_sold FROM (SELECT *, coalesce(lag(after) OVER ({_W}), 0) AS before FROM run)"
BOOK = f"""SELECT *, sol_in - sol_out AS net, exit - entry AS hold FROM (SELECT wallet, token, position::BIGINT AS position, min(bt) AS entry, max(bt) FILTER (before > 0 AND after = 0) AS exit, count(*) FILTER (delta > 0 AND sol < 0) AS n_buys, count(*) FILTER (delta < 0 AND sol > 0) AS n_sells,
  sum(CASE WHEN delta > 0 AND sol < 0 THEN -sol ELSE 0 END)::BIGINT AS sol_out, sum(CASE WHEN delta < 0 AND sol > 0 THEN sol ELSE 0 END)::BIGINT AS sol_in, count(*) AS n_tx, max(after)::BIGINT AS max_size, bool_or(over_sold) AS over_sold
  FROM (SELECT *, sum((before = 0 AND after > 0)::INT) OVER ({_W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS position FROM balance) WHERE before > 0 OR after > 0 GROUP BY wallet, token, position)"""
_B = {"signed": SIGNED, "run": RUN, "balance": BALANCE, "book": BOOK}


@query("win16_running_balance", oracle("SELECT signature, wallet, token, bt, seq, line, before::BIGINT AS before, after::BIGINT AS after, over_sold FROM balance", "valid", signed=SIGNED, run=RUN, balance=BALANCE))
def win16(t):
    return P.running_balance(P.signed(t.valid)).select("signature", "wallet", "token", "bt", "seq", "line", "before", "after", "over_sold")


@query("win17_positions", oracle("SELECT * FROM book", "valid", **_B))
def win17(t):
    return P.positions(P.signed(t.valid))


@query("agg31_book_metrics", oracle("""SELECT wallet, count(exit) AS n_closed, count(*) - count(exit) AS n_open, count(*) FILTER (exit IS NOT NULL AND net > 0) AS n_winners, count(*) FILTER (exit IS NOT NULL AND net <= 0) AS n_losers, coalesce(sum(net) FILTER (exit IS NOT NULL), 0) / 1e9 AS net_sol,
  round(sum(net) FILTER (exit IS NOT NULL)::DOUBLE / count(exit) / 1e9, 6) AS mean_net, max(net) FILTER (exit IS NOT NULL) / 1e9 AS best, min(net) FILTER (exit IS NOT NULL) / 1e9 AS worst, median(hold) AS median_hold FROM book GROUP BY wallet""", "valid", **_B))  # fmt: skip
def agg31(t):
    return P.book_metrics(P.positions(P.signed(t.valid)))


@query("fn18_allocate", oracle("SELECT signature, wallet, line, CASE WHEN sum(abs(delta)) OVER w > 0 THEN tx::DOUBLE * abs(delta) / sum(abs(delta)) OVER w ELSE 0 END AS share FROM (SELECT *, sum(sol) OVER (PARTITION BY signature)::BIGINT AS tx FROM signed) WINDOW w AS (PARTITION BY signature)", "valid", signed=SIGNED))
def fn18(t):
    from pyspark.sql import Window

    x = P.signed(t.valid).withColumn("sol", F.sum("sol").over(Window.partitionBy("signature")).cast("double"))
    return P.allocate(x).select("signature", "wallet", "line", "share")


@query("win14_drawdown", oracle("""SELECT wallet, sum(net) / 1e9 AS total, max(p) / 1e9 AS peak, max(p - c) / 1e9 AS max_drawdown FROM (SELECT *, greatest(0, max(c) OVER (PARTITION BY wallet ORDER BY exit, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS p FROM (
  SELECT *, sum(net) OVER (PARTITION BY wallet ORDER BY exit, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM closed)) GROUP BY wallet""", "valid", recon=T.RECON, closed=T.CLOSED))  # fmt: skip
def win14(t):
    return P.drawdown(T.closed(t))


NAMED = "SELECT *, wallet || ':' || token AS trade FROM closed"


def named_trades(t):
    return T.closed(t).select(F.concat_ws(":", "wallet", "token").alias("trade"), "net", "hold", "roi")


@query("top2_winners_losers", oracle("SELECT trade, net, 'winner' AS side FROM (SELECT * FROM named ORDER BY net DESC, trade LIMIT 11) UNION ALL SELECT trade, net, 'loser' FROM (SELECT * FROM named ORDER BY net, trade LIMIT 10)", "valid", recon=T.RECON, closed=T.CLOSED, named=NAMED))
def top2(t):
    return R.winners_and_losers(named_trades(t).select("trade", "net"), 21)


_ROI = "CASE " + " ".join(f"WHEN roi <= {b} THEN '{n}'" for b, n in S.ROI_BUCKETS) + " ELSE 'extreme' END"
ORDER = ("extreme", "very_good", "good", "mid", "mid_loss", "big_loss")


@query("top3_probes", oracle(f"""SELECT trade, bucket, hold FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY hold, trade) AS k FROM (SELECT *, {_ROI} AS bucket FROM named))
  ORDER BY k > 1, CASE WHEN k = 1 THEN list_position({list(ORDER)}, bucket) END, hold, trade LIMIT 12""", "valid", recon=T.RECON, closed=T.CLOSED, named=NAMED))  # fmt: skip
def top3(t):
    x = named_trades(t).withColumn("bucket", S.roi_bucket(F.col("roi"))).select("trade", "bucket", "hold")
    return R.probes(x, 12, ORDER)


@query("fn7_roi_buckets", oracle(f"SELECT {_ROI} AS bucket, count(*) AS n FROM closed GROUP BY bucket", "valid", recon=T.RECON, closed=T.CLOSED))
def fn7(t):
    return T.closed(t).groupBy(S.roi_bucket(F.col("roi")).alias("bucket")).agg(F.count("*").alias("n"))


@query("top4_wallets_by_volume", oracle("SELECT token, wallet, lamports, rank::INT AS rank FROM (SELECT token, wallet, sum(lamports)::BIGINT AS lamports, row_number() OVER (PARTITION BY token ORDER BY sum(lamports) DESC, wallet) AS rank FROM flows GROUP BY token, wallet) WHERE rank <= 10", "flows"))
def top4(t):
    return R.top(t.flows.groupBy("token", "wallet").agg(F.sum("lamports").alias("lamports")), ("token",), [F.desc("lamports"), F.asc("wallet")], 10)


@query("top5_early_buyers", oracle("SELECT token, wallet, first_buy, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY first_buy, wallet) AS rank FROM fb WHERE NOT EXISTS (SELECT 1 FROM cr WHERE cr.token = fb.token AND cr.wallet = fb.wallet)) WHERE rank <= 5", "valid", fb=T.FB, cr="SELECT token, arg_min(wallet, (bt, signature, wallet)) AS wallet FROM valid GROUP BY token"))
def top5(t):
    creators = t.valid.groupBy("token").agg(F.min(F.struct("bt", "signature", "wallet")).alias("x")).select("token", F.col("x.wallet").alias("wallet"))
    return R.top(J.first_buys(t.valid).join(creators.hint("merge"), ["token", "wallet"], "left_anti"), ("token",), [F.asc("first_buy"), F.asc("wallet")], 5).select("token", "wallet", "first_buy", "rank")


@query("top7_largest_trades", oracle("SELECT signature, lamports, bt, line FROM valid ORDER BY lamports DESC, bt, signature, wallet LIMIT 10", "valid"))
def top7(t):
    return t.valid.orderBy(F.desc("lamports"), "bt", "signature", "wallet").limit(10).select("signature", "lamports", "bt", "line")


def co_wallet_leaders(anchors, buys):
    """The 20 wallets that bought the most tokens within six hours of an anchor's buy."""
    a = anchors.select(F.col("wallet").alias("anchor"), "token", F.col("bt").alias("at"))
    x = J.interval(a, buys.select("token", "wallet", "bt"), 21_600, 21_600).where("wallet <> anchor")
    return x.groupBy("wallet").agg(F.countDistinct("token").alias("n_tokens")).orderBy(F.desc("n_tokens"), "wallet").limit(20)


@query("top9_co_wallet_leaders", oracle("SELECT wallet, n_tokens FROM (SELECT b.wallet, count(DISTINCT a.token) AS n_tokens FROM buys a JOIN buys b ON a.token = b.token AND b.wallet <> a.wallet AND b.bt BETWEEN a.bt - 21600 AND a.bt + 21600 GROUP BY b.wallet) ORDER BY n_tokens DESC, wallet LIMIT 20", "valid", buys=T.BUYS))
def top9(t):
    buys = t.valid.where("flow_direction = 'in'")
    return co_wallet_leaders(buys, buys)


@query("set1_seeds_and_neighbours", oracle("SELECT wallet FROM seeds UNION SELECT neighbour FROM both_ JOIN seeds USING (wallet)", "valid", "edges", both_=T.BOTH, seeds=T.SEEDS))
def set1(t):
    return T.wallets(t).union(J.neighbour_wallets(t.edges, T.wallets(t), 2 * t.parts("lineitem"))).distinct()


_SHARED = "SELECT a.wallet AS a, b.wallet AS b, count(*) AS n FROM fb a JOIN fb b ON a.token = b.token AND a.wallet < b.wallet GROUP BY ALL"


@query("set2_token_intersection", oracle(_SHARED, "valid", fb0=T.FB, leaders=T.LEADERS.replace("fb", "fb0"), fb="SELECT * FROM fb0 WHERE wallet IN (SELECT wallet FROM leaders)"))
def set2(t):
    return R.intersection_size(J.first_buys(t.valid).join(F.broadcast(T.leaders(t)), "wallet", "left_semi"))


@query("set2_token_intersection_all", oracle(_SHARED, "valid", fb=T.FB))
def set2_all(t):
    return R.intersection_size(J.first_buys(t.valid))


@query("set3_late_wallets", oracle("SELECT DISTINCT token, wallet FROM flows EXCEPT SELECT token, wallet FROM (SELECT token, wallet, min(bt) AS a FROM flows GROUP BY token, wallet) JOIN (SELECT token, min(bt) AS t0 FROM flows GROUP BY token) USING (token) WHERE a - t0 <= 300", "flows"))
def set3(t):
    return t.flows.select("token", "wallet").distinct().join(W.early_wallets(t.flows).select("token", "wallet").hint("merge"), ["token", "wallet"], "left_anti")


@query("set4_first_by_signature", oracle("SELECT signature, wallet, token, bt FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY bt, wallet, token, lamports) AS n FROM trades) WHERE n = 1", "trades"))
def set4(t):
    return R.first_by(t.trades, "signature", [F.asc("bt"), F.asc("wallet"), F.asc("token"), F.asc("lamports")]).select("signature", "wallet", "token", "bt")


@query("fn13_capital_verdict", oracle("""SELECT token, CASE WHEN net > 0 THEN 'INFLOW_' || s WHEN net < 0 THEN 'OUTFLOW_' || s ELSE 'NEUTRAL' END AS verdict FROM (SELECT token, net, CASE WHEN vol > 0 AND abs(net) / vol >= 0.15 THEN 'STRONG' ELSE 'WEAK' END AS s FROM (
  SELECT token, sum(CASE WHEN direction = 'buy' THEN lamports ELSE -lamports END) AS net, sum(lamports) AS vol FROM flows GROUP BY token))""", "flows"))  # fmt: skip
def fn13(t):
    x = t.flows.groupBy("token").agg(F.sum(F.when(F.col("direction") == "buy", F.col("lamports")).otherwise(-F.col("lamports"))).alias("net"), F.sum("lamports").alias("vol"))
    return x.select("token", S.capital_verdict(F.col("net"), F.col("vol")).alias("verdict"))


@query("fn2_iso_times", oracle("SELECT signature, strftime(to_timestamp(bt) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at_iso, bt AS back FROM flows", "flows"))
def fn2(t):
    x = t.flows.select("signature", S.iso_utc(F.col("bt")).alias("at_iso"))
    return x.withColumn("back", S.epoch_seconds(F.col("at_iso")))


@query("fn4_sol_text", oracle("SELECT signature, printf('%.9f', (lamports / 1000000000)::DOUBLE) AS sol FROM flows", "flows"))
def fn4(t):
    return t.flows.select("signature", S.sol_text(F.col("lamports")).alias("sol"))


@query("fn8_confidence", oracle("SELECT signature, (round_even(greatest(35.0, least(lamports / 1e9, 95.0)) / 5, 0) * 5)::INT AS confidence FROM flows", "flows"))
def fn8(t):
    return t.flows.select("signature", S.confidence(F.col("lamports") / 1e9).alias("confidence"))


FACTS = f"""SELECT f.signature, f.token, f.wallet, f.bt, f.seq, sum(CASE WHEN direction = 'buy' THEN lamports ELSE 0 END) OVER (PARTITION BY token, wallet ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1e9 AS bought,
  sum(CASE WHEN direction = 'sell' THEN lamports ELSE 0 END) OVER (PARTITION BY token, wallet ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) / 1e9 AS sold,
  count(*) OVER w3 >= 2 AND sum(CASE WHEN direction = 'sell' THEN lamports ELSE -lamports END) OVER w3 > 0 AS leaning FROM flows f WINDOW w3 AS (PARTITION BY token, wallet ORDER BY bt, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""
NETS = "SELECT f.signature, (sum(CASE WHEN p.bt >= f.bt - 120 THEN p.x ELSE 0 END) / 1e9)::DOUBLE AS net_2m FROM f JOIN f p ON f.token = p.token AND f.wallet = p.wallet AND p.n BETWEEN f.n - 19 AND f.n GROUP BY f.signature"
VERDICT = """SELECT a.*, CASE WHEN bought > 0 AND sold >= bought * 0.30::DOUBLE AND leaning AND net_2m < 0 THEN 'FLIPPING' WHEN sold > bought THEN 'DISTRIBUTING' WHEN bought > sold AND net_2m > 0 THEN 'ACCUMULATING' WHEN bought > sold THEN 'BUILDING' ELSE 'INACTIVE' END AS verdict,
  CASE WHEN bought + sold >= 50 THEN 3 WHEN bought + sold >= 25 THEN 2 WHEN bought + sold >= 10 THEN 1 ELSE 0 END AS tier FROM facts a JOIN nets USING (signature)"""
_V = {"f": Q.NUMBERED, "facts": FACTS, "nets": NETS, "verdicts": VERDICT}


def verdicts(t):
    """Verdict and tier of the acting wallet at each of its flows."""
    from pyspark.sql import Window

    w3 = Window.partitionBy("token", "wallet").orderBy("bt", "seq").rowsBetween(-2, 0)
    lean = F.sum(F.when(F.col("direction") == "sell", F.col("lamports")).otherwise(-F.col("lamports"))).over(w3)
    x = W.direction_history(W.running_totals(t.flows)).withColumn("_lean", (F.count("*").over(w3) >= 2) & (lean > 0))
    bought, sold = W.sol(F.col("bought")), W.sol(F.col("sold"))
    verdict = S.whale_verdict(F.col("bt"), F.col("bt"), F.lit(0), F.lit(False), bought, sold, F.col("_lean"), F.col("net_2m"))
    return x.select("signature", "token", "wallet", "bt", "seq", bought.alias("bought"), sold.alias("sold"), verdict.alias("verdict"), S.whale_tier(bought + sold).alias("tier"))


@query("fn16_whale_verdicts", oracle("SELECT signature, verdict, tier::INT AS tier FROM verdicts", "flows", **_V))
def fn16(t):
    return verdicts(t).select("signature", "verdict", "tier")


_FINAL = """SELECT token, wallet, CASE WHEN last < mid AND now - last > 120 THEN 'GONE' WHEN carried THEN 'GONE' WHEN now - last > 120 THEN 'INACTIVE' WHEN bought > 0 AND sold >= bought * 0.30::DOUBLE AND lean > 0 AND k >= 2 AND net < 0 THEN 'FLIPPING' WHEN sold > bought THEN 'DISTRIBUTING'
  WHEN bought > sold AND net > 0 THEN 'ACCUMULATING' WHEN bought > sold THEN 'BUILDING' ELSE 'INACTIVE' END AS verdict FROM (SELECT m.token, m.wallet, now, mid, max(m.bt) AS last, arg_max(carried, (m.bt, m.seq)) AS carried, sum(CASE WHEN direction = 'buy' THEN lamports ELSE 0 END) / 1e9 AS bought, sum(CASE WHEN direction = 'buy' THEN 0 ELSE lamports END) / 1e9 AS sold,
    coalesce(sum(CASE WHEN direction = 'buy' THEN lamports ELSE -lamports END) FILTER (m.bt >= now - 120), 0) AS net, sum(CASE WHEN direction = 'sell' THEN lamports ELSE -lamports END) FILTER (r <= 3) AS lean, count(*) AS k
    FROM (SELECT *, row_number() OVER (PARTITION BY token, wallet ORDER BY bt DESC, seq DESC) AS r FROM marked) m JOIN (SELECT token, max(bt) AS now, (min(bt) + max(bt)) // 2 AS mid FROM flows GROUP BY token) USING (token) GROUP BY ALL)"""


@query("fn16_final_verdicts", oracle(_FINAL, "flows", marked=Q._MARKED))
def fn16_final(t):
    """What every wallet of a token is doing at the token's last flow; a wave began in the middle of its time."""
    from pyspark.sql import Window

    last = Window.partitionBy("token", "wallet").orderBy(F.desc("bt"), F.desc("seq"))
    span = t.flows.groupBy("token").agg(F.max("bt").alias("now"), F.floor((F.min("bt") + F.max("bt")) / 2).alias("mid"))
    x = W.silence_carried(t.flows).withColumn("_r", F.row_number().over(last)).join(span.hint("merge"), "token")
    signed = F.when(F.col("direction") == "buy", F.col("lamports")).otherwise(-F.col("lamports"))
    side = lambda d: W.sol(F.sum(F.when(F.col("direction") == d, F.col("lamports")).otherwise(0)))
    x = x.groupBy("token", "wallet", "now", "mid").agg(
        F.max("bt").alias("last"), F.max_by("carried", F.struct("bt", "seq")).alias("carried"), side("buy").alias("bought"), side("sell").alias("sold"), F.sum(F.when(F.col("bt") >= F.col("now") - 120, signed).otherwise(0)).alias("net"),
        (-F.sum(F.when(F.col("_r") <= 3, signed))).alias("lean"), F.count("*").alias("k"),
    )
    verdict = S.whale_verdict(F.col("last"), F.col("now"), F.col("mid"), F.col("carried"), F.col("bought"), F.col("sold"), (F.col("lean") > 0) & (F.col("k") >= 2), F.col("net"))
    return x.select("token", "wallet", verdict.alias("verdict"))


@query("win28_verdict_flips", oracle("SELECT signature, token, wallet, previous FROM (SELECT *, lag(verdict) OVER (PARTITION BY token, wallet ORDER BY bt, seq) AS previous FROM verdicts) WHERE previous IN ('ACCUMULATING', 'BUILDING') AND verdict = 'FLIPPING'", "flows", **_V))
def win28(t):
    return W.verdict_flips(verdicts(t)).select("signature", "token", "wallet", "previous")


_PRI = "CASE verdict " + " ".join(f"WHEN '{v}' THEN {k}" for k, v in enumerate(S.VERDICT_ORDER, 1)) + " ELSE 7 END"


@query("top6_whale_ranking", oracle(f"""SELECT token, wallet, verdict, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY {_PRI}, abs(bought - sold) DESC, tier DESC, wallet) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY token, wallet ORDER BY bt DESC, seq DESC) AS n FROM verdicts) WHERE n = 1) WHERE rank <= 8""", "flows", **_V))  # fmt: skip
def top6(t):
    last = R.top(verdicts(t), ("token", "wallet"), [F.desc("bt"), F.desc("seq")], 1, "_n").withColumn("net", F.col("bought") - F.col("sold"))
    return R.whale_ranking(last, S.verdict_priority(F.col("verdict"))).select("token", "wallet", "verdict", "rank")


@query("agg13_seed_metrics", oracle("""SELECT s.wallet, median(e.n) AS attempts_median, quantile_disc(e.n, 0.9) AS attempts_p90, count(*) AS n_episodes FROM (SELECT DISTINCT wallet FROM flows) s JOIN (SELECT wallet, token, direction, episode, count(*) AS n FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR bt - prev > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY wallet, token, direction ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode FROM (SELECT *, lag(bt) OVER (PARTITION BY wallet, token, direction ORDER BY bt, seq) AS prev FROM flows)) GROUP BY ALL) e USING (wallet) GROUP BY s.wallet""", "flows"))  # fmt: skip
def agg13(t):
    from tidewake.plans.network import episode_metrics

    return episode_metrics(t.flows, t.parts("events"))


@query("fn17_seed_verdicts")
def fn17(t):
    """Composition of the network report; its parts have oracles of their own."""
    from tidewake.plans.network import network_report

    return network_report(t.valid, t.edges, t.members, T.wallets(t), parts=t.parts("lineitem"))
