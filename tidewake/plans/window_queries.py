"""Queries over windows of flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import scalar
from tidewake.operators import windows as W
from tidewake.plans.registry import query
from tidewake.sources.canonical import oracle

_R = "PARTITION BY token, wallet ORDER BY bt RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
_LATER = "coalesce(sum(lamports) OVER (PARTITION BY token, wallet, bt ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0)"
ROLLING = f"SELECT *, sum(lamports) OVER ({_R.format(300)}) - {_LATER} AS sum_5m, sum(lamports) OVER ({_R.format(900)}) - {_LATER} AS sum_15m FROM flows"
_CROSS = """SELECT token, wallet, bt, seq, direction, event_type, amount_sol, threshold FROM (SELECT *, row_number() OVER (PARTITION BY token, wallet, event_type ORDER BY bt, seq) AS n FROM (
  SELECT token, wallet, bt, seq, direction, 'WHALE_TX' AS event_type, lamports / 1e9 AS amount_sol, {0}::DOUBLE AS threshold FROM {3} UNION ALL
  SELECT token, wallet, bt, seq, direction, 'WHALE_CUM_5M', sum_5m / 1e9, {1}::DOUBLE FROM {3} UNION ALL SELECT token, wallet, bt, seq, direction, 'WHALE_CUM_15M', sum_15m / 1e9, {2}::DOUBLE FROM {3})
  WHERE amount_sol >= threshold) WHERE n = 1"""
CROSSINGS = _CROSS.format("10", "25", "50", "rolling")
FIRST_EVENT = "SELECT token, wallet, bt, seq, direction FROM (SELECT *, row_number() OVER (PARTITION BY token, wallet, seq ORDER BY event_type) AS k FROM crossings) WHERE k = 1"


@query("win1_rolling_sums", oracle("SELECT signature, token, wallet, sum_5m / 1e9 AS sol_5m, sum_15m / 1e9 AS sol_15m FROM rolling", "flows", rolling=ROLLING))
def win1(t):
    return W.rolling_sums(t.flows).select("signature", "token", "wallet", W.sol(F.col("sum_5m")).alias("sol_5m"), W.sol(F.col("sum_15m")).alias("sol_15m"))


@query("win2_whale_crossings", oracle("SELECT * FROM crossings", "flows", rolling=ROLLING, crossings=CROSSINGS))
def whale_crossings(t):
    return W.whale_crossings(t.flows)


DYNAMIC = """SELECT token, greatest(0.1, least(pool * 0.005, 100.0)) AS whale_tx, greatest(0.5, least(pool * 0.01, 250.0)) AS whale_5m, greatest(1.0, least(pool * 0.02, 500.0)) AS whale_15m
  FROM (SELECT token, CASE WHEN count(u) > 0 THEN greatest(5.0, least(sum(u) / count(u) / 1e9 / 0.01, 10000.0)) ELSE 50.0 END AS pool FROM (SELECT *, CASE WHEN lamports > 10000000 AND lamports < 1000000000000 THEN lamports END AS u, row_number() OVER (PARTITION BY token ORDER BY bt, seq) AS n FROM flows) WHERE n <= 20 GROUP BY token)"""


@query("fn6_dynamic_thresholds", oracle("SELECT * FROM dynamic", "flows", dynamic=DYNAMIC))
def fn6(t):
    return scalar.dynamic_thresholds(scalar.liquidity_estimate(t.flows))


@query("win2_dynamic_crossings", oracle("SELECT * FROM (" + _CROSS.format("whale_tx", "whale_5m", "whale_15m", "rolling JOIN dynamic USING (token)") + ")", "flows", rolling=ROLLING, dynamic=DYNAMIC))
def win2_dynamic(t):
    return W.whale_crossings(t.flows, per_token=scalar.dynamic_thresholds(scalar.liquidity_estimate(t.flows)))


EPISODES = """SELECT *, sum(CASE WHEN prev IS NULL OR bt - prev > {0} THEN 1 ELSE 0 END) OVER (PARTITION BY token ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode
  FROM (SELECT *, lag(bt) OVER (PARTITION BY token ORDER BY bt, seq) AS prev FROM rolling)"""


@query("win3_crossings_by_episode", oracle("SELECT token, wallet, episode::BIGINT AS episode, bt, seq, event_type, amount_sol FROM (" + _CROSS.format("10", "25", "50", "ep").replace("token, wallet, bt", "token, wallet, episode, bt").replace("BY token, wallet, event_type", "BY token, wallet, episode, event_type") + ")", "flows", rolling=ROLLING, ep=EPISODES.format(60)))
def win3(t):
    from tidewake.operators.episodes import token_episodes

    x = W.whale_crossings(token_episodes(t.flows, 60), scope=("episode",))
    return x.select("token", "wallet", "episode", "bt", "seq", "event_type", "amount_sol")


@query("win4_running_totals", oracle("""SELECT signature, min(bt) OVER w AS first_seen, max(bt) OVER w AS last_seen, count(*) OVER w AS n_flows,
  sum(CASE WHEN direction = 'buy' THEN lamports ELSE 0 END) OVER w / 1e9 AS bought_sol, sum(CASE WHEN direction = 'sell' THEN lamports ELSE 0 END) OVER w / 1e9 AS sold_sol FROM flows
  WINDOW w AS (PARTITION BY token, wallet ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""", "flows"))  # fmt: skip
def win4(t):
    return W.running_totals(t.flows).select("signature", "first_seen", "last_seen", "n_flows", W.sol(F.col("bought")).alias("bought_sol"), W.sol(F.col("sold")).alias("sold_sol"))


NET = """SELECT signature, token, wallet, bt, seq, sum(CASE WHEN p.bt >= f.bt - 120 THEN p.x ELSE 0 END) AS net_2m FROM f JOIN (SELECT token, wallet, bt, n, x FROM f) p USING (token, wallet) WHERE p.n BETWEEN f.n - 19 AND f.n GROUP BY ALL"""
NUMBERED = "SELECT *, CASE WHEN direction = 'buy' THEN lamports ELSE -lamports END AS x, row_number() OVER (PARTITION BY token, wallet ORDER BY bt, seq) AS n FROM flows"


@query("win5_net_delta", oracle("""SELECT f.signature, (sum(CASE WHEN p.bt >= f.bt - 120 THEN p.x ELSE 0 END) / 1e9)::DOUBLE AS net_sol FROM f JOIN f p ON f.token = p.token AND f.wallet = p.wallet AND p.n BETWEEN f.n - 19 AND f.n
  GROUP BY f.signature""", "flows", f=NUMBERED))  # fmt: skip
def win5(t):
    return W.direction_history(t.flows).select("signature", W.sol(F.col("net_2m")).alias("net_sol"))


@query("win6_sell_majority", oracle("""SELECT signature, (sum((direction = 'sell')::INT) OVER w >= 2 AND sum(CASE WHEN direction = 'sell' THEN lamports ELSE 0 END) OVER w > sum(CASE WHEN direction = 'buy' THEN lamports ELSE 0 END) OVER w) AS sell_confirmed
  FROM flows WINDOW w AS (PARTITION BY token, wallet ORDER BY bt, seq ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)""", "flows"))  # fmt: skip
def win6(t):
    return W.sell_majority(t.flows).select("signature", "sell_confirmed")


_D = "PARTITION BY token ORDER BY bt RANGE BETWEEN {} PRECEDING AND CURRENT ROW"
DENSITY = f"SELECT *, count(DISTINCT wallet) OVER ({_D.format(120)}) AS n_wallets FROM flows WHERE lamports >= 10000000000"


@query("win7_whale_density", oracle("SELECT signature, token, n_wallets, n_wallets / 120.0::DOUBLE AS density FROM d", "flows", d=DENSITY))
def win7(t):
    x = W.distinct_in_range(t.flows.where("lamports >= 10000000000"), 120)
    return x.select("signature", "token", "n_wallets", (F.col("n_wallets") / F.lit(120.0)).alias("density"))


@query("win8_density_maximum", oracle("SELECT signature, n_wallets, prior_max, coalesce(n_wallets > prior_max, true) AS is_max FROM (SELECT *, max(n_wallets) OVER (PARTITION BY token ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior_max FROM d)", "flows", d=DENSITY))
def win8(t):
    x = W.prior_maximum(W.distinct_in_range(t.flows.where("lamports >= 10000000000"), 120), "n_wallets")
    return x.select("signature", "n_wallets", "prior_max", F.coalesce(F.col("n_wallets") > F.col("prior_max"), F.lit(True)).alias("is_max"))


@query("win9_coordination", oracle("""SELECT seq, token, bt, array_to_string(list_sort(list_distinct(ws)), ',') AS wallets, CASE WHEN len(list_distinct(ds)) > 1 THEN 'mixed' ELSE ds[1] END AS side FROM (
  SELECT seq, token, bt, list(wallet) OVER w AS ws, list(direction) OVER w AS ds FROM f WINDOW w AS (PARTITION BY token ORDER BY bt RANGE BETWEEN 60 PRECEDING AND CURRENT ROW)) WHERE len(list_distinct(ws)) >= 3""", "flows", rolling=ROLLING, crossings=CROSSINGS, f=FIRST_EVENT))  # fmt: skip
def win9(t):
    first = W.whale_crossings(t.flows).groupBy("token", "wallet", "bt", "seq", "direction").agg(F.min("event_type").alias("event_type"))
    x = W.coordination(first)
    return x.select("seq", "token", "bt", F.array_join("wallets", ",").alias("wallets"), "side")


_PERS = """SELECT token, wallet, count(*) AS n_minutes, max(gap) AS max_gap, max(minute) - min(minute) AS span FROM (SELECT *, minute - lag(minute) OVER (PARTITION BY token, wallet ORDER BY minute) AS gap
  FROM (SELECT DISTINCT token, wallet, bt // 60 * 60 AS minute FROM flows)) GROUP BY token, wallet HAVING count(*) >= 2 AND {} <= {}"""


@query("win10_persistence", oracle(_PERS.format("max(gap)", 20000), "flows"))
def win10(t):
    return W.persistence(t.flows, gap=20000)


@query("win10_persistence_span", oracle(_PERS.format("max(minute) - min(minute)", 40000), "flows"))
def win10_span(t):
    return W.persistence(t.flows, gap=40000, mode="span")


@query("win11_episodes", oracle("""SELECT wallet, token, direction, episode::BIGINT AS episode, min(bt) AS start_bt, max(bt) AS end_bt, count(*) AS n_flows, sum(lamports)::BIGINT AS lamports FROM (
  SELECT *, sum(CASE WHEN prev IS NULL OR bt - prev > 90 THEN 1 ELSE 0 END) OVER (PARTITION BY wallet, token, direction ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode
  FROM (SELECT *, lag(bt) OVER (PARTITION BY wallet, token, direction ORDER BY bt, seq) AS prev FROM flows)) GROUP BY ALL""", "flows"))  # fmt: skip
def win11(t):
    return W.episodes(t.flows, parts=t.parts("events"))


@query("win12_activity_gaps", oracle("SELECT wallet, count(gap) AS n_gaps, max(gap) AS max_gap, median(gap) AS median_gap FROM (SELECT wallet, bt - lag(bt) OVER (PARTITION BY wallet ORDER BY bt, seq) AS gap FROM flows) WHERE gap IS NOT NULL GROUP BY wallet", "flows"))
def win12(t):
    return W.activity_gaps(t.flows).groupBy("wallet").agg(F.count("gap").alias("n_gaps"), F.max("gap").alias("max_gap"), F.median("gap").alias("median_gap"))


@query("win13_peak_rate", oracle("SELECT token, direction, max(n) AS peak FROM (SELECT token, direction, count(*) OVER (PARTITION BY token, direction ORDER BY bt RANGE BETWEEN 10 PRECEDING AND CURRENT ROW) AS n FROM flows) GROUP BY token, direction", "flows"))
def win13(t):
    return W.peak_rate(t.flows)


@query("win15_longest_run", oracle("""SELECT wallet, direction, max(n) AS longest FROM (SELECT wallet, direction, island, count(*) AS n FROM (SELECT *, row_number() OVER (PARTITION BY wallet ORDER BY bt, seq) - row_number() OVER (PARTITION BY wallet, direction ORDER BY bt, seq) AS island FROM flows)
  GROUP BY ALL) GROUP BY wallet, direction""", "flows"))  # fmt: skip
def win15(t):
    return W.longest_run(t.flows)


@query("win18_early_wallets", oracle("SELECT token, wallet, first_seen, t0, first_seen - t0 AS delta FROM (SELECT token, wallet, min(bt) AS first_seen FROM flows GROUP BY token, wallet) JOIN (SELECT token, min(bt) AS t0 FROM flows GROUP BY token) USING (token) WHERE first_seen - t0 BETWEEN 0 AND 3600", "flows"))
def win18(t):
    return W.early_wallets(t.flows, 3600)


@query("win19_silence_curve", oracle("""SELECT g.token, x.gap, g.at, count(*) AS n_seen, count(*) FILTER (last < g.at - x.gap) AS n_silent FROM (
    SELECT s.token, s.at, f.wallet, max(f.bt) AS last FROM (SELECT token, unnest(range(t0, t1 + 1, 600)) AS at FROM (SELECT token, min(bt) AS t0, max(bt) AS t1 FROM flows GROUP BY token)) s
    JOIN flows f ON f.token = s.token AND f.bt <= s.at GROUP BY ALL) g CROSS JOIN (SELECT unnest([60, 120, 900]) AS gap) x GROUP BY ALL""", "flows"))  # fmt: skip
def win19(t):
    return W.silence_curve(t.flows, (60, 120, 900), 600)


# a wallet turns silent once the token is active more than 120 s after its last flow; only a buy makes it active again
_MARKED = """SELECT *, lead(bt) OVER (PARTITION BY token, wallet ORDER BY bt, seq) AS next_bt, direction = 'sell' AND max(turned) OVER (PARTITION BY token, wallet, island ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS carried FROM (
  SELECT *, direction = 'sell' AND coalesce(before > own + 120, false) AS turned, count(*) FILTER (direction = 'buy') OVER (PARTITION BY token, wallet ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM (
  SELECT *, lag(bt) OVER (PARTITION BY token ORDER BY bt, seq) AS before, lag(bt) OVER (PARTITION BY token, wallet ORDER BY bt, seq) AS own FROM flows))"""


@query("win20_cohort_silence", oracle("""SELECT f.signature, f.token, n_recent, n_seen, n_silent FROM flows f JOIN (SELECT t.token, t.bt, count(*) FILTER (m.bt >= t.bt - 120) AS n_recent, count(*) AS n_seen, count(*) FILTER (m.bt < t.bt - 120 OR m.carried) AS n_silent
  FROM (SELECT DISTINCT token, bt FROM flows) t JOIN marked m ON m.token = t.token AND m.bt <= t.bt AND (m.next_bt IS NULL OR m.next_bt > t.bt) GROUP BY t.token, t.bt) x USING (token, bt)""", "flows", marked=_MARKED))
def win20(t):
    return W.cohort_silence(t.flows).select("signature", "token", "n_recent", "n_seen", "n_silent")


PEAK = "SELECT token, bt AS \"at\" FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY lamports DESC, bt, seq) AS n FROM flows) WHERE n = 1"


def peaks(t):
    return t.flows.groupBy("token").agg(F.min(F.struct(-F.col("lamports"), "bt")).alias("x")).select("token", F.col("x.bt").alias("at"))


@query("win21_stopped_before_peak", oracle('SELECT token, "at", wallet, max(bt) AS last_seen FROM flows JOIN p USING (token) WHERE bt <= "at" GROUP BY ALL HAVING max(bt) < "at" - 120', "flows", p=PEAK))
def win21(t):
    return W.stopped_before(t.flows, peaks(t))


@query("win22_activity_drop", oracle("""SELECT signature, n AS n_flows, age, r AS n_recent, CASE WHEN n < 5 THEN 'FEW_TRADES' WHEN age < 300 THEN 'SHORT_HISTORY' WHEN r < 2 THEN 'NO_RECENT' WHEN r / 180.0::DOUBLE <= n / age * (1 - 0.85::DOUBLE) THEN 'DROP' ELSE 'STEADY' END AS reason FROM (
  SELECT *, count(*) OVER w AS n, bt - min(bt) OVER w AS age, count(*) OVER (PARTITION BY token, wallet ORDER BY bt RANGE BETWEEN 180 PRECEDING AND CURRENT ROW) AS r FROM flows
  WINDOW w AS (PARTITION BY token, wallet ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))""", "flows"))  # fmt: skip
def win22(t):
    return W.activity_drop(t.flows).select("signature", "n_flows", "age", "n_recent", "reason")


@query("win23_fixed_silence", oracle('SELECT token, "at", count(*) AS n_wallets, count(*) FILTER ("at" - last >= 540) AS n_silent FROM (SELECT token, "at", wallet, max(bt) AS last FROM flows JOIN p USING (token) WHERE bt <= "at" GROUP BY ALL) GROUP BY token, "at"', "flows", p=PEAK))
def win23(t):
    return W.fixed_silence(t.flows, peaks(t))


@query("win24_replacement", oracle("""SELECT p.token, p."at", coalesce(bool_or(f.bt > p."at" - 300), false) AS replaced FROM p LEFT JOIN (SELECT f.* FROM flows f ANTI JOIN e ON f.token = e.token AND f.wallet = e.wallet) f ON f.token = p.token AND f.bt <= p."at" GROUP BY p.token, p."at" """,
    "flows", p=PEAK, e="SELECT token, wallet FROM (SELECT token, wallet, min(bt) AS a FROM flows GROUP BY token, wallet) JOIN (SELECT token, min(bt) AS t0 FROM flows GROUP BY token) USING (token) WHERE a - t0 <= 3600"))
def win24(t):
    return W.replacement(t.flows, W.early_wallets(t.flows, 3600), peaks(t))


@query("win29_quiet_markers", oracle("SELECT signature, token, gap, gap // 60 AS quiet_minutes FROM (SELECT *, bt - lag(bt) OVER (PARTITION BY token ORDER BY bt, seq) AS gap FROM flows) WHERE gap > 60", "flows"))
def win29(t):
    return W.quiet_markers(t.flows).select("signature", "token", "gap", "quiet_minutes")
