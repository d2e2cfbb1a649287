"""Queries over the life cycle of tokens, archetype scores, scans and audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.operators import archetype as R
from tidewake.operators import machine as M
from tidewake.operators.episodes import token_episodes
from tidewake.plans.registry import query
from tidewake.sources import ingest as I
from tidewake.sources.canonical import oracle
from tidewake.sources.shared import kept


@query("st4_transitions")
def st4(t):
    return M.transitions(t.flows)


@query("st7_waves")
def st7(t):
    return M.waves(M.transitions(t.flows))


@query("st10_entry_signals")
def st10(t):
    return M.entry_signals(M.transitions(t.flows)).select("token", "episode", "bt", "n", "severity")


@query("st3_episodes", oracle("""SELECT token, episode::BIGINT AS episode, min(bt) AS start_bt, max(bt) AS end_bt, count(*) AS n_flows FROM (SELECT *, sum(CASE WHEN prev IS NULL OR bt - prev > 60 THEN 1 ELSE 0 END) OVER (PARTITION BY token ORDER BY bt, seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS episode
  FROM (SELECT *, lag(bt) OVER (PARTITION BY token ORDER BY bt, seq) AS prev FROM flows)) GROUP BY token, episode""", "flows"))  # fmt: skip
def st3(t):
    return token_episodes(t.flows, 60).groupBy("token", "episode").agg(F.min("bt").alias("start_bt"), F.max("bt").alias("end_bt"), F.count("*").alias("n_flows"))


@query("st6_first_ignition", oracle("SELECT token, t0, bt, wallet FROM (SELECT f.token, t0, bt, wallet, row_number() OVER (PARTITION BY f.token ORDER BY bt, seq) AS n FROM flows f JOIN (SELECT token, min(bt) AS t0 FROM flows GROUP BY token) USING (token) WHERE bt - t0 <= 300) WHERE n = 1", "flows"))
def st6(t):
    return M.first_ignition(t.flows)


COHORTS = "SELECT token, bt // 7200 AS wave, count(DISTINCT wallet) FILTER (lamports >= 20000000000) AS n FROM flows GROUP BY ALL"


@query("win26_wave_trend", oracle("""SELECT token, wave, n, peak, peak_wave, CASE WHEN cliff THEN 'COLLAPSING' WHEN coalesce(bool_or(cliff) OVER (PARTITION BY token ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AND n < peak * 0.30::DOUBLE AND trend = 'BUILDING' THEN 'GHOST' ELSE trend END AS trend, cliff FROM (
  SELECT *, CASE WHEN last IS NULL THEN CASE WHEN n >= 3 THEN 'BUILDING' ELSE 'INSUFFICIENT_DATA' END WHEN n = 0 OR last > 0 AND n < last * 0.25::DOUBLE THEN 'COLLAPSING' WHEN n < last THEN 'FADING' WHEN n = last THEN 'STABLE' ELSE 'BUILDING' END AS trend, coalesce(last > 0 AND (last - n) / last >= 0.60::DOUBLE, false) AS cliff,
    (SELECT min(c2.wave) FROM cohorts c2 WHERE c2.token = x.token AND c2.wave <= x.wave AND c2.n = x.peak) AS peak_wave FROM (
    SELECT *, lag(n) OVER (PARTITION BY token ORDER BY wave) AS last, max(n) OVER (PARTITION BY token ORDER BY wave ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS peak FROM cohorts) x)""", "flows", cohorts=COHORTS))  # fmt: skip
def win26(t):
    c = t.flows.groupBy("token", F.floor(F.col("bt") / 7200).alias("wave")).agg(F.countDistinct(F.when(F.col("lamports") >= 20_000_000_000, F.col("wallet"))).alias("n"))
    return M.wave_trend(c).drop("ghost")


_STEPS = """SELECT f.*, (bt - t0) // 600 AS step, first_bt <= t0 + 600 AS early, (first_bt - t0) // 600 = (bt - t0) // 600 AS new, direction = 'sell' AS o, top FROM flows f JOIN (SELECT token, min(bt) AS t0 FROM flows GROUP BY token) USING (token)
  JOIN (SELECT token, wallet, min(bt) AS first_bt, row_number() OVER (PARTITION BY token ORDER BY sum(lamports) DESC, wallet) <= 10 AS top FROM flows GROUP BY token, wallet) USING (token, wallet)"""


@query("win25_step_features", oracle("""SELECT x.* EXCLUDE (prev), round(pause_mad, 4) AS pause_mad, round(size_mad, 4) AS size_mad, coalesce(step - prev - 1, 0) AS quiet_before, count(*) FILTER (step - prev - 1 >= 1) OVER (PARTITION BY token ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS resurrections FROM (SELECT *, lag(step) OVER (PARTITION BY token ORDER BY step) AS prev FROM (
  SELECT token, step, count(*) AS n, sum(CASE WHEN o THEN 0 ELSE lamports END) / 1e9 AS inflow, sum(CASE WHEN o THEN lamports ELSE 0 END) / 1e9 AS outflow, count(DISTINCT wallet) FILTER (early AND new) AS early_entries, count(*) FILTER (early AND o) AS early_exits,
  count(DISTINCT wallet) FILTER (new) AS new_wallets, sum(CASE WHEN top AND o THEN lamports ELSE 0 END) / 1e9 AS top_outflow, any_value(d.density) AS density FROM s JOIN (SELECT token, step, sum(c) FILTER (r <= 10) / sum(c) AS density FROM (
    SELECT token, step, count(*) AS c, row_number() OVER (PARTITION BY token, step ORDER BY count(*) DESC, wallet) AS r FROM s GROUP BY token, step, wallet) GROUP BY token, step) d USING (token, step) GROUP BY token, step)) x
  JOIN (SELECT token, step, coalesce(avg(abs(pause - mp)), 0) AS pause_mad, avg(abs(lamports - ml)) / 1e9 AS size_mad FROM (SELECT *, avg(pause) OVER (PARTITION BY token, step) AS mp, avg(lamports) OVER (PARTITION BY token, step) AS ml FROM (SELECT *, bt - lag(bt) OVER (PARTITION BY token, step ORDER BY bt, seq) AS pause FROM s)) GROUP BY token, step) m USING (token, step)""", "flows", s=_STEPS))  # fmt: skip
def win25(t):
    return R.step_features(t.flows, 600).withColumns({c: F.round(c, 4) for c in ("pause_mad", "size_mad")}).drop("seconds")


@query("fn11_scores")
def fn11(t):
    return R.scores(R.step_features(t.flows, 600)).select("token", "step", F.round("p_plus", 4).alias("p_plus"), F.round("p_minus", 4).alias("p_minus"), F.round("risk", 6).alias("risk"), "dominant", "tempo")


@query("st14_archetype_timeline")
def st14(t):
    return R.timeline(R.scores(R.step_features(t.flows, 600)), 600)


def trade_flows(t):
    """Valid trades as flows."""
    return t.valid.select("wallet", "token", "bt", F.when(F.col("flow_direction") == "out", "sell").otherwise("buy").alias("direction"), "lamports", "signature", (F.col("seq") * 8 + F.col("line")).alias("seq"))


_WIDTHS = """SELECT token, t0, CASE WHEN n >= 3 AND least <= 20 THEN 20 ELSE 60 END AS seconds FROM (SELECT token, min(bt) AS t0, count(*) AS n, min(bt - prev) FILTER (bt > prev) AS least
  FROM (SELECT *, lag(bt) OVER (PARTITION BY token ORDER BY bt, seq, line) AS prev FROM valid) GROUP BY token)"""
_TOKEN_STEPS = """SELECT f.*, seconds, (bt - t0) // seconds AS step, first_bt <= t0 + 600 AS early, (first_bt - t0) // seconds = (bt - t0) // seconds AS new, flow_direction = 'out' AS o, top FROM valid f JOIN widths USING (token)
  JOIN (SELECT token, wallet, min(bt) AS first_bt, row_number() OVER (PARTITION BY token ORDER BY sum(lamports) DESC, wallet) <= 10 AS top FROM valid GROUP BY token, wallet) USING (token, wallet)"""


@query("win25_steps_by_token", oracle("""SELECT x.* EXCLUDE (prev), coalesce(step - prev - 1, 0) AS quiet_before, count(*) FILTER ((step - prev - 1) * seconds >= 600) OVER (PARTITION BY token ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS resurrections FROM (SELECT *, lag(step) OVER (PARTITION BY token ORDER BY step) AS prev FROM (
  SELECT token, step, any_value(seconds) AS seconds, count(*) AS n, sum(CASE WHEN o THEN 0 ELSE lamports END) / 1e9 AS inflow, sum(CASE WHEN o THEN lamports ELSE 0 END) / 1e9 AS outflow, count(DISTINCT wallet) FILTER (early AND new) AS early_entries, count(*) FILTER (early AND o) AS early_exits,
  count(DISTINCT wallet) FILTER (new) AS new_wallets, sum(CASE WHEN top AND o THEN lamports ELSE 0 END) / 1e9 AS top_outflow FROM s GROUP BY token, step)) x""", "valid", widths=_WIDTHS, s=_TOKEN_STEPS))  # fmt: skip
def win25_by_token(t):
    return R.step_features(trade_flows(t), None, parts=t.parts("lineitem"), mads=False, density=False)


def trade_scores(t, step: int | None = None):
    """Steps of the traded tokens, as long as each token's step size, scored with liquidity, holders and authorities."""
    flows = trade_flows(t)
    pool = t.liquidity_events.withColumn("amount", F.col("amount") / 1e4)
    span = kept(R.spans(flows, step), "spans")
    x = R.with_sides(R.step_features(flows, step, span=span, parts=t.parts("lineitem"), quiet=False), flows, step, pool, t.holders, t.mint_metadata, span=span)
    return R.signals(R.scores(x))


_SPAN = """SELECT token, t0, seconds, ceil((t1 - t0) / seconds)::BIGINT + 1 AS n_steps FROM (SELECT token, min(bt) AS t0, max(bt) AS t1,
  CASE WHEN count(*) >= 3 AND min(bt - prev) FILTER (bt > prev) <= 20 THEN 20 ELSE 60 END AS seconds FROM (SELECT *, lag(bt) OVER (PARTITION BY token ORDER BY bt, seq, line) AS prev FROM valid) GROUP BY token)"""
_SCORE_VIEWS = {
    "widths": _SPAN,
    "s": _TOKEN_STEPS,
    "mads": """SELECT token, step, coalesce(avg(abs(pause - mp)), 0) AS pause_mad, avg(abs(lamports - ml)) / 1e9 AS size_mad FROM (SELECT *, avg(pause) OVER (PARTITION BY token, step) AS mp, avg(lamports) OVER (PARTITION BY token, step) AS ml
      FROM (SELECT *, bt - lag(bt) OVER (PARTITION BY token, step ORDER BY bt, seq, line) AS pause FROM s)) GROUP BY token, step""",
    "busy": "SELECT token, step, sum(c) FILTER (r <= 10) / sum(c) AS density FROM (SELECT token, step, count(*) AS c, row_number() OVER (PARTITION BY token, step ORDER BY count(*) DESC, wallet) AS r FROM s GROUP BY token, step, wallet) GROUP BY token, step",
    "f": """SELECT *, count(*) FILTER ((step - prev - 1) * seconds >= 600) OVER (PARTITION BY token ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS back FROM (SELECT *, lag(step) OVER (PARTITION BY token ORDER BY step) AS prev FROM (SELECT token, step, any_value(seconds) AS seconds, count(*) AS n,
      sum(CASE WHEN o THEN 0 ELSE lamports END) / 1e9 AS inflow, sum(CASE WHEN o THEN lamports ELSE 0 END) / 1e9 AS outflow, count(DISTINCT wallet) FILTER (early AND new) AS early_entries, count(*) FILTER (early AND o) AS early_exits, count(DISTINCT wallet) FILTER (new) AS new_wallets,
      sum(CASE WHEN top AND o THEN lamports ELSE 0 END) / 1e9 AS top_outflow FROM s GROUP BY token, step) JOIN mads USING (token, step) JOIN busy USING (token, step))""",
    "pool": """SELECT e.token, (bt - t0) // seconds AS step, bt, seq, action, amount / 1e4 AS amount, threshold FROM liquidity_events e JOIN widths w ON w.token = e.token
      JOIN (SELECT token, o[floor(0.2::DOUBLE * (len(o) - 1))::BIGINT + 1] AS threshold FROM (SELECT token, list_sort(list(amount / 1e4)) AS o FROM liquidity_events GROUP BY token)) h ON h.token = e.token WHERE bt >= t0 AND (bt - t0) // seconds < n_steps""",
    "l": """SELECT token, step, count(*) FILTER (action = 'remove') AS removals, max((amount <= threshold)::INT) AS thin, arg_max(CASE WHEN len(w) < 2 THEN 0 ELSE list_avg(list_transform(w, lambda v: abs(v - list_avg(w)))) END, (bt, seq)) AS mad
      FROM (SELECT *, list(amount) OVER (PARTITION BY token ORDER BY bt, seq ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) AS w FROM pool) GROUP BY token, step""",
    "held": """SELECT token, wallet, epoch(make_date(y + 1, 1, 1))::BIGINT AS bt, sum(u) OVER (PARTITION BY token, wallet ORDER BY y ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS balance
      FROM (SELECT token, wallet, year(make_timestamp(bt * 1000000)) AS y, sum(CASE WHEN flow_direction = 'in' THEN units ELSE -units END) AS u FROM valid GROUP BY ALL)""",
    "gini": "SELECT token, bt, CASE WHEN sum(balance) > 0 THEN 2 * sum(i * balance) / (count(*) * sum(balance)) - (count(*) + 1) / count(*) ELSE 0 END AS g FROM (SELECT *, row_number() OVER (PARTITION BY token, bt ORDER BY balance, wallet) AS i FROM held WHERE balance >= 0) GROUP BY token, bt",
    "jumps": "SELECT DISTINCT g.token, (bt - t0) // seconds AS step, 1 AS spike FROM (SELECT *, coalesce(lag(g) OVER (PARTITION BY token ORDER BY bt), 0) AS last FROM gini) g JOIN widths w ON w.token = g.token WHERE g - last > 0.08::DOUBLE AND bt >= t0 AND (bt - t0) // seconds < n_steps",
    "y": """SELECT token, step, coalesce(n, 0) AS n, coalesce(inflow, 0) AS inflow, coalesce(outflow, 0) AS outflow, coalesce(early_entries, 0) AS early_entries, coalesce(early_exits, 0) AS early_exits, coalesce(new_wallets, 0) AS new_wallets, coalesce(top_outflow, 0) AS top_outflow,
      1 / (1 + coalesce(pause_mad, 0)) AS timing, 1 / (1 + coalesce(size_mad, 0)) AS same, coalesce(density, 0) AS density, coalesce(removals, 0) AS removals, coalesce(thin, 0) AS thin, coalesce(spike, 0) AS spike,
      coalesce(last_value(mad IGNORE NULLS) OVER u, 0) AS vol, coalesce(last_value(back IGNORE NULLS) OVER u, 0) AS back FROM f FULL JOIN l USING (token, step) FULL JOIN jumps USING (token, step) WINDOW u AS (PARTITION BY token ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""",
    "z": """SELECT y.*, (mint_authority IS NOT NULL)::INT + (freeze_authority IS NOT NULL)::INT + coalesce(is_mutable, false)::INT AS authorities, mint_authority IS NOT NULL OR freeze_authority IS NOT NULL AS mintable,
      1.4::DOUBLE * inflow + 1.1::DOUBLE * early_entries + new_wallets + 0.8::DOUBLE / (1 + vol) AS p, 1.4::DOUBLE * outflow + 1.1::DOUBLE * early_exits + top_outflow + 0.9::DOUBLE * vol + 0.8::DOUBLE * spike AS m FROM y JOIN widths USING (token) LEFT JOIN mint_metadata USING (token)""",
}


@query("fn11_side_scores", oracle("""SELECT token, step, n, removals, thin, spike, authorities, round(vol + 3e-8::DOUBLE, 6) AS liquidity_mad, round(p + 3e-8::DOUBLE, 6) AS p_plus, round(m + 3e-8::DOUBLE, 6) AS p_minus,
  round((1.1::DOUBLE * timing + same + 1.1::DOUBLE * density + 0.9::DOUBLE * removals + 1.2::DOUBLE * thin + authorities + 0.8::DOUBLE * spike) / (1 + abs(p - m) / (1 + n)) + 3e-8::DOUBLE, 6) AS risk,
  CASE WHEN p <= 0 AND m <= 0 THEN 'NEUTRAL' WHEN p > m * 1.12::DOUBLE THEN 'PUMP' WHEN m > p * 1.12::DOUBLE THEN 'DUMP' ELSE 'NEUTRAL' END AS dominant,
  removals > 0 AND outflow > inflow AS vampire, mintable AND spike > 0 AS time_bomb, timing > 0.7::DOUBLE AND same > 0.7::DOUBLE AND density > 0.75::DOUBLE AS bot_farm, back > 0 AND inflow > outflow AS phoenix FROM z""", "valid", "liquidity_events", "mint_metadata", **_SCORE_VIEWS))  # fmt: skip
def fn11_sides(t):
    """Scores and signals at the bounds of the rules; halves of the last place go up in both engines."""
    return trade_scores(t).select("token", "step", "n", "removals", "thin", "spike", "authorities", *[F.round(F.col(c) + 3e-8, 6).alias(c) for c in ("liquidity_mad", "p_plus", "p_minus", "risk")], "dominant", "vampire", "time_bomb", "bot_farm", "phoenix")


@query("st14_archetype_changes")
def st14_changes(t):
    return R.changes(R.evaluated(trade_scores(t), dealt=True))


@query("st14_archetype_flips")
def st14_flips(t):
    return R.exemplars(R.evaluated(trade_scores(t), dealt=True))


@query("st14_archetype_summary")
def st14_summary(t):
    return R.summary(R.evaluated(trade_scores(t), dealt=True))


@query("win25_step_size", oracle("SELECT token, CASE WHEN n >= 3 AND least <= 20 THEN 20 ELSE 60 END AS step FROM (SELECT token, count(*) AS n, min(bt - prev) FILTER (bt > prev) AS least FROM (SELECT *, lag(bt) OVER (PARTITION BY token ORDER BY bt, seq) AS prev FROM flows) GROUP BY token)", "flows"))
def win25_size(t):
    return R.step_size(t.flows)


RAW = """SELECT event_id, CASE WHEN event_id % 41 = 0 THEN 'short' ELSE lpad((user_id % 40)::VARCHAR, 44, 'W') END AS wallet, 1704067200 + event_id AS timestamp, CASE WHEN event_id % 37 = 0 THEN 'hold' WHEN json_extract_string(props, '$.k')::INT < 60 THEN 'BUY' ELSE 'sell' END AS direction, value AS amount,
  CASE WHEN event_id % 43 = 0 THEN '' ELSE 'sig' || event_id END AS signature FROM events"""


def raw_flows(t):
    """Flows as they land, with the faults of a stated share of rows."""
    e = t.raw("events")
    every = lambda n: F.col("event_id") % n == 0
    return e.select(
        "event_id", F.when(every(41), "short").otherwise(F.lpad((F.col("user_id") % 40).cast("string"), 44, "W")).alias("wallet"), (1_704_067_200 + F.col("event_id")).alias("timestamp"),
        F.when(every(37), "hold").when(F.get_json_object("props", "$.k").cast("int") < 60, "BUY").otherwise("sell").alias("direction"), F.col("value").alias("amount_sol"),
        F.when(every(43), "").otherwise(F.concat(F.lit("sig"), F.col("event_id"))).alias("signature"), F.col("event_type").alias("token_ca"),
    )


@query("src2_validate", oracle("""SELECT error, count(*) AS n FROM (SELECT CASE WHEN signature = '' THEN 'missing signature' WHEN length(wallet) <> 44 THEN 'bad wallet' WHEN timestamp > 1704070000 + 60 THEN 'future timestamp' WHEN lower(direction) NOT IN ('buy', 'sell') THEN 'bad direction' WHEN amount <= 0 THEN 'bad amount' END AS error FROM raw) GROUP BY error""", raw=RAW))
def src2(t):
    return I.validated(raw_flows(t), 1_704_070_000).groupBy("error").agg(F.count("*").alias("n"))


@query("src3_validate_lenient", oracle("""SELECT error, count(*) AS n FROM (SELECT CASE WHEN signature = '' THEN 'missing signature' WHEN length(wallet) <> 44 THEN 'bad wallet' WHEN lower(direction) NOT IN ('buy', 'sell') THEN 'bad direction' WHEN amount = 0 THEN 'bad amount' END AS error FROM raw) GROUP BY error""", raw=RAW))
def src3(t):
    return I.validated(raw_flows(t), 1_704_070_000, "lenient").groupBy("error").agg(F.count("*").alias("n"))


def landed_swaps(t):
    """Swap transactions as they land, built from flows."""
    addr = F.lpad("wallet", 44, "W")
    net = F.when(F.col("direction") == "buy", -F.col("lamports")).otherwise(F.col("lamports"))
    buyer = F.col("direction") == "buy"
    return t.flows.select(
        "signature", F.col("bt").alias("timestamp"), F.lit("SWAP").alias("type"), F.lit("RAYDIUM").alias("source"), "token", addr.alias("feePayer"), addr.alias("wallet"), "direction", "lamports",
        F.array(F.struct(F.lit("pool").alias("account"), (-net).alias("nativeBalanceChange")), F.struct(addr.alias("account"), F.when(F.col("seq") % 3 == 0, F.lit(0).cast("long")).otherwise(net).alias("nativeBalanceChange"))).alias("accountData"),
        F.array(F.struct(F.when(buyer, addr).otherwise("pool").alias("fromUserAccount"), F.when(buyer, F.lit("pool")).otherwise(addr).alias("toUserAccount"), F.col("lamports").alias("amount"))).alias("nativeTransfers"),
        F.array(F.struct(F.col("token").alias("mint"), (F.col("lamports") / 1e6).alias("tokenAmount"), F.when(buyer, F.lit("")).otherwise(addr).alias("fromUserAccount"), addr.alias("toUserAccount"))).alias("tokenTransfers"),
    )


@query("src1_parse_swaps", oracle("SELECT signature, bt, lpad(wallet, 44, 'W') AS wallet, token, direction, lamports FROM flows", "flows"))
def src1(t):
    return I.parse_swaps(landed_swaps(t))


@query("src4_parse_transfers", oracle("SELECT signature, bt, lpad(wallet, 44, 'W') AS wallet, token, direction, lamports / 1e9 AS amount_sol FROM flows", "flows"))
def src4(t):
    return I.parse_transfers(landed_swaps(t))


@query("prj2_derived_flow", oracle("""SELECT signature, CASE WHEN direction = 'buy' THEN lamports / 1e6 ELSE 0 END AS token_net, CASE WHEN direction = 'buy' THEN -lamports / 1e9 ELSE lamports / 1e9 END AS sol_net, CASE WHEN direction = 'buy' THEN 'BUY' ELSE 'OTHER' END AS side, CASE WHEN direction = 'buy' THEN '' ELSE 'no_token_change' END AS anomalies FROM flows""", "flows"))
def prj2(t):
    return I.derived_flow(landed_swaps(t)).select("signature", "token_net", "sol_net", "side", "anomalies")


@query("prj7_mint_parties", oracle("SELECT token, count(*) AS n, count(*) FILTER (direction = 'sell') AS n_sellers FROM flows GROUP BY token", "flows"))
def prj7(t):
    return I.mint_parties(landed_swaps(t)).groupBy("token").agg(F.count("*").alias("n"), F.sum(F.size("sellers")).alias("n_sellers"))


@query("join17_balance_changes", oracle("SELECT signature, 0 AS index, token AS mint, wallet AS owner, sum(CASE WHEN flow_direction = 'in' THEN units ELSE -units END)::DOUBLE AS delta FROM (SELECT DISTINCT signature, wallet, token, flow_direction, units, line, seq, lamports FROM valid) GROUP BY ALL HAVING sum(CASE WHEN flow_direction = 'in' THEN units ELSE -units END) <> 0", "valid"))
def join17(t):
    x = t.valid.select("signature", "wallet", "token", "flow_direction", "units", "line", "seq", "lamports").distinct()
    item = lambda amount: F.array(F.struct(F.lit(0).alias("index"), F.col("token").alias("mint"), F.col("wallet").alias("owner"), amount.cast("string").alias("amount")))
    buy = F.col("flow_direction") == "in"
    tx = x.select("signature", item(F.when(buy, 100).otherwise(100 + F.col("units"))).alias("pre"), item(F.when(buy, 100 + F.col("units")).otherwise(100)).alias("post"))
    return I.balance_changes(tx).withColumn("delta", F.col("delta").cast("double"))


@query("fn22_swap_legs", oracle("SELECT signature, token AS mint, CASE WHEN direction = 'buy' THEN lamports / 1e6 ELSE -lamports / 1e6 END AS token_delta, CASE WHEN direction = 'buy' THEN -lamports / 1e9 ELSE lamports / 1e9 END AS sol_delta FROM flows WHERE seq % 5 > 0", "flows"))
def fn22(t):
    buy, sol, tok = F.col("direction") == "buy", F.col("lamports") / 1e9, F.col("lamports") / 1e6
    native = F.when(F.col("seq") % 5 == 0, F.col("token")).otherwise(I.WRAPPED)
    x = t.flows.select("signature", F.when(buy, native).otherwise(F.col("token")).alias("in_mint"), F.when(buy, sol).otherwise(tok).alias("in_amount"), F.when(buy, F.col("token")).otherwise(native).alias("out_mint"), F.when(buy, tok).otherwise(sol).alias("out_amount"))
    return I.swap_legs(x)


@query("src14_first_mcap", oracle("SELECT token, mcap_time, min(mcap) AS mcap FROM mcap GROUP BY token, mcap_time", "mcap"))
def src14(t):
    return I.first_non_null(t.mcap.withColumn("line_no", F.col("mcap")), ("token", "mcap_time"), "mcap", "line_no")


@query("src19_distinct_mints", oracle("SELECT DISTINCT token AS mint FROM trades WHERE token > '150' ORDER BY mint LIMIT 25", "trades"))
def src19(t):
    return I.distinct_mints(t.trades, after="150", limit=25)


@query("src20_upsert", oracle("SELECT token, amount, bt FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY bt DESC, fresh DESC, amount) AS n FROM (SELECT token, amount, bt, (action = 'add')::INT AS fresh FROM liquidity_events)) WHERE n = 1", "liquidity_events"))
def src20(t):
    e = t.liquidity_events
    return I.upsert(e.where("action <> 'add'").select("token", "amount", "bt"), e.where("action = 'add'").select("token", "amount", "bt"), "token", "bt")


@query("src21_unprocessed", oracle("SELECT DISTINCT token FROM trades WHERE token NOT IN (SELECT token FROM mint_metadata WHERE mint_authority IS NOT NULL)", "trades", "mint_metadata"))
def src21(t):
    return I.unprocessed(t.trades.select("token").distinct(), t.mint_metadata.where("mint_authority IS NOT NULL"), "token")


@query("src23_fingerprint", oracle("SELECT count(*) AS n, sum(('0x' || substr(md5(concat_ws(chr(31), bt::VARCHAR, direction, lamports::VARCHAR, seq::VARCHAR, signature, token, wallet)), 1, 8))::BIGINT)::VARCHAR AS fingerprint FROM flows", "flows"))
def src23(t):
    return I.fingerprint(t.flows)


@query("src26_first_pool", oracle("SELECT token, pool, liquidity FROM (SELECT (p_partkey % 200)::VARCHAR AS token, p_name AS pool, CASE WHEN p_size % 9 = 0 THEN NULL ELSE round(p_retailprice * 100)::BIGINT END AS liquidity, row_number() OVER (PARTITION BY p_partkey % 200 ORDER BY CASE WHEN p_size % 9 = 0 THEN NULL ELSE round(p_retailprice * 100)::BIGINT END DESC NULLS LAST, p_name) AS n FROM part) WHERE n = 1"))
def src26(t):
    p = t.raw("part").select((F.col("p_partkey") % 200).cast("string").alias("token"), F.col("p_name").alias("pool"), F.when(F.col("p_size") % 9 > 0, F.round(F.col("p_retailprice") * 100).cast("long")).alias("liquidity"))
    return I.first_pool(p)


@query("src9_session_summary", oracle("SELECT event_type, count(*) AS n, min(bt) AS first_bt, max(bt) AS last_bt FROM (SELECT 'FLOW' AS event_type, bt FROM flows UNION ALL SELECT 'WHALE', bt FROM flows WHERE lamports >= 10000000000) GROUP BY event_type", "flows"))
def src9(t):
    return I.session_summary(I.session_log({"FLOW": t.flows, "WHALE": t.flows.where("lamports >= 10000000000")}))


@query("prj11_violations", oracle("SELECT event_id, CASE WHEN event_id % 43 = 0 AND event_id % 37 = 0 THEN 'signature,type' WHEN event_id % 43 = 0 THEN 'signature' ELSE 'type' END AS violations FROM events WHERE event_id % 43 = 0 OR event_id % 37 = 0"))
def prj11(t):
    x = raw_flows(t).select("event_id", "signature", F.col("event_id").alias("slot"), F.col("timestamp").alias("bt"), F.lower("direction").alias("event_type"))
    return I.event_violations(x, ("buy", "sell")).select("event_id", "violations")


@query("prj12_ordering_audit", oracle("SELECT signature, 'out_of_order' AS fault FROM (SELECT *, lag(slot) OVER (PARTITION BY token ORDER BY seq) AS last FROM (SELECT *, bt // 60 + CASE WHEN seq % 50 = 0 THEN -1000000 ELSE 0 END AS slot FROM flows)) WHERE slot < last", "flows"))
def prj12(t):
    x = t.flows.withColumn("slot", F.floor(F.col("bt") / 60) + F.when(F.col("seq") % 50 == 0, -1_000_000).otherwise(0))
    return I.ordering_audit(x).select("signature", "fault")
