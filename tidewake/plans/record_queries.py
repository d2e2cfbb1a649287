"""Queries over records as they land: programs, fees, mints, logs and runs; and reports on creators, silence and verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import scalar as S
from tidewake.operators import aggregates as A
from tidewake.operators import evidence as V
from tidewake.operators import joins as J
from tidewake.operators import machine as M
from tidewake.operators import windows as W
from tidewake.plans import scan_queries as X
from tidewake.plans import trade_queries as T
from tidewake.plans.registry import query
from tidewake.sources import files, shared
from tidewake.sources import ingest as I
from tidewake.sources.canonical import oracle

_VENUE = list(S.VENUES)


def raw_transactions(t):
    """Transactions with nested instructions, token transfers and compute budget, one for each trade."""
    k = F.col("seq")
    one = lambda *ids: F.array(*[F.struct(i.alias("programId")) for i in ids])
    venue = F.when(F.col("dex") == "pump", _VENUE[0]).when(F.col("dex") == "raydium", _VENUE[1])
    buy = F.col("flow_direction") == "in"
    move = F.struct(F.col("token").alias("mint"), F.col("units").cast("double").alias("tokenAmount"), F.when(buy, "pool").otherwise(F.col("wallet")).alias("fromUserAccount"), F.when(buy, F.col("wallet")).otherwise("pool").alias("toUserAccount"))
    return t.trades.select(
        "signature", "wallet", "token", "line", "seq", "dex", "err", (5000 + k % 7 * 100).alias("fee"), one(F.lit("budget"), venue, F.lit("budget")).alias("instructions"),
        F.array(F.struct(one(F.lit("inner"), venue).alias("instructions")), F.struct(one(F.lit("a")).alias("instructions"))).alias("innerInstructions"), F.array(move, F.struct(F.lit("other").alias("mint"), F.lit(1.0).alias("tokenAmount"), F.lit("x").alias("fromUserAccount"), F.lit("y").alias("toUserAccount"))).alias("tokenTransfers"),
        F.when(k % 3 > 0, 200_000 + k % 5).alias("unit_limit"), F.when(k % 2 == 0, k % 100).alias("unit_price"), F.when(F.col("line") == 3, "OTHER").when(buy, "BUY").otherwise("SELL").alias("side"),
    )


@query("fn19_program_ids", oracle(f"""SELECT signature, line, CASE dex WHEN 'pump' THEN '{_VENUE[0]},budget' WHEN 'raydium' THEN '{_VENUE[1]},budget' ELSE 'budget' END AS top, CASE dex WHEN 'pump' THEN '{_VENUE[0]},a,inner' WHEN 'raydium' THEN '{_VENUE[1]},a,inner' ELSE 'a,inner' END AS inside,
  CASE dex WHEN 'pump' THEN 'Pump.fun' WHEN 'raydium' THEN 'Raydium' ELSE 'Other' END AS route FROM trades""", "trades"))  # fmt: skip
def fn19_programs(t):
    x = I.program_ids(raw_transactions(t))
    return x.select("signature", "line", F.array_join("programs_top", ",").alias("top"), F.array_join("programs_inner", ",").alias("inside"), S.route_of(F.array_union("programs_top", "programs_inner")).alias("route"))


@query("src24_token_moves", oracle("SELECT signature, line, CASE WHEN flow_direction = 'in' THEN token || ':' || units END AS spl_in, CASE WHEN flow_direction = 'out' THEN token || ':' || units END AS spl_out FROM trades", "trades"))
def src24_moves(t):
    text = lambda c: F.nullif(F.array_join(F.transform(c, lambda m: F.concat_ws(":", m["mint"], m["amount"].cast("long"))), ","), F.lit(""))
    return I.token_moves(raw_transactions(t)).select("signature", "line", text("spl_in").alias("spl_in"), text("spl_out").alias("spl_out"))


@query("prj8_platforms", oracle("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN 'RAYDIUM' WHEN p_size % 4 = 1 THEN 'PUMP_FUN' WHEN p_size % 4 = 2 THEN 'PUMP_FUN_RELATED_ACCOUNT' ELSE '' END AS platform FROM part"))
def prj8(t):
    k = F.col("p_size") % 4
    return t.raw("part").select("p_partkey", S.platform(F.when(k == 0, "RAYDIUM").when(k == 3, ""), F.when(k == 1, "abcpump").otherwise("abc"), F.when(k == 2, F.array(F.lit("x"), F.lit("myPumpPool"))).otherwise(F.array(F.lit("x")))).alias("platform"))


@query("agg15_fee_report", oracle("""SELECT count(*) AS n, count(*) FILTER (err <> '') AS n_errors, round(count(*) FILTER (err <> '') / count(*), 6) AS error_rate, sum(5000 + seq % 7 * 100)::BIGINT AS fees, median(5000 + seq % 7 * 100) AS median_fee, quantile_cont(5000 + seq % 7 * 100, 0.9) AS p90_fee,
  count(*) FILTER (line <> 3 AND flow_direction = 'in') AS n_buy, count(*) FILTER (line <> 3 AND flow_direction = 'out') AS n_sell, count(*) FILTER (line = 3) AS n_other, round(count(*) FILTER (seq % 3 > 0 OR seq % 2 = 0) / count(*), 6) AS budget_share,
  median(200000 + seq % 5) FILTER (seq % 3 > 0) AS median_limit, median(seq % 100) FILTER (seq % 2 = 0) AS median_price FROM trades""", "trades"))  # fmt: skip
def agg15_fees(t):
    return A.fee_report(raw_transactions(t))


@query("agg27_price_histogram", oracle("SELECT CASE WHEN seq % 2 = 0 THEN seq % 100 END AS price, count(*) AS n FROM trades GROUP BY ALL", "trades"))
def agg27_prices(t):
    return A.price_histogram(raw_transactions(t))


@query("prj14_budget_rows", oracle("SELECT signature, line, 5000 + seq % 7 * 100 AS fee, CASE WHEN seq % 3 > 0 THEN 200000 + seq % 5 END AS unit_limit, CASE WHEN seq % 2 = 0 THEN seq % 100 END AS unit_price, CASE WHEN dex = 'orca' THEN 2 ELSE 3 END AS n_programs FROM trades", "trades"))
def prj14_rows(t):
    x = I.program_ids(raw_transactions(t)).withColumn("programs", F.array_union("programs_top", F.filter("programs_inner", lambda p: p != "a")))
    return x.select("signature", "line", "fee", "unit_limit", "unit_price", F.size("programs").alias("n_programs"))


@query("src25_mint_security")
def src25_security(t):
    """Mint accounts with both authorities as base-58 text; tests hold the text against a plain conversion."""
    k = F.col("p_partkey")
    key = F.unhex(F.lpad(F.hex(k.cast("long")), 64, "0"))
    word = lambda c: F.unhex(F.concat(F.lpad(F.hex(c.cast("long")), 2, "0"), F.lit("000000")))
    data = F.concat(word(k % 2), key, F.unhex(F.lit("00" * 8)), F.unhex(F.lit("0601")), word(k % 3), key)
    owner = F.when(k % 5 == 0, I.TOKEN_2022[0]).otherwise("token")
    return I.mint_security(t.raw("part").select(k.cast("string").alias("mint"), data.alias("data"), owner.alias("owner")))


@query("fn21_sol_mints", oracle("SELECT mint, count(*) AS n FROM (SELECT CASE line WHEN 2 THEN 'wSOL' WHEN 3 THEN NULL ELSE 'So11111111111111111111111111111111111111112' END AS mint FROM valid) WHERE mint IS NOT NULL GROUP BY mint", "valid"))
def fn21(t):
    sol = F.when(F.col("line") == 2, "wSOL").when(F.col("line") == 3, "solana-cat").otherwise(I.WRAPPED)
    return I.sol_mints(t.valid.select(sol.alias("in_mint"), F.col("token").alias("out_mint")))


@query("src27_holder_snapshots", oracle("""SELECT token, epoch(make_date(year + 1, 1, 1))::BIGINT AS bt, count(*) AS n, count(*) FILTER (b > 0) AS n_positive, sum(b)::DOUBLE AS total, max(b)::DOUBLE AS largest FROM (
  SELECT token, wallet, year, sum(u) OVER (PARTITION BY token, wallet ORDER BY year ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS b FROM (SELECT token, wallet, year(to_timestamp(bt) AT TIME ZONE 'UTC') AS year, sum(CASE WHEN flow_direction = 'in' THEN units ELSE -units END) AS u FROM valid GROUP BY ALL)) GROUP BY token, year""", "valid"))  # fmt: skip
def src27_holders(t):
    return I.holder_snapshots(t.holders)


@query("src27_liquidity_values", oracle("SELECT token, action, count(*) AS n, sum(CASE WHEN seq % 3 = 0 THEN 5.0::DOUBLE WHEN seq % 3 = 1 THEN amount ELSE 0 END) AS value FROM liquidity_events GROUP BY token, action", "liquidity_events"))
def src27_values(t):
    k = F.col("seq") % 3
    x = t.liquidity_events.withColumns({"liquidity": F.when(k == 0, "5"), "amount": F.when(k == 1, F.col("amount").cast("string")).when(k == 2, ""), "action": F.upper("action")})
    return I.liquidity_values(x).groupBy("token", "action").agg(F.count("*").alias("n"), F.sum("value").alias("value"))


def session_lines(t):
    """Rows of a session log as JSON text, with their fields under several names and places."""
    k = F.col("seq") % 4
    signal = F.to_json(F.struct(F.lit("wallet_signal").alias("type"), F.when(k == 0, F.col("bt")).alias("event_time"), F.when(k == 1, F.col("wallet")).alias("wallet"), F.struct(F.when(k != 1, F.col("wallet")).alias("wallet_address"), F.when(k != 0, F.col("bt")).alias("timestamp"), F.struct((F.col("seq") % 5 > 0).alias("is_early")).alias("timing")).alias("details")))
    move = F.to_json(F.struct(F.lit("STATE").alias("event_type"), F.when(k == 2, "A").alias("from_state"), F.when(k == 2, "B").alias("to_state"), F.col("bt").alias("time"), F.struct(F.when(k == 3, "C").alias("state_from"), F.lit("D").alias("state_to")).alias("details")))
    return t.flows.select(F.when(F.col("direction") == "buy", signal).otherwise(move).alias("value"))


@query("prj10_early_signals", oracle("SELECT wallet, bt FROM flows WHERE direction = 'buy' AND seq % 5 > 0", "flows"))
def prj10(t):
    return I.early_signals(session_lines(t))


@query("prj10_log_transitions", oracle("SELECT CASE WHEN seq % 4 = 2 THEN 'A' ELSE 'C' END AS from_state, CASE WHEN seq % 4 = 2 THEN 'B' ELSE 'D' END AS to_state, bt FROM flows WHERE direction <> 'buy' AND seq % 4 >= 2", "flows"))
def prj10_moves(t):
    return I.log_transitions(session_lines(t))


@query("src11_capped_logs", oracle("SELECT token, least(count(DISTINCT wallet), 5) AS n, 323 AS longest FROM flows GROUP BY token", "flows"))
def src11_logs(t):
    x = t.flows.groupBy("token").agg(F.collect_set("wallet").alias("wallets"))
    x = x.select("token", F.from_json(I.capped_details(F.to_json(F.struct(F.struct("wallets", F.repeat(F.lit("x"), 400).alias("text")).alias("inner")))), "inner struct<wallets: array<string>, text: string>").alias("d"))
    return x.select("token", F.size("d.inner.wallets").alias("n"), F.length("d.inner.text").alias("longest"))


@query("src21_finished_run", oracle("SELECT 'r1' AS run_id, 'backfill' AS kind, 1::BIGINT AS started, 9::BIGINT AS ended, count(*) FILTER (err IS NULL) AS n_done, count(*) FILTER (err IS NOT NULL) AS n_failed, CASE WHEN count(err) > 0 THEN 'errors' ELSE 'done' END AS status FROM trades", "trades"))
def src21_run(t):
    run, _ = I.finished_run(None, "r1", "backfill", 1, 9, t.valid, t.trades.where("err IS NOT NULL").select(F.col("signature").alias("key"), F.col("err").alias("error")))
    return run


#: The first 20 buyers of each token besides its creator, with the hops of the creator's funding and, of two hops, the wallet in between.
FUNDED = """SELECT b.token, b.creator, b.wallet, coalesce(h.hops = 1, false) AS direct, coalesce(h.hops = 2, false) AS indirect, mid FROM (SELECT token, creator, wallet FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY first_buy, wallet) AS n FROM fb JOIN cr USING (token) WHERE wallet <> creator) WHERE n <= 20) b
  LEFT JOIN (SELECT source, target, min(hops) AS hops, arg_min(mid, hops) AS mid FROM (SELECT src AS source, dst AS target, 1 AS hops, '' AS mid FROM tr WHERE dst <> src GROUP BY ALL
    UNION ALL SELECT h.src, t.dst, 2, arg_min(h.dst, (t.bt, h.dst)) FROM (SELECT src, dst, min(bt) AS bt FROM tr WHERE dst <> src GROUP BY ALL) h JOIN tr t ON t.src = h.dst AND t.bt >= h.bt AND t.dst <> h.src GROUP BY h.src, t.dst) GROUP BY source, target) h ON h.source = b.creator AND h.target = b.wallet"""
_FUNDED = {"cr": X.CREATORS, "fb": T.FB, "tr": T.TRANSFERS, "funded": FUNDED}


def early_buyers(t):
    """The first 20 buyers of each token besides its creator, with the funding flags and the wallets in between."""
    return X.funded_rows(t)


@query("agg20_repeated_wallets", oracle("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY n_tokens DESC, wallet) AS rank FROM (SELECT creator, wallet, count(DISTINCT token) AS n_tokens, bool_or(direct) AS direct, bool_or(indirect) AS indirect FROM funded GROUP BY ALL) WHERE n_tokens > 1 OR direct OR indirect) WHERE rank <= 10", "valid", **_FUNDED))
def agg20_repeated(t):
    return V.repeated_wallets(early_buyers(t))


@query("agg20_funding_summary", oracle("SELECT creator, count(*) AS n_tokens, count(*) FILTER (direct) AS n_direct, count(*) FILTER (indirect) AS n_indirect FROM (SELECT creator, token, bool_or(direct) AS direct, bool_or(indirect) AS indirect FROM funded GROUP BY ALL) GROUP BY creator", "valid", **_FUNDED))
def agg20_funding(t):
    return V.funding_summary(early_buyers(t))


@query("agg20_intermediaries", oracle("SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY creator ORDER BY n DESC, wallet) AS rank FROM (SELECT creator, mid AS wallet, count(*) AS n, count(DISTINCT token) AS n_tokens FROM funded WHERE indirect GROUP BY ALL)) WHERE rank <= 10", "valid", **_FUNDED))
def agg20_intermediaries(t):
    """The wallets through which a creator funded early buyers, most frequent first."""
    return V.intermediaries(early_buyers(t))


@query("agg28_silence_lead")
def agg28_lead(t):
    """Silence against the first exhaustion of each token in its life cycle."""
    out = M.transitions(t.flows).where("to_state = 'EXHAUSTION_DETECTED'").groupBy("token").agg(F.min("bt").alias("exhausted_at"))
    return A.silence_lead(W.silence_curve(t.flows, (60, 600), 600), out, t.flows)


@query("agg28_silence_lead_fixed", oracle("""SELECT token, gap, first_quiet, most, exhausted_at, exhausted_at - first_quiet AS lead_time, first_quiet IS NOT NULL AS hit, active_after FROM (SELECT token, gap, min("at") FILTER (n_silent / n_seen >= 0.6) AS first_quiet, round(max(n_silent / n_seen), 6) AS most FROM (SELECT g.token, x.gap, g.at, count(*) AS n_seen, count(*) FILTER (last < g.at - x.gap) AS n_silent FROM (
    SELECT s.token, s.at, f.wallet, max(f.bt) AS last FROM (SELECT token, unnest(range(t0, t1 + 1, 600)) AS at FROM (SELECT token, min(bt) AS t0, max(bt) AS t1 FROM flows GROUP BY token)) s
    JOIN flows f ON f.token = s.token AND f.bt <= s.at GROUP BY ALL) g CROSS JOIN (SELECT unnest([60, 600]) AS gap) x GROUP BY ALL) GROUP BY token, gap) JOIN (SELECT token, max(bt) - 1800 AS exhausted_at FROM flows GROUP BY token) USING (token)
  JOIN (SELECT f.token, count(DISTINCT wallet) AS active_after FROM flows f JOIN (SELECT token, max(bt) - 1800 AS e FROM flows GROUP BY token) USING (token) WHERE bt > e GROUP BY f.token) USING (token)""", "flows"))  # fmt: skip
def agg28_fixed(t):
    out = t.flows.groupBy("token").agg((F.max("bt") - 1800).alias("exhausted_at"))
    return A.silence_lead(W.silence_curve(t.flows, (60, 600), 600), out, t.flows)


@query("win10_expiring_minutes", oracle("SELECT token, wallet, count(*) AS n_minutes FROM (SELECT *, minute - lag(minute) OVER (PARTITION BY token, wallet ORDER BY minute) AS gap FROM (SELECT DISTINCT token, wallet, bt // 60 * 60 AS minute FROM flows)) GROUP BY token, wallet HAVING count(*) >= 2 AND min(gap) <= 300", "flows"))
def win10_expiry(t):
    return W.persistence(t.flows, mode="expiry").select("token", "wallet", "n_minutes")


@query("st4_transitions_compat")
def st4_compat(t):
    """The life cycle in which a token may alternate between quiet and ignition; tests hold it against a plain fold."""
    return M.transitions(t.flows, strict=False)


@query("st5_second_machine")
def st5_machine(t):
    return M.transitions(t.flows, second=True)


@query("st11_full_verdicts")
def st11_full(t):
    cohorts = t.flows.groupBy("token", F.floor(F.col("bt") / 7200).alias("wave")).agg(F.countDistinct(F.when(F.col("lamports") >= 20_000_000_000, F.col("wallet"))).alias("n"))
    return V.full_verdicts(t.flows, M.transitions(t.flows), cohorts)


@query("st12_cluster_alerts", oracle("""SELECT token, kind, arg_max(wallet, (bt, seq)) AS wallet, max(bt) AS bt FROM (SELECT token, 'CLUSTER' AS kind, wallet, bt, seq FROM (SELECT token, wallet, bt, seq, len(list_distinct(list(wallet) OVER (PARTITION BY token ORDER BY bt RANGE BETWEEN 60 PRECEDING AND CURRENT ROW))) AS k FROM flows) WHERE k >= 3
  UNION ALL SELECT token, 'INACTIVITY', NULL, "at", 0 FROM (SELECT s.token, s."at", count(*) AS n_seen, count(*) FILTER (last < s."at" - 120) AS n_silent FROM (SELECT s.token, s."at", f.wallet, max(f.bt) AS last FROM (SELECT token, unnest(range(t0, t1 + 1, 600)) AS "at" FROM (SELECT token, min(bt) AS t0, max(bt) AS t1 FROM flows GROUP BY token)) s
    JOIN flows f ON f.token = s.token AND f.bt <= s."at" GROUP BY ALL) s GROUP BY ALL) WHERE n_silent / n_seen >= 0.6) GROUP BY token, kind""", "flows"))  # fmt: skip
def st12_clusters(t):
    quiet = W.silence_curve(t.flows, (120,), 600).where("n_seen > 0 AND n_silent / n_seen >= 0.6").select("token", F.lit(None).cast("string").alias("wallet"), F.col("at").alias("bt"), F.lit(0).cast("long").alias("seq"))
    return V.alerts({"CLUSTER": W.coordination(t.flows), "INACTIVITY": quiet})


def in_order(report, name: str, *order, rows: int | None = None):
    """TOP-8: a whole report, written in order and read back with the number of each row. rows: of a stored report, how many a task puts in order."""
    spark, path = report.sparkSession, shared.new_path(report.sparkSession, name)
    n = None if rows is None else max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-report.count() // rows))
    files.write_ordered(report, list(order), path, n)
    return files.read_ordered(spark, path)


@query("top8_report_orders", oracle("SELECT wallet, token, net, row_number() OVER (ORDER BY net DESC, wallet, token) AS row_no FROM pnl", "valid", pnl=T.PNL))
def top8(t):
    """Positions by net result."""
    return in_order(A.token_pnl(t.valid).select("wallet", "token", "net"), "positions", F.desc("net"), F.asc("wallet"), F.asc("token"))


@query("top8_entry_order", oracle("SELECT wallet, token, delta, net, row_number() OVER (ORDER BY delta, net DESC, token, wallet) AS row_no FROM entry JOIN pnl USING (wallet, token)", "valid", entry=T.ENTRY, pnl=T.PNL))
def top8_entries(t):
    """Entries by their delay, then by net result."""
    x = J.entry_delta(t.valid).select("wallet", "token", "delta").join(A.token_pnl(t.valid).select("wallet", "token", "net").hint("merge"), ["wallet", "token"])
    return in_order(x, "entries", F.asc("delta"), F.desc("net"), F.asc("token"), F.asc("wallet"))


@query("top8_lead_order", oracle(f"SELECT a, b, shared, lead_rate, median_delta, row_number() OVER (ORDER BY shared DESC, lead_rate DESC, median_delta, a, b) AS row_no FROM ({T.LEAD}) WHERE shared >= 20", "valid", fb=T.FB))
def top8_leads(t):
    """Pairs of wallets by shared tokens, lead and delay."""
    # stored, as the ranges of an order are sampled from the rows first
    x = shared.kept(J.pair_stats(J.first_buys(t.valid), least_shared=20).select("a", "b", "shared", "lead_rate", "median_delta"), "leads")
    return in_order(x, "leads", F.desc("shared"), F.desc("lead_rate"), F.asc("median_delta"), F.asc("a"), F.asc("b"), rows=2_000_000)


@query("src6_event_log", oracle("SELECT 'e' || event_id AS event_id, event_type, event_id // 10 AS slot, floor(epoch(ts))::BIGINT AS block_time, user_id::VARCHAR AS actor, 'a \"b\", c' AS second, round(value * 100)::BIGINT::VARCHAR AS amount FROM events"))
def src6(t):
    """The event log written as CSV with JSON columns and read back."""
    text = lambda c: F.lit(None).cast("string").alias(c)
    x = t.raw("events").select(
        F.concat(F.lit("e"), "event_id").alias("event_id"), "event_type", F.concat(F.lit("s"), "event_id").alias("signature"), F.floor(F.col("event_id") / 10).alias("slot"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("block_time"), text("program_id"), text("token_mint"), text("pool_id"),
        F.array(F.col("user_id").cast("string"), F.lit('a "b", c')).alias("actors"), F.create_map(F.lit("z"), F.lit("1"), F.lit("amount"), F.round(F.col("value") * 100).cast("long").cast("string")).alias("amounts"), F.lit("rpc").alias("source"), F.lit("1").alias("version"),
    )
    path = shared.new_path(t.spark, "event-log")
    files.write_events(x, path)
    back = files.read_events(t.spark, path)
    return back.select("event_id", "event_type", "slot", "block_time", F.col("actors")[0].alias("actor"), F.col("actors")[1].alias("second"), F.col("amounts")["amount"].alias("amount"))


@query("src7_transition_log", oracle("SELECT 't' || seq AS transition_id, wallet AS entity_address, token AS token_mint, 'a b c' AS trigger, bt::VARCHAR AS block_time, signature FROM flows", "flows"))
def src7(t):
    """Transitions written as TSV, with tabs and line ends in a value, and read back."""
    values = {"transition_id": F.concat(F.lit("t"), "seq"), "entity_type": F.lit("wallet"), "entity_address": F.col("wallet"), "token_mint": F.col("token"), "from_state": F.lit("QUIET"), "to_state": F.lit("IGNITION"), "trigger": F.lit("a\tb\nc"), "block_time": F.col("bt"), "signature": F.col("signature"), "version": F.lit("1")}
    path = shared.new_path(t.spark, "transition-log")
    files.write_tsv(t.flows.select(*[values[c].cast("string").alias(c) for c in files.TRANSITION_COLUMNS]), path)
    return files.read_tsv(t.spark, path).select("transition_id", "entity_address", "token_mint", "trigger", "block_time", "signature")


@query("src8_session_replay", oracle("SELECT kind, count(*) AS n, sum(CASE WHEN kind = 'malformed' THEN NULL ELSE bt END)::BIGINT AS times FROM (SELECT CASE WHEN seq % 17 = 0 THEN 'malformed' WHEN direction = 'buy' THEN 'FLOW' ELSE 'WALLET_SIGNAL' END AS kind, bt FROM flows WHERE seq % 19 <> 0 OR seq % 17 = 0) GROUP BY kind", "flows"))
def src8(t):
    """A session log of JSON lines with malformed and blank ones, written and replayed."""
    line = F.to_json(F.struct(F.when(F.col("direction") == "buy", "FLOW").otherwise("WALLET_SIGNAL").alias("event_type"), F.col("bt").alias("timestamp"), "wallet", F.array(F.lit("TIMING")).alias("signals")))
    path = shared.new_path(t.spark, "session-log")
    t.flows.select(F.when(F.col("seq") % 17 == 0, F.concat(F.lit("{not json "), "seq")).when(F.col("seq") % 19 == 0, "  ").otherwise(line).alias("value")).write.text(path)
    rows, bad = files.read_session(t.spark, path)
    both = rows.select(F.col("event_type").alias("kind"), F.col("timestamp").alias("bt")).unionByName(bad.select(F.lit("malformed").alias("kind"), F.lit(None).cast("long").alias("bt")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bt").alias("times"))


@query("src18_names", oracle("SELECT s_suppkey::VARCHAR AS address, s_name AS name FROM supplier WHERE s_suppkey % 7 <> 0"))
def src18(t):
    """Name maps, a JSON object for each nation's wallets with some names null or empty, written and read back."""
    s = t.raw("supplier")
    name = F.when(F.col("s_suppkey") % 14 == 0, F.lit("")).when(F.col("s_suppkey") % 7 != 0, F.col("s_name"))
    entry = F.struct(F.col("s_suppkey").cast("string").alias("key"), name.alias("value"))
    # a map of names is one file by its format; the wallets of a nation go to maps of about a hundred
    part = F.concat_ws("-", "s_nationkey", F.floor(F.col("s_suppkey") / 2500).cast("string"))
    maps = s.groupBy(part.alias("part")).agg(F.to_json(F.map_from_entries(F.collect_list(entry)), {"ignoreNullFields": "false"}).alias("value"))
    path = shared.new_path(t.spark, "names")
    maps.write.partitionBy("part").text(path)
    return files.read_names(t.spark, path)


@query("src22_report_tsv", oracle("SELECT wallet, token, net::VARCHAR AS net, n_buys::VARCHAR AS n_buys FROM pnl", "valid", pnl=T.PNL))
def src22(t):
    """A report written as TSV and read back as text."""
    path = shared.new_path(t.spark, "report")
    files.write_tsv(A.token_pnl(t.valid).select("wallet", "token", F.col("net").cast("string").alias("net"), F.col("n_buys").cast("string").alias("n_buys")), path)
    return files.read_tsv(t.spark, path, ("wallet", "token", "net", "n_buys"))


@query("src16_canonical_columns", oracle("SELECT signature, bt, token FROM trades", "trades"))
def src16(t):
    x = t.trades.select(F.col("signature").alias("Tx_Sig"), F.col("bt").alias("BLOCK_TIME"), F.col("token").alias("base_token_mint"))
    return I.canonicalize(x, {"signature": ("signature", "tx_sig"), "bt": ("ts", "block_time"), "token": ("mint",)})


@query("fn5_token_amounts", oracle("SELECT event_id, CASE event_id % 4 WHEN 0 THEN value WHEN 1 THEN value WHEN 2 THEN round(value * 100) / 100.0::DOUBLE END AS amount FROM events"))
def fn5(t):
    e, k = t.raw("events"), F.col("event_id") % 4
    text = F.when(k == 0, F.col("value").cast("string")).when(k == 1, F.to_json(F.struct(F.col("value").alias("uiAmount")))).when(k == 2, F.to_json(F.struct(F.round(F.col("value") * 100).cast("long").cast("string").alias("amount"), F.lit(2).alias("decimals")))).otherwise("{}")
    return e.select("event_id", S.token_amount(text).alias("amount"))
