"""Queries over raw transactions: creation evidence, programs, tips, recorders, and reports on creators."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import scalar as S
from tidewake.operators import evidence as V
from tidewake.operators import machine as M
from tidewake.operators import windows as W
from tidewake.plans import lifecycle_queries as L
from tidewake.plans import position_queries as P
from tidewake.plans import trade_queries as T
from tidewake.plans import window_queries as Q
from tidewake.plans.registry import query
from tidewake.sources import ingest as I
from tidewake.sources.canonical import oracle


def transactions(t):
    """Transactions with signers, instructions, programs, native transfers and fees, built from trades."""
    return t.valid.groupBy("signature").agg(F.min(F.struct("bt", "wallet", "token", "lamports", "units", "seq", "line", "dex", "flow_direction")).alias("x")).select("signature", "x.*").select(
        "*", F.array("wallet").alias("signers"), F.col("wallet").alias("feePayer"), (5000 + F.col("seq") % 7 * 100).alias("fee"), F.array(F.concat(F.lit("p"), F.col("dex")), F.lit("budget")).alias("programs"),
        F.when(F.col("seq") % 4 == 0, F.array(F.lit("jupiter"), F.lit("budget"))).alias("declared"),
        F.when(F.col("seq") % 9 == 0, F.array(F.lit("initializeMint"), F.lit("createAccount"))).when(F.col("seq") % 9 == 1, F.array(F.lit("createAccount"))).otherwise(F.array(F.lit("swap"))).alias("kinds"),
        F.array(F.struct(F.col("wallet").alias("src"), F.when(F.col("seq") % 5 == 0, F.concat(F.lit("tip"), F.col("seq") % 3)).otherwise(F.lit("pool")).alias("dst"), F.col("lamports").alias("amount"))).alias("transfers"),
    )


TX = """SELECT signature, x.bt AS bt, x.wallet AS wallet, x.token AS token, x.lamports AS lamports, x.units AS units, x.seq AS seq, x.line AS line, x.dex AS dex FROM (SELECT signature, min({'bt': bt, 'wallet': wallet, 'token': token, 'lamports': lamports, 'units': units, 'seq': seq, 'line': line, 'dex': dex}) AS x FROM valid GROUP BY signature)"""


@query("fn23_creation_evidence", oracle("SELECT signature, seq % 9 = 0 AS initialized, seq % 9 <= 1 AS created, CASE WHEN seq % 9 = 0 THEN 'CONFIRMED' WHEN seq % 9 = 1 THEN 'PARTIAL' ELSE 'NONE' END AS status FROM tx", "valid", tx=TX))
def fn23(t):
    return V.creation_evidence(transactions(t)).select("signature", "initialized", "created", "status")


@query("prj15_created_tokens", oracle("SELECT t.wallet, t.token, min(t.bt) AS created_at, min(n.primary_pool) AS pool FROM tx t LEFT JOIN mint_liquidity n USING (token) WHERE t.seq % 9 = 0 GROUP BY t.wallet, t.token", "valid", "mint_liquidity", tx=TX))
def prj15(t):
    return V.created_tokens(transactions(t), t.mint_liquidity.select("token", F.col("primary_pool").alias("pool")))


@query("join15_programs", oracle("SELECT signature, CASE WHEN seq % 4 = 0 THEN 'budget,jupiter,p' || dex ELSE 'budget,p' || dex END AS programs, CASE WHEN seq % 4 = 0 THEN 'aggregator' ELSE dex END AS route FROM tx", "valid", tx=TX))
def join15(t):
    tx = transactions(t)
    x = V.programs_of(tx.select("signature", "programs", "dex"), tx.where("declared IS NOT NULL").select("signature", "declared"))
    return x.select("signature", F.array_join("programs", ",").alias("programs"), V.route(F.col("programs"), F.col("dex")).alias("route"))


@query("join16_tips", oracle("SELECT wallet, count(*) AS n_tips, sum(lamports)::BIGINT AS tipped FROM tx WHERE seq % 5 = 0 GROUP BY wallet", "valid", tx=TX))
def join16(t):
    tips = t.spark.range(3).select(F.concat(F.lit("tip"), F.col("id")).alias("account"))
    return V.tips(transactions(t), tips)


@query("prj14_priority_rows", oracle("SELECT wallet, count(*) AS n, sum(5000 + seq % 7 * 100)::BIGINT AS fees, max(5000 + seq % 7 * 100) AS most FROM tx GROUP BY wallet", "valid", tx=TX))
def prj14(t):
    return transactions(t).groupBy("wallet").agg(F.count("*").alias("n"), F.sum("fee").alias("fees"), F.max("fee").alias("most"))


@query("prj4_signed_by", oracle("SELECT m.group_id, count(*) AS n FROM tx t JOIN members m USING (wallet) GROUP BY m.group_id", "valid", "members", tx=TX))
def prj4(t):
    x = transactions(t).join(t.members.hint("merge"), "wallet").where(V.signed_by(F.col("wallet")))
    return x.groupBy("group_id").agg(F.count("*").alias("n"))


@query("agg19_creator_totals", oracle("""SELECT token, creator, sum(CASE WHEN wallet = creator AND flow_direction = 'in' THEN lamports ELSE 0 END)::BIGINT AS bought, sum(CASE WHEN wallet = creator AND flow_direction = 'out' THEN lamports ELSE 0 END)::BIGINT AS sold, min(bt) FILTER (wallet = creator AND flow_direction = 'out') AS first_sell,
  coalesce(min(bt) FILTER (wallet = creator AND flow_direction = 'out') - min(bt) <= 2592000, false) AS exited_early FROM valid JOIN (SELECT token, arg_min(wallet, (bt, signature, wallet)) AS creator FROM valid GROUP BY token) USING (token) GROUP BY token, creator""", "valid"))  # fmt: skip
def agg19(t):
    return V.creator_totals(t.valid, V.creators(t.valid))


@query("agg20_creator_summary", oracle("""SELECT creator, count(*) AS n_tokens, count(first_sell) AS n_sold, median(first_sell - t0) AS median_delay FROM (SELECT token, creator, min(bt) AS t0, min(bt) FILTER (wallet = creator AND flow_direction = 'out') AS first_sell FROM valid
  JOIN (SELECT token, arg_min(wallet, (bt, signature, wallet)) AS creator FROM valid GROUP BY token) USING (token) GROUP BY token, creator) GROUP BY creator""", "valid"))  # fmt: skip
def agg20(t):
    return V.creator_summary(t.valid, V.creators(t.valid))


@query("fn25_creator_flows", oracle("""SELECT v.token, CASE WHEN flow_direction = 'in' THEN 'BUY' WHEN units >= 40 THEN 'TRANSFER_OUT' ELSE 'SELL' END AS kind, count(*) AS n FROM valid v JOIN (SELECT token, arg_min(wallet, (bt, signature, wallet)) AS wallet, min(bt) AS t0 FROM valid GROUP BY token) c ON c.token = v.token AND c.wallet = v.wallet
  WHERE v.bt BETWEEN t0 - 300 AND t0 + 86400 * 365 GROUP BY ALL""", "valid"))  # fmt: skip
def fn25(t):
    x = V.creator_flows(t.valid, V.creators(t.valid), 300, 86_400 * 365, F.col("units") >= 40)
    return x.groupBy("token", "kind").agg(F.count("*").alias("n"))


@query("win30_first_buy_rows", oracle("SELECT token, wallet, signature, bt FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY bt, signature, wallet) AS n FROM valid WHERE flow_direction = 'in') WHERE n = 1", "valid"))
def win30(t):
    return V.first_row(t.valid.where("flow_direction = 'in'"), "token", ["bt", "signature", "wallet"]).select("token", "wallet", "signature", "bt")


@query("win31_slot_audit", oracle("""SELECT b.wallet, b.token, b.first_buy, coalesce(g.bt, h.bt) AS first_swap, b.first_buy - coalesce(g.bt, h.bt) AS delta FROM fb b LEFT JOIN (SELECT token, min(bt) AS bt FROM valid WHERE dex = 'pump' AND flow_direction = 'out' GROUP BY token) g ON g.token = b.token AND g.bt <= b.first_buy
  LEFT JOIN (SELECT b.wallet, b.token, min(v.bt) AS bt FROM fb b JOIN valid v ON v.token = b.token AND v.bt BETWEEN b.first_buy - 86400 AND b.first_buy GROUP BY ALL) h ON h.wallet = b.wallet AND h.token = b.token""", "valid", fb=T.FB))  # fmt: skip
def win31(t):
    triggers = t.valid.where("dex = 'pump' AND flow_direction = 'out'").groupBy("token").agg(F.min("bt").alias("bt"))
    from tidewake.operators.joins import first_buys

    return V.slot_audit(first_buys(t.valid), triggers, t.valid, 86_400)


@query("win32_trigger_deltas", oracle("""SELECT token, min(bt) AS first_swap, arg_min(wallet, (bt, signature, wallet)) AS deployer, array_to_string(list_sort(list(DISTINCT dex) FILTER (n <= 3)), ',') AS programs FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY bt, signature, wallet) AS n FROM valid) GROUP BY token""", "valid"))
def win32(t):
    return V.trigger_rows(t.valid)


@query("agg29_duplicate_signals", oracle("""SELECT combination, count(*) AS n, count(DISTINCT (wallet, bt)) AS n_distinct FROM (SELECT token, wallet, bt, seq, string_agg(event_type, '+' ORDER BY event_type) AS combination FROM crossings GROUP BY ALL) GROUP BY combination""", "flows", rolling=Q.ROLLING, crossings=Q.CROSSINGS))
def agg29(t):
    from tidewake.operators.aggregates import duplicate_signals

    x = W.whale_crossings(t.flows).groupBy("token", "wallet", "bt", "seq").agg(F.collect_list("event_type").alias("signals"))
    return duplicate_signals(x)


@query("st9_signal_rows", oracle("""SELECT c.token, c.wallet, c.bt, c.seq, array_to_string(list_filter([CASE WHEN e.delta <= 300 THEN 'TIMING' END, CASE WHEN len(list_distinct(k.ws)) >= 3 THEN 'COORDINATION' END, CASE WHEN p.wallet IS NOT NULL THEN 'PERSISTENCE' END], lambda s: s IS NOT NULL), ',') AS signals
  FROM f c LEFT JOIN (SELECT token, wallet, min(bt) - min(min(bt)) OVER (PARTITION BY token) AS delta FROM flows GROUP BY token, wallet) e USING (token, wallet) LEFT JOIN (SELECT token, seq, list(wallet) OVER (PARTITION BY token ORDER BY bt RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) AS ws FROM f) k USING (token, seq)
  LEFT JOIN (SELECT token, wallet FROM (SELECT *, minute - lag(minute) OVER (PARTITION BY token, wallet ORDER BY minute) AS gap FROM (SELECT DISTINCT token, wallet, bt // 60 * 60 AS minute FROM flows)) GROUP BY token, wallet HAVING count(*) >= 2 AND max(gap) <= 20000) p USING (token, wallet)""", "flows", rolling=Q.ROLLING, crossings=Q.CROSSINGS, f=Q.FIRST_EVENT))  # fmt: skip
def st9(t):
    x = V.signal_rows(t.flows, persistence_gap=20_000)
    return x.select("token", "wallet", "bt", "seq", F.array_join("signals", ",").alias("signals"))


@query("st8_exhaustion_steps", oracle("""SELECT token, "at", share FROM (SELECT *, floor(share * 10) AS s, max(floor(share * 10)) OVER (PARTITION BY token ORDER BY "at" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT token, "at", n_silent / n_seen AS share FROM (
    SELECT s.token, s."at", count(*) AS n_seen, count(*) FILTER (last < s."at" - 120) AS n_silent FROM (SELECT s.token, s."at", f.wallet, max(f.bt) AS last FROM (SELECT token, unnest(range(t0, t1 + 1, 600)) AS "at" FROM (SELECT token, min(bt) AS t0, max(bt) AS t1 FROM flows GROUP BY token)) s
    JOIN flows f ON f.token = s.token AND f.bt <= s."at" GROUP BY ALL) s GROUP BY ALL))) WHERE share >= 0.6 AND (before IS NULL OR before < 6 OR s > before)""", "flows"))  # fmt: skip
def st8(t):
    return V.exhaustion_steps(W.silence_curve(t.flows, (120,), 600))


@query("st12_alerts", oracle("""SELECT token, kind, arg_max(wallet, (bt, seq)) AS wallet, max(bt) AS bt FROM (SELECT token, 'NEW_ENTRY' AS kind, wallet, bt, seq FROM (SELECT *, row_number() OVER (PARTITION BY token, wallet ORDER BY bt, seq) AS n FROM verdicts WHERE tier >= 2) WHERE n = 1 UNION ALL
  SELECT token, 'FLIP', wallet, bt, seq FROM (SELECT *, lag(verdict) OVER (PARTITION BY token, wallet ORDER BY bt, seq) AS previous FROM verdicts) WHERE previous IN ('ACCUMULATING', 'BUILDING') AND verdict = 'FLIPPING') GROUP BY token, kind""", "flows", **P._V))  # fmt: skip
def st12(t):
    v = P.verdicts(t)
    return V.alerts({"NEW_ENTRY": V.first_row(v.where("tier >= 2"), ("token", "wallet"), ["bt", "seq"]), "FLIP": W.verdict_flips(v)})


@query("st5_second_rules")
def st5(t):
    return V.transitions_v2(t.flows)


@query("st17_replay_matches")
def st17(t):
    """Transitions of each token in two runs of the fold over the same flows, in other partitions, and rows in which the runs differ (0)."""
    from tidewake.operators.joins import diff

    cols = ["token", "bt", "seq", "from_state", "to_state"]
    one, two = M.transitions(t.flows).select(*cols), M.transitions(t.flows, 3).select(*cols)
    odd = diff(one, two).groupBy("token").agg(F.sum("n").alias("n_different"))
    count = lambda x, name: x.groupBy("token").agg(F.count("*").alias(name))
    x = count(one, "n_first").join(count(two, "n_second").hint("merge"), "token", "full").join(odd.hint("merge"), "token", "left")
    return x.fillna(0, ["n_first", "n_second", "n_different"])


@query("st11_verdict_record", oracle("""SELECT token, arg_max(CASE WHEN vol > 0 AND abs(net) / vol >= 0.15 THEN sign(net)::INT * 2 ELSE sign(net)::INT END, token) AS capital, any_value(silent) AS silent_share, CASE WHEN any_value(silent) >= 0.85 THEN 'CRITICAL' WHEN any_value(silent) >= 0.70 THEN 'SEVERE' WHEN any_value(silent) >= 0.50 THEN 'SIGNIFICANT' WHEN any_value(silent) >= 0.30 THEN 'EARLY' ELSE 'NONE' END AS exhaustion
  FROM (SELECT token, sum(CASE WHEN direction = 'buy' THEN lamports ELSE -lamports END) AS net, sum(lamports) AS vol FROM flows GROUP BY token) JOIN (SELECT token, count(*) FILTER (t1 - last > 120) / count(*) AS silent FROM (SELECT token, wallet, max(bt) AS last, max(max(bt)) OVER (PARTITION BY token) AS t1 FROM flows GROUP BY token, wallet) GROUP BY token) USING (token) GROUP BY token""", "flows"))  # fmt: skip
def st11(t):
    return V.verdict_record(t.flows)


@query("src13_recorder_dedupe", oracle("SELECT signature, bt FROM (SELECT *, row_number() OVER (PARTITION BY signature ORDER BY line_no, bt) AS n FROM (SELECT CASE WHEN seq % 11 = 0 THEN NULL ELSE signature END AS signature, bt, seq * 8 + line AS line_no FROM trades)) WHERE n = 1 OR signature IS NULL", "trades"))
def src13(t):
    from tidewake.operators.rankings import first_by

    x = t.trades.select(F.when(F.col("seq") % 11 > 0, F.col("signature")).alias("sig0"), F.col("bt").alias("tx_time"), (F.col("seq") * 8 + F.col("line")).alias("line_no"))
    x = I.canonicalize(x, {"signature": ("signature", "sig", "sig0"), "bt": ("block_time", "tx_time"), "line_no": ("line_no",)})
    return first_by(x, "signature", [F.asc("line_no"), F.asc("bt")]).select("signature", "bt")


@query("src17_seeds", oracle("SELECT s AS seed, min(line_no) AS line_no FROM (SELECT trim(CASE WHEN s_suppkey % 3 = 0 THEN '# ' || s_name WHEN s_suppkey % 5 = 0 THEN ' ' ELSE ' ' || (s_suppkey % 20) || ' ' END) AS s, s_suppkey AS line_no FROM supplier) WHERE s <> '' AND NOT starts_with(s, '#') GROUP BY s"))
def src17(t):
    k = F.col("s_suppkey")
    v = F.when(k % 3 == 0, F.concat(F.lit("# "), F.col("s_name"))).when(k % 5 == 0, " ").otherwise(F.concat(F.lit(" "), k % 20, F.lit(" ")))
    return I.seeds_from_text(t.raw("supplier").select(v.alias("value"), k.alias("line_no")))


@query("src12_strict_trades", oracle("SELECT error, count(*) AS n FROM (SELECT CASE WHEN roi IS NULL THEN 'roi' WHEN exit IS NULL OR entry IS NULL THEN 'missing time' WHEN exit < entry THEN 'exit before entry' END AS error FROM recon) GROUP BY error", "valid", recon=T.RECON))
def src12(t):
    from tidewake.operators.aggregates import reconstruct

    x = reconstruct(t.valid).select("token", *[F.col(c).cast("string").alias(c) for c in ("entry", "exit", "roi")])
    return I.checked_trades(x).groupBy("error").agg(F.count("*").alias("n"))


@query("src27_side_tables", oracle("SELECT m.token, (m.mint_authority IS NOT NULL)::INT AS mintable, (m.freeze_authority IS NOT NULL)::INT AS freezable, m.is_mutable::INT AS mutable, coalesce(sum(e.amount), 0)::BIGINT AS added FROM mint_metadata m LEFT JOIN (SELECT * FROM liquidity_events WHERE action = 'add') e USING (token) GROUP BY ALL", "mint_metadata", "liquidity_events"))
def src27(t):
    return I.side_tables(t.mint_metadata, t.liquidity_events)


_DAY = 86_400
_SIGNS = f"""SELECT token, removed > 0 AND sold > bought AS vampire, (mintable OR freezable) AND gini > 0.08::DOUBLE AS time_bomb, density > 0.2::DOUBLE AND 1 / (1 + mad / mean) > 0.6::DOUBLE AS bot_farm, gap >= {30 * _DAY} AND bought > sold AS phoenix, last < (SELECT max(bt) FROM valid) - {20 * _DAY} AS ghost, bought > sold AS accumulator, sold > bought AS distributor
  FROM (SELECT token, sum(CASE WHEN flow_direction = 'in' THEN lamports ELSE 0 END) AS bought, sum(CASE WHEN flow_direction = 'out' THEN lamports ELSE 0 END) AS sold, max(bt) AS last, sum(lamports) / count(*) AS mean FROM valid GROUP BY token)
  JOIN (SELECT token, avg(abs(v.lamports - m.mean)) AS mad FROM valid v JOIN (SELECT token, sum(lamports) / count(*) AS mean FROM valid GROUP BY token) m USING (token) GROUP BY token) USING (token)
  JOIN (SELECT token, coalesce(max(bt - prev), 0) AS gap FROM (SELECT token, bt, lag(bt) OVER (PARTITION BY token ORDER BY bt) AS prev FROM valid) GROUP BY token) USING (token)
  JOIN (SELECT token, sum(c) FILTER (r <= 10) / sum(c) AS density FROM (SELECT token, wallet, count(*) AS c, row_number() OVER (PARTITION BY token ORDER BY count(*) DESC, wallet) AS r FROM valid GROUP BY token, wallet) GROUP BY token) USING (token)
  LEFT JOIN (SELECT token, round(2 * sum(i * b) / (count(*) * sum(b)) - (count(*) + 1) / count(*), 6) AS gini FROM (SELECT token, b, row_number() OVER (PARTITION BY token ORDER BY b, wallet) AS i FROM (SELECT token, wallet, sum(CASE WHEN flow_direction = 'in' THEN units ELSE -units END) AS b FROM valid GROUP BY token, wallet) WHERE b > 0) GROUP BY token) USING (token)
  LEFT JOIN (SELECT token, count(*) AS removed FROM liquidity_events WHERE action = 'remove' GROUP BY token) USING (token) LEFT JOIN (SELECT token, mint_authority IS NOT NULL AS mintable, freeze_authority IS NOT NULL AS freezable FROM mint_metadata) USING (token)"""
_NAMES = "[" + ", ".join(f"CASE WHEN {key} THEN '{name}' END" for name, key, _ in S.ARCHETYPES) + "]"
_REASONS = "[" + ", ".join(f"CASE WHEN {key} THEN '{text}' END" for _, key, text in S.ARCHETYPES) + "]"


@query("fn10_archetypes", oracle(f"""SELECT token, coalesce(list_filter({_NAMES}, lambda x: x IS NOT NULL)[1], 'The Ghost') AS archetype, CASE WHEN len(list_filter({_REASONS}, lambda x: x IS NOT NULL)) = 0 THEN 'mixed low-signal state' ELSE array_to_string(list_filter({_REASONS}, lambda x: x IS NOT NULL)[1:2], '; ') END AS reason FROM signs""", "valid", "mint_metadata", "liquidity_events", signs=_SIGNS))
def fn10(t):
    """Archetype of each traded token over its whole life, from all seven signals."""
    from tidewake.operators import aggregates as A

    v = t.valid
    x = v.groupBy("token").agg(F.sum(F.when(A.is_in(), F.col("lamports")).otherwise(0)).alias("bought"), F.sum(F.when(A.is_out(), F.col("lamports")).otherwise(0)).alias("sold"), F.max("bt").alias("last"), (F.sum("lamports") / F.count("*")).alias("mean"))
    gaps = W.longest_pauses(v)
    per = v.groupBy("token", "wallet").agg(F.count("*").alias("c"), F.sum(F.when(A.is_in(), F.col("units")).otherwise(-F.col("units"))).alias("balance"))
    busy = A.busiest_share(per.select("token", "wallet", "c"))
    removed = t.liquidity_events.where("action = 'remove'").groupBy("token").agg(F.count("*").alias("removed"))
    parts = (A.mean_absolute_deviation(v, ("token",), "lamports"), gaps, busy, A.gini(per, ("token",)).select("token", "gini"), removed, t.mint_metadata, x.groupBy().agg(F.max("last").alias("end")))
    for y in parts[:-1]:
        x = x.join(y.hint("merge"), "token", "left")
    x = x.join(F.broadcast(parts[-1]))  # one row
    up, down = F.col("bought") > F.col("sold"), F.col("sold") > F.col("bought")
    x = x.withColumns({
        "vampire": (F.col("removed") > 0) & down, "time_bomb": (F.col("mint_authority").isNotNull() | F.col("freeze_authority").isNotNull()) & (F.col("gini") > 0.08), "bot_farm": (F.col("density") > 0.2) & (1 / (1 + F.col("mad") / F.col("mean")) > 0.6),
        "phoenix": (F.col("gap") >= 30 * _DAY) & up, "ghost": F.col("last") < F.col("end") - 20 * _DAY, "accumulator": up, "distributor": down,
    })
    return x.select("token", S.archetype(F.lit("The Ghost"), F.lit(True)).alias("archetype"), S.archetype_reason().alias("reason"))


@query("fn15_severity_counts")
def fn15(t):
    return L.M.transitions(t.flows).groupBy("to_state", "severity").agg(F.count("*").alias("n"))


@query("fn27_phases")
def fn27(t):
    """The phase of each token's transitions, and the letter of its episode's cluster, over the life cycle."""
    x = M.transitions(t.flows)
    return x.groupBy("token", "episode", S.phase(F.col("to_state")).alias("phase"), S.cluster_letter(F.col("episode")).alias("letter")).agg(F.count("*").alias("n"))


@query("fn27_wave_phases", oracle("""SELECT token, wave, CASE (wave - w0) % 10 WHEN 0 THEN 'Dead' WHEN 1 THEN 'Igniting' WHEN 2 THEN 'Coordinating' WHEN 3 THEN 'Early Entry' WHEN 4 THEN 'Building' WHEN 5 THEN 'Expanding' WHEN 6 THEN 'Peak Pressure' WHEN 7 THEN 'Exhausting' WHEN 8 THEN 'Dying' ELSE 'UNKNOWN' END AS phase, chr((65 + (wave - w0) % 26)::INT) AS letter
  FROM (SELECT DISTINCT token, bt // 7200 AS wave, min(bt // 7200) OVER (PARTITION BY token) AS w0 FROM flows)""", "flows"))  # fmt: skip
def fn27_waves(t):
    """Phases and letters by the number of each token's wave, all states and the alphabet's turn included."""
    x = t.flows.select("token", F.floor(F.col("bt") / 7200).alias("wave")).distinct()
    first = x.groupBy("token").agg(F.min("wave").alias("first"))
    x = x.join(first.hint("merge"), "token").withColumn("k", F.col("wave") - F.col("first"))
    states = F.array(*[F.lit(s) for s in (*S.PHASES, "OTHER")])
    return x.select("token", "wave", S.phase(F.get(states, (F.col("k") % 10).cast("int"))).alias("phase"), S.cluster_letter(F.col("k") + 1).alias("letter"))
