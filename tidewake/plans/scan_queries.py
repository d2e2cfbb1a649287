"""Queries over scans of transactions, and the remaining predicates and functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewake.functions import scalar as S
from tidewake.operators import aggregates as A
from tidewake.operators import evidence as V
from tidewake.operators import joins as J
from tidewake.operators import rankings as R
from tidewake.plans import evidence_queries as E
from tidewake.plans import lifecycle_queries as L
from tidewake.plans import trade_queries as T
from tidewake.plans import window_queries as Q
from tidewake.plans.registry import query
from tidewake.sources import ingest as I
from tidewake.sources.canonical import oracle
from tidewake.sources.shared import kept

CREATORS = "SELECT token, arg_min(wallet, (bt, signature, wallet)) AS creator FROM valid GROUP BY token"


@query("src5_rpc_events", oracle("SELECT CASE WHEN dex <> 'pump' THEN 'SWAP' WHEN line % 2 = 0 THEN 'TRANSFER' ELSE 'OTHER' END AS event_type, CASE WHEN dex <> 'pump' THEN dex END AS dex, count(*) AS n, sum(CASE WHEN dex = 'orca' THEN 1 ELSE 2 END)::BIGINT AS actors FROM valid GROUP BY ALL", "valid"))
def src5(t):
    one = F.struct(F.concat(F.lit("p-"), F.col("dex")).alias("programId"), F.when(F.col("line") % 2 == 0, "transfer").alias("parsedType"), F.when(F.col("dex") == "orca", F.array("wallet")).otherwise(F.array().cast("array<string>")).alias("accounts"))
    tx = t.valid.select("signature", F.col("seq").alias("slot"), F.col("bt").alias("blockTime"), F.array(one).alias("instructions"), F.array("wallet", "token").alias("accounts"))
    return I.rpc_events(tx, {"p-raydium": "raydium", "p-orca": "orca"}).groupBy("event_type", "dex").agg(F.count("*").alias("n"), F.sum(F.size("actors")).alias("actors"))


@query("src24_enriched", oracle("SELECT signature, line, wallet, CASE WHEN line % 5 > 0 THEN CASE WHEN flow_direction = 'in' THEN -lamports / 1e9 ELSE lamports / 1e9 END END AS sol_delta, err IS NOT NULL AS failed FROM trades", "trades"))
def src24(t):
    net = F.when(F.col("flow_direction") == "in", -F.col("lamports")).otherwise(F.col("lamports"))
    base = F.lit(10**15).cast("long")
    keys = F.when(F.col("line") % 5 > 0, F.array(F.lit("pool"), F.col("wallet"))).otherwise(F.array(F.lit("pool"), F.lit("other")))
    tx = t.trades.select("signature", "line", "wallet", "err", keys.alias("accountKeys"), F.array(base, base).alias("preBalances"), F.array(base - net, base + net).alias("postBalances"))
    return I.enriched(tx).select("signature", "line", "wallet", "sol_delta", "failed")


@query("src25_mint_accounts", oracle("SELECT p_partkey::VARCHAR AS mint, p_size % 2 = 1 AS has_mint_authority, (p_partkey * 1000003)::DOUBLE AS supply_raw, (p_size % 10)::BIGINT AS decimals, p_size % 3 = 0 AS has_freeze_authority FROM part"))
def src25(t):
    k, n = F.col("p_partkey") * 1_000_003, F.col("p_size")
    le = F.concat(*[F.unhex(F.lpad(F.hex(F.shiftright(k, 8 * i).bitwiseAND(255)), 2, "0")) for i in range(8)])
    one = lambda c: F.unhex(F.lpad(F.hex(c.cast("long")), 2, "0"))
    data = F.concat(one(n % 2), F.unhex(F.lit("00" * 35)), le, one(n % 10), F.unhex(F.lit("01")), one((n % 3 == 0).cast("int")), F.unhex(F.lit("00" * 35)))
    return I.mint_account(t.raw("part").select(F.col("p_partkey").cast("string").alias("mint"), data.alias("data"))).withColumn("supply_raw", F.col("supply_raw").cast("double"))


@query("src11_capped_details", oracle("SELECT token, array_to_string(list_sort(list(DISTINCT wallet))[1:5], ',') AS wallets, CASE WHEN length(string_agg(DISTINCT wallet, ',' ORDER BY wallet)) > 40 THEN substr(string_agg(DISTINCT wallet, ',' ORDER BY wallet), 1, 40) || '...' ELSE string_agg(DISTINCT wallet, ',' ORDER BY wallet) END AS text FROM flows GROUP BY token", "flows"))
def src11(t):
    x = t.flows.groupBy("token").agg(F.array_sort(F.collect_set("wallet")).alias("w"))
    return x.select("token", F.array_join(I.capped(F.col("w")), ",").alias("wallets"), S.capped_text(F.array_join("w", ","), 40).alias("text"))


@query("prj1_swap_like", oracle("SELECT event_type, count(*) AS n FROM events WHERE event_type = 'purchase' OR upper(event_type) LIKE '%PUMP%' GROUP BY event_type"))
def prj1(t):
    e = t.raw("events").where(I.is_swap_like(F.when(F.col("event_type") == "purchase", "SWAP"), F.col("event_type")))
    return e.groupBy("event_type").agg(F.count("*").alias("n"))


@query("prj3_side_class", oracle("SELECT CASE WHEN flow_direction = 'in' AND line <> 3 THEN 'BUY' WHEN flow_direction = 'out' AND line <> 3 THEN 'SELL' ELSE 'OTHER' END AS side, count(*) AS n FROM valid GROUP BY side", "valid"))
def prj3(t):
    buy = (F.col("flow_direction") == "in").cast("int")
    delta = F.when(F.col("line") == 3, 0).when(buy == 1, -1).otherwise(1)
    return t.valid.groupBy(I.side_class(buy, 1 - buy, delta).alias("side")).agg(F.count("*").alias("n"))


@query("prj5_probable_mints", oracle("SELECT signature, lpad(wallet, 40, 'M') AS mint FROM valid WHERE seq % 3 > 0", "valid"))
def prj5(t):
    item = lambda m: F.struct(m.alias("mint"))
    odd = F.when(F.col("seq") % 3 == 0, F.lit(I.WRAPPED)).otherwise(F.lpad("wallet", 40, "M"))
    tx = t.valid.select("signature", F.array(item(odd), item(F.lit("short")), item(odd)).alias("tokenTransfers"))
    return I.created_mints(tx)


@query("prj9_last_hours", oracle("SELECT token, count(*) AS n FROM flows WHERE bt >= (SELECT max(bt) FROM flows) - 7200 GROUP BY token", "flows"))
def prj9(t):
    return I.in_range(t.flows, last_hours=2).groupBy("token").agg(F.count("*").alias("n"))


@query("join19_creator_transfers", oracle("SELECT token, creator, dst, arg_max(signature, (bt, signature)) AS signature, count(*) AS n FROM (SELECT token, wallet AS src, ((line * 13 + seq) % 100 + 1)::VARCHAR AS dst, bt, signature FROM valid) JOIN cr USING (token) WHERE src = creator AND EXISTS (SELECT 1 FROM fb WHERE fb.token = cr.token AND fb.wallet = dst) GROUP BY ALL", "valid", cr=CREATORS, fb=T.FB))
def join19(t):
    tr = t.valid.select("token", F.col("wallet").alias("src"), ((F.col("line") * 13 + F.col("seq")) % 100 + 1).cast("string").alias("dst"), "bt", "signature")
    return V.creator_transfers(tr, V.creators(t.valid), J.first_buys(t.valid))


@query("join20_funded_buyers", oracle("""SELECT b.token, b.creator, b.wallet, coalesce(bool_or(h.hops = 1), false) AS direct, coalesce(min(h.hops) = 2, false) AS indirect FROM (SELECT token, creator, wallet FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY first_buy, wallet) AS n FROM fb JOIN cr USING (token) WHERE wallet <> creator) WHERE n <= 20) b LEFT JOIN (
    SELECT src AS source, dst AS target, 1 AS hops FROM tr WHERE dst <> src UNION SELECT h.src, t.dst, 2 FROM (SELECT src, dst, min(bt) AS bt FROM tr WHERE dst <> src GROUP BY ALL) h JOIN tr t ON t.src = h.dst AND t.bt >= h.bt AND t.dst <> h.src) h ON h.source = b.creator AND h.target = b.wallet GROUP BY ALL""", "valid", cr=CREATORS, fb=T.FB, tr=T.TRANSFERS))  # fmt: skip
def join20(t):
    return funded_rows(t).select("token", "creator", "wallet", "direct", "indirect")


def funded_rows(t):
    """The first 20 buyers of each token besides its creator, with funding flags and the wallets in between."""
    tr = T.repeated_transfers(t.valid)
    cr = V.creators(t.valid)
    x = J.first_buys(t.valid).join(cr.hint("merge"), "token").where("wallet <> creator")
    buyers = R.top(x, ("token",), [F.asc("first_buy"), F.asc("wallet")], 20).select("token", "creator", "wallet")
    buyers = kept(buyers, "buyers")
    return V.funded_buyers(buyers, J.funding_routes(tr, cr.select(F.col("creator").alias("wallet")).distinct(), buyers.select("wallet")))


@query("join22_first_buy_programs", oracle("SELECT d.wallet, d.token, d.s AS signature, t.seq % 4 = 0 AS via_router FROM (SELECT wallet, token, min(signature) AS s FROM (SELECT *, min(bt) OVER (PARTITION BY wallet, token) AS fb FROM valid WHERE flow_direction = 'in') WHERE bt = fb GROUP BY wallet, token) d JOIN (SELECT signature, min(seq) AS seq FROM valid GROUP BY signature) t ON t.signature = d.s", "valid"))
def join22(t):
    tx = t.valid.select("signature", F.when(F.col("seq") % 4 == 0, "budget|jupiter").otherwise("budget|amm").alias("program_path"))
    firsts = A.discovery_features(t.valid).select("wallet", "token", F.col("first_signature").alias("signature"))
    return V.first_buy_programs(firsts, tx).select("wallet", "token", "signature", "via_router")


@query("join23_retained_supply", oracle("SELECT s.token, s.supply::BIGINT AS supply, CASE WHEN supply > 0 THEN coalesce(greatest(balance, 0), 0) / supply END AS retained FROM (SELECT token, sum(greatest(balance, 0)) AS supply FROM bal GROUP BY token) s LEFT JOIN (SELECT cr.token, bal.balance FROM cr JOIN bal ON bal.token = cr.token AND bal.wallet = cr.creator) c USING (token)", "valid", bal=T.BAL, cr=CREATORS))
def join23(t):
    return V.retained_supply(T.balances(t), V.creators(t.valid)).select("token", "supply", "retained")


@query("fn24_seed_verification", oracle("SELECT s.token, CASE WHEN count(t.token) > 0 THEN 'VERIFIED' ELSE 'UNVERIFIED' END AS status FROM (SELECT DISTINCT token FROM valid) s LEFT JOIN (SELECT * FROM tx WHERE seq % 9 = 0) t USING (token) GROUP BY s.token", "valid", tx=E.TX))
def fn24(t):
    s = t.valid.select("token").distinct()
    return V.seed_verification(s, V.creation_evidence(E.transactions(t))).select("token", "status")


@query("fn20_pools", oracle("SELECT signature, CASE WHEN bool_or(seq % 3 = 0) THEN 'field' ELSE 'accounts' END AS method, CASE WHEN bool_or(seq % 3 = 0) THEN 'pool' ELSE min(wallet) END AS pool FROM tx GROUP BY signature", "valid", tx=E.TX))
def fn20(t):
    tx = E.transactions(t).select("signature", F.when(F.col("seq") % 3 == 0, "pool").alias("pool"), F.array("wallet", F.lit("budget"), F.lit("budget")).alias("accounts"))
    return I.pool_of(tx, ("budget",)).select("signature", "method", "pool")


@query("fn19_compute_budget", oracle("SELECT signature, (200000 + seq % 5)::BIGINT AS unit_limit, CASE WHEN seq % 2 = 0 THEN (seq % 100)::BIGINT END AS unit_price, CASE WHEN seq % 2 = 0 THEN (200000 + seq % 5) * (seq % 100) / 1e6 END AS priority_fee FROM tx", "valid", tx=E.TX))
def fn19(t):
    one = lambda kind, v: F.struct(F.lit(kind).alias("kind"), v.cast("long").alias("value"))
    k = F.col("seq")
    data = F.when(k % 2 == 0, F.array(one("limit", 200_000 + k % 5), one("price", k % 100))).otherwise(F.array(one("limit", 200_000 + k % 5)))
    return E.transactions(t).select("signature", I.compute_budget(data).alias("b")).select("signature", "b.*")


@query("fn14_exhaustion", oracle("SELECT token, at, CASE WHEN s >= 0.85 THEN 'CRITICAL' WHEN s >= 0.70 THEN 'SEVERE' WHEN s >= 0.50 THEN 'SIGNIFICANT' WHEN s >= 0.30 THEN 'EARLY' ELSE 'NONE' END AS label FROM (SELECT token, \"at\", count(*) FILTER (at - last > 120) / count(*) AS s FROM (SELECT token, \"at\", wallet, max(bt) AS last FROM flows JOIN p USING (token) WHERE bt <= \"at\" GROUP BY ALL) GROUP BY ALL)".replace("token, at, CASE", "token, \"at\", CASE").replace("(at - last", "(\"at\" - last"), "flows", p=Q.PEAK))
def fn14(t):
    from tidewake.operators.windows import fixed_silence

    x = fixed_silence(t.flows, Q.peaks(t), after=121)
    return x.select("token", "at", S.exhaustion_label(F.col("n_silent") / F.col("n_wallets")).alias("label"))


@query("fn9_dominance", oracle("SELECT token, CASE WHEN b <= 0 AND s <= 0 THEN 'NEUTRAL' WHEN b > s * (1 + 0.12::DOUBLE) THEN 'PUMP' WHEN s > b * (1 + 0.12::DOUBLE) THEN 'DUMP' ELSE 'NEUTRAL' END AS dominant FROM (SELECT token, sum(CASE WHEN direction = 'buy' THEN lamports ELSE 0 END) / 1e9 AS b, sum(CASE WHEN direction = 'buy' THEN 0 ELSE lamports END) / 1e9 AS s FROM flows GROUP BY token)", "flows"))
def fn9(t):
    return A.token_totals(t.flows).select("token", S.dominance(F.col("bought"), F.col("sold")).alias("dominant"))


@query("fn12_conflicts")
def fn12(t):
    from tidewake.operators import archetype as R_

    scored = R_.scores(R_.step_features(t.flows, 600))
    x = R_.timeline(scored, 600).join(scored.select("token", "step", "risk").hint("merge"), ["token", "step"])
    return x.select("token", "step", V.conflict(F.col("direction_level"), F.col("dominant"), F.col("risk") >= R_.RISK_WARNING, F.col("risk") >= R_.RISK_SHOUT).alias("conflict"))


@query("st15_active_wallets", oracle("SELECT token, wallet, n, last_seen FROM (SELECT token, wallet, count(*) AS n, max(bt) AS last_seen, max(max(bt)) OVER (PARTITION BY token) AS t1 FROM flows GROUP BY token, wallet) WHERE t1 - last_seen <= 900", "flows"))
def st15(t):
    now = t.flows.groupBy("token").agg(F.max("bt").alias("at"))
    return V.cleaned(A.wallet_primitives(t.flows), now).select("token", "wallet", "n", "last_seen")


@query("fn3_lenient_casts", oracle("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN -1 ELSE event_id END AS as_long, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id + 0.5 END AS as_double FROM events"))
def fn3(t):
    k = F.col("event_id")
    return t.raw("events").select("event_id", S.lenient(F.when(k % 3 == 0, "n/a").otherwise(F.concat(F.lit(" "), k)), "bigint", -1).alias("as_long"), S.lenient(F.when(k % 3 == 0, "").otherwise(F.concat(k, F.lit(".5 "))), "double").alias("as_double"))


@query("fn26_texts", oracle("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'NULL' ELSE props END AS shown FROM events"))
def fn26(t):
    return t.raw("events").select("event_id", S.or_null_token(F.when(F.col("event_id") % 4 > 0, F.col("props"))).alias("shown"))


@query("prj6_mint_transfers", oracle("SELECT token, count(*) AS n FROM flows GROUP BY token", "flows"))
def prj6(t):
    x = L.landed_swaps(t).where(F.exists("tokenTransfers", lambda m: m["mint"] == F.col("token")))
    return x.groupBy("token").agg(F.count("*").alias("n"))
