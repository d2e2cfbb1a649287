"""Scans, validation and normalisation of swaps, and sinks. Shapes are fixed schemas; JSON that does not fit gives nulls, never a failure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SWAP_SCHEMA = """signature string, timestamp long, type string, source string, slot long, feePayer string,
  accountData array<struct<account: string, nativeBalanceChange: long>>, nativeTransfers array<struct<fromUserAccount: string, toUserAccount: string, amount: long>>,
  tokenTransfers array<struct<mint: string, tokenAmount: double, fromUserAccount: string, toUserAccount: string>>"""
WALLET_LENGTH, EARLIEST = 44, 1_600_000_000
# Fixed value: the address of the wrapped native token.
WRAPPED = "So11111111111111111111111111111111111111112"


def read_swaps(spark: SparkSession, path: str) -> DataFrame:
    """Landed swap transactions, one JSON object a line; of a malformed line only its text is kept, in corrupt."""
    x = spark.read.text(path).where(F.trim("value") != "")
    bad = F.try_parse_json("value").isNull()
    return x.select(F.from_json(F.when(~bad, F.col("value")), SWAP_SCHEMA).alias("r"), F.when(bad, F.col("value")).alias("corrupt")).select("r.*", "corrupt")


def parse_swaps(tx: DataFrame, token: str = "token") -> DataFrame:
    """SRC-1: flows of swap transactions of a full-length payer: the payer's balance change, else its first transfer in or out; its sign is the side."""
    payer = F.col("feePayer")
    change = F.get(F.filter("accountData", lambda a: a["account"] == payer), F.lit(0))["nativeBalanceChange"]
    moved = F.get(F.filter("nativeTransfers", lambda t: (t["fromUserAccount"] == payer) | (t["toUserAccount"] == payer)), F.lit(0))
    net = F.coalesce(F.when(change != 0, change), F.when(moved["fromUserAccount"] == payer, -moved["amount"]).otherwise(moved["amount"]))
    x = tx.where((F.col("type") == "SWAP") & F.col("signature").isNotNull() & F.col("timestamp").isNotNull() & (F.length("feePayer") == WALLET_LENGTH)).withColumn("_net", net)
    return x.where("_net <> 0").select("signature", F.col("timestamp").alias("bt"), payer.alias("wallet"), token, F.when(F.col("_net") < 0, "buy").otherwise("sell").alias("direction"), F.abs("_net").alias("lamports"))


def parse_transfers(tx: DataFrame, token: str = "token") -> DataFrame:
    """SRC-4: flows from the first transfer of the token: a sender sells, else a receiver buys; SOL is the sum of all native transfers, else the token amount."""
    first = F.get(F.filter("tokenTransfers", lambda t: t["mint"] == F.col(token)), F.lit(0))
    x = tx.withColumn("_t", first).where("_t IS NOT NULL")
    seller, buyer = F.nullif(F.col("_t.fromUserAccount"), F.lit("")), F.nullif(F.col("_t.toUserAccount"), F.lit(""))
    sol = F.aggregate(F.coalesce("nativeTransfers", F.array()), F.lit(0).cast("long"), lambda a, t: a + F.coalesce(t["amount"], F.lit(0))) / 1e9
    side = F.when(seller.isNotNull(), "sell").when(buyer.isNotNull(), "buy")
    return x.where(F.coalesce(seller, buyer).isNotNull()).select("signature", F.col("timestamp").alias("bt"), F.coalesce(seller, buyer).alias("wallet"), token, side.alias("direction"), F.when(sol > 0, sol).otherwise(F.col("_t.tokenAmount")).alias("amount_sol"))


def validated(raw: DataFrame, now: int, mode: str = "strict") -> DataFrame:
    """SRC-2, SRC-3: raw flows (wallet, timestamp, direction, amount_sol, signature, token_ca as text or numbers) typed, with error: the first fault, null if none.

    lenient trims directions, takes absolute amounts and any positive time.
    """
    amount, at = F.col("amount_sol").try_cast("double"), F.col("timestamp").try_cast("long")
    side = F.lower(F.col("direction"))
    if mode == "lenient":
        amount, side = F.abs(amount), F.trim(side)
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    error = (
        F.when(blank("wallet"), "missing wallet").when(at.isNull(), "missing timestamp").when(side.isNull(), "missing direction").when(amount.isNull(), "missing amount_sol").when(blank("signature"), "missing signature").when(blank("token_ca"), "missing token_ca")
        .when(F.length("wallet") != WALLET_LENGTH, "bad wallet").when(at < (EARLIEST if mode == "strict" else 1), "bad timestamp").when(F.lit(mode == "strict") & (at > now + 60), "future timestamp")
        .when(~side.isin("buy", "sell"), "bad direction").when(amount <= 0, "bad amount")
    )
    return raw.select("wallet", at.alias("bt"), side.alias("direction"), amount.alias("amount_sol"), "signature", F.col("token_ca").alias("token"), error.alias("error"))


def is_swap_like(kind: Column, source: Column) -> Column:
    """PRJ-1."""
    return (kind == "SWAP") | F.upper(source).rlike("RAYDIUM|JUPITER|ORCA|PUMP|METEORA")


def derived_flow(tx: DataFrame, token: str = "token", wallet: str = "wallet") -> DataFrame:
    """PRJ-2: token and SOL change of the wallet in each transaction, its side, and reasons why a row is odd."""
    side_sum = lambda arr, field, who, value: F.aggregate(F.filter(arr, lambda t: (t[field] == F.col(who)) & F.coalesce(value(t)[1], F.lit(True))), F.lit(0.0), lambda a, t: a + F.coalesce(value(t)[0].cast("double"), F.lit(0.0)))
    tok, nat = (lambda t: (t["tokenAmount"], t["mint"] == F.col(token))), (lambda t: (t["amount"], F.lit(True)))
    x = tx.withColumn("token_net", side_sum("tokenTransfers", "toUserAccount", wallet, tok) - side_sum("tokenTransfers", "fromUserAccount", wallet, tok))
    x = x.withColumn("sol_net", (side_sum("nativeTransfers", "toUserAccount", wallet, nat) - side_sum("nativeTransfers", "fromUserAccount", wallet, nat)) / 1e9)
    side = F.when((F.col("token_net") > 0) & (F.col("sol_net") < 0), "BUY").when((F.col("token_net") < 0) & (F.col("sol_net") > 0), "SELL").otherwise("OTHER")
    odd = F.array_compact(F.array(F.when(F.col("token_net") == 0, "no_token_change"), F.when(F.col("sol_net") == 0, "no_sol_change"), F.when((F.signum("token_net") == F.signum("sol_net")) & (F.col("token_net") != 0), "same_sign")))
    return x.withColumn("side", side).withColumn("anomalies", F.array_join(odd, ";"))


def mint_parties(tx: DataFrame, token: str = "token") -> DataFrame:
    """PRJ-6, PRJ-7: distinct receivers and senders of the token in each transaction that transfers it."""
    of = F.filter("tokenTransfers", lambda t: t["mint"] == F.col(token))
    who = lambda f: F.array_sort(F.array_distinct(F.filter(F.transform(of, lambda t: t[f]), lambda w: w.isNotNull() & (w != ""))))
    x = tx.where(F.exists("tokenTransfers", lambda t: t["mint"] == F.col(token)))
    return x.select("signature", token, who("toUserAccount").alias("buyers"), who("fromUserAccount").alias("sellers"))


def created_mints(tx: DataFrame) -> DataFrame:
    """PRJ-5: probable mints in a transaction's transfers: 32 to 44 characters, not the wrapped native token."""
    ok = lambda m: (F.length(m).between(32, 44)) & (m != WRAPPED)
    return tx.select("signature", F.explode(F.array_distinct(F.filter(F.transform("tokenTransfers", lambda t: t["mint"]), ok))).alias("mint"))


def balance_changes(tx: DataFrame) -> DataFrame:
    """JOIN-17: signed token changes between the balances before and after (arrays of index, mint, owner, amount), zero changes left out."""
    side = lambda c, sign: tx.select("signature", F.explode(c).alias("b")).select("signature", "b.index", "b.mint", "b.owner", (F.lit(sign) * F.col("b.amount").cast("decimal(38,0)")).alias("x"))
    x = side("pre", -1).unionAll(side("post", 1))
    return x.groupBy("signature", "index", "mint", "owner").agg(F.sum("x").alias("delta")).where("delta <> 0")


def sol_mints(swaps: DataFrame) -> DataFrame:
    """FN-21: mints (mint, n) that stand for SOL in swaps (in_mint, out_mint): those with a known name, else all that contain sol."""
    from tidewake.functions.scalar import SOL_NAMES

    x = swaps.select(F.explode(F.array("in_mint", "out_mint")).alias("mint")).where(F.lower("mint").contains("sol") | F.lower("mint").isin(*SOL_NAMES)).groupBy("mint").agg(F.count("*").alias("n"))
    sure = F.lower("mint").isin(*SOL_NAMES)
    any_sure = x.groupBy().agg(F.coalesce(F.max(sure), F.lit(False)).alias("_any"))
    return x.join(F.broadcast(any_sure)).where(sure | ~F.col("_any")).drop("_any")  # one row


def swap_legs(swaps: DataFrame, natives: tuple[str, ...] = (WRAPPED, "SOL", "sol")) -> DataFrame:
    """FN-21, FN-22: legs (in_mint, in_amount, out_mint, out_amount) as mint, token_delta, sol_delta; rows with SOL on both or no side go."""
    sol = lambda c: F.col(c).isin(*natives)
    x = swaps.where(sol("in_mint") != sol("out_mint"))
    spent = sol("in_mint")
    return x.select("signature", F.when(spent, F.col("out_mint")).otherwise(F.col("in_mint")).alias("mint"), F.when(spent, F.col("out_amount")).otherwise(-F.col("in_amount")).alias("token_delta"), F.when(spent, -F.col("in_amount")).otherwise(F.col("out_amount")).alias("sol_delta"))


def canonicalize(df: DataFrame, aliases: dict[str, tuple[str, ...]]) -> DataFrame:
    """SRC-16: the named columns, each from the first alias that df has (letter case aside), else from the only column that contains one; ValueError if none or more fit."""
    lower = {c.lower(): c for c in df.columns}
    out = []
    for name, options in aliases.items():
        found = next((lower[o.lower()] for o in options if o.lower() in lower), None)
        if found is None:
            part = sorted({c for low, c in lower.items() for o in options if o.lower() in low})
            if len(part) != 1:
                raise ValueError(f"{name}: {'no column' if not part else 'several columns: ' + ', '.join(part)}")
            found = part[0]
        out.append(F.col(f"`{found}`").alias(name))
    return df.select(*out)


def seeds_from_text(lines: DataFrame) -> DataFrame:
    """SRC-17: trimmed, distinct values of lines that are neither blank nor comments, with the place of the first (columns line_no, value)."""
    v = F.trim("value")
    return lines.where((v != "") & ~v.startswith("#")).groupBy(v.alias("seed")).agg(F.min("line_no").alias("line_no"))


def distinct_mints(df: DataFrame, mint: str = "token", after: str | None = None, limit: int | None = None) -> DataFrame:
    """SRC-19: distinct non-blank mints in order, from the one after a resume key, as many as asked for."""
    x = df.select(F.trim(mint).alias("mint")).where("mint <> ''").distinct()
    if after is not None:
        x = x.where(F.col("mint") > after)
    return x.orderBy("mint").limit(limit) if limit is not None else x


def upsert(old: DataFrame, new: DataFrame, key: str, updated: str = "updated") -> DataFrame:
    """SRC-20: old and new rows with the last update of each key; of equal times the new row wins."""
    x = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc(updated), F.desc("_new"), *[F.asc(c) for c in old.columns if c not in (key, updated)])
    return x.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def finished_run(runs: DataFrame | None, run_id: str, kind: str, started: int, ended: int, done: DataFrame, failed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """SRC-21: (run row, error rows) of a run: how many keys were done and failed, and each failure (key, error) with its run. runs: a table to append to, or None."""
    count = lambda df, name: df.groupBy().agg(F.count("*").alias(name))
    row = count(done, "n_done").join(F.broadcast(count(failed, "n_failed"))).select(F.lit(run_id).alias("run_id"), F.lit(kind).alias("kind"), F.lit(started).cast("long").alias("started"), F.lit(ended).cast("long").alias("ended"), "n_done", "n_failed", F.when(F.col("n_failed") > 0, "errors").otherwise("done").alias("status"))
    return (row if runs is None else runs.unionByName(row)), failed.select(F.lit(run_id).alias("run_id"), "key", "error")


def resumable(runs: DataFrame, kind: str) -> DataFrame:
    """SRC-21: the last run of a kind that has no end."""
    return runs.where((F.col("kind") == kind) & F.col("ended").isNull()).orderBy(F.desc("started"), F.desc("run_id")).limit(1)


def unprocessed(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """SRC-21: what a resumed run has left."""
    return todo.join(done.select(key).hint("merge"), key, "left_anti")


def fingerprint(df: DataFrame) -> DataFrame:
    """SRC-23: number of rows and an order-insensitive sum of row digests (32 bits of an MD5 of the columns as text)."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in sorted(df.columns)])
    return df.groupBy().agg(F.count("*").alias("n"), F.sum(F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("decimal(38,0)")).cast("string").alias("fingerprint"))


LEVELS = {"FULL": ("SESSION_START", "SESSION_END", "FLOW", "WHALE", "WALLET_SIGNAL", "STATE_TRANSITION"), "INTELLIGENCE_ONLY": ("SESSION_START", "SESSION_END", "WALLET_SIGNAL", "STATE_TRANSITION"), "MINIMAL": ("SESSION_START", "SESSION_END", "STATE_TRANSITION")}


def session_log(events: dict[str, DataFrame], level: str = "FULL") -> DataFrame:
    """SRC-10: typed event tables as one log of event_type, bt and a JSON payload, at a level."""
    parts = [df.select(F.lit(kind).alias("event_type"), "bt", F.to_json(F.struct(*df.columns)).alias("payload")) for kind, df in events.items() if kind in LEVELS[level]]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionAll(p)
    return out


def session_summary(log: DataFrame) -> DataFrame:
    """SRC-9: rows, first and last time by event type."""
    return log.groupBy("event_type").agg(F.count("*").alias("n"), F.min("bt").alias("first_bt"), F.max("bt").alias("last_bt"))


def capped(items: Column, most: int = 5) -> Column:
    """SRC-11: at most so many items of a list."""
    return F.slice(items, 1, most)


def capped_details(details: Column, items: int = 5, characters: int = 320) -> Column:
    """SRC-11: JSON text with all lists cut to so many items and all texts to so many characters and an ellipsis, at any depth; text that is no JSON stays."""
    import json

    import pyarrow as pa

    def cap(x):
        if isinstance(x, dict):
            return {k: cap(v) for k, v in x.items()}
        if isinstance(x, list):
            return [cap(v) for v in x[:items]]
        return x[:characters] + "..." if isinstance(x, str) and len(x) > characters else x

    def one(x: str | None) -> str | None:
        try:
            return None if x is None else json.dumps(cap(json.loads(x)), ensure_ascii=False)
        except ValueError:
            return x

    return F.arrow_udf(lambda column: pa.array([one(x) for x in column.to_pylist()], pa.string()), "string")(details)


_LOG_FIELDS = "type string, event_type string, wallet string, wallet_address string, from_state string, to_state string, state_from string, state_to string, event_time string, eventTime string, time string, timestamp string"
LOG_SCHEMA = f"{_LOG_FIELDS}, details struct<{_LOG_FIELDS.replace(' string', ': string')}, timing: struct<is_early: boolean>>"


def _first_of(*names: str) -> Column:
    return F.coalesce(*[F.nullif(F.col(f"r.{n}"), F.lit("")) for n in names])


def _parsed_log(log: DataFrame) -> DataFrame:
    """log (value, JSON text) as r; bt from the first of the names of the time that holds a number, at the top and then in details."""
    times = [F.col(f"r.{p}{n}").try_cast("double").cast("long") for p in ("", "details.") for n in ("event_time", "eventTime", "time", "timestamp")]
    return log.select(F.from_json("value", LOG_SCHEMA).alias("r")).withColumn("bt", F.coalesce(*times))


def early_signals(log: DataFrame) -> DataFrame:
    """PRJ-10: (wallet, bt) of the wallet signals of a log (value, JSON text) that mark an early wallet; fields may stand at the top or in details, under several names."""
    x = _parsed_log(log).where(F.upper(_first_of("type", "event_type")).contains("WALLET_SIGNAL") & F.col("r.details.timing.is_early"))
    return x.select(_first_of("details.wallet", "details.wallet_address", "wallet", "wallet_address").alias("wallet"), "bt").where("wallet IS NOT NULL")


def log_transitions(log: DataFrame) -> DataFrame:
    """PRJ-10: (from_state, to_state, bt) of the rows of a log that name both states."""
    x = _parsed_log(log)
    for k, (a, b) in enumerate((("from_state", "to_state"), ("state_from", "state_to"))):
        x = x.withColumn(f"_a{k}", _first_of(a, f"details.{a}")).withColumn(f"_b{k}", _first_of(b, f"details.{b}"))
    first = F.col("_a0").isNotNull() & F.col("_b0").isNotNull()
    y = x.select(F.when(first, F.col("_a0")).otherwise(F.col("_a1")).alias("from_state"), F.when(first, F.col("_b0")).otherwise(F.col("_b1")).alias("to_state"), "bt")
    return y.where("from_state IS NOT NULL AND to_state IS NOT NULL")


def ordering_audit(events: DataFrame, order: str = "seq", chunk: int = 10_000) -> DataFrame:
    """PRJ-12: rows in ingestion order whose slot falls behind the one before, or that repeat its slot and signature.

    order: a number that tells the rows of a token apart. Rows are compared within chunks of it, the first of a chunk with the
    last one before the chunk, so a token is never in one task as a whole.
    """
    x = events.withColumn("_k", F.floor(F.col(order) / chunk))
    here = F.struct(order, F.col("slot").alias("_slot"), F.col("signature").alias("_sig"))
    last = x.groupBy("token", "_k").agg(F.max(here).alias("_last"))
    last = last.select(F.col("token").alias("_t"), F.col("_k").alias("_c"), F.lag("_last").over(Window.partitionBy("token").orderBy("_k")).alias("_last"))
    x = x.join(last.hint("merge"), (F.col("token") == F.col("_t")) & (F.col("_k") == F.col("_c")))
    w = Window.partitionBy("token", "_k").orderBy(order)
    x = x.withColumn("_before", F.coalesce(F.lag(here).over(w), "_last"))
    fault = F.when(F.col("slot") < F.col("_before._slot"), "out_of_order").when((F.col("slot") == F.col("_before._slot")) & (F.col("signature") == F.col("_before._sig")), "duplicate")
    return x.withColumn("fault", fault).where("fault IS NOT NULL").drop("_before", "_last", "_k", "_t", "_c")


def event_violations(events: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """PRJ-11: events with the list of rules they break; rows without any are left out."""
    checks = F.array_compact(F.array(F.when(F.col("signature").isNull() | (F.trim("signature") == ""), "signature"), F.when(F.coalesce(F.col("slot"), F.lit(-1)) < 0, "slot"), F.when(F.coalesce(F.col("bt"), F.lit(-1)) < 0, "time"), F.when(~F.coalesce(F.col("event_type").isin(*kinds), F.lit(False)), "type")))
    return events.withColumn("violations", F.array_join(checks, ",")).where("violations <> ''")


def first_pool(pools: DataFrame, key: str = "token") -> DataFrame:
    """SRC-26: the pool with the most liquidity of each token, nulls last, ties by address."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last("liquidity"), "pool")
    return pools.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def first_non_null(rows: DataFrame, keys: tuple[str, ...], value: str, order: str) -> DataFrame:
    """SRC-14: the first non-null value of each key in order."""
    return rows.groupBy(*keys).agg(F.min(F.when(F.col(value).isNotNull(), F.struct(order, value))).alias("_x")).select(*keys, F.col(f"_x.{value}").alias(value))


def checked_trades(rows: DataFrame) -> DataFrame:
    """SRC-12: trades given as text, typed, with error: what is missing or not a number, or an exit before the entry."""
    entry, exit_, roi = F.col("entry").try_cast("long"), F.col("exit").try_cast("long"), F.col("roi").try_cast("double")
    error = F.when(roi.isNull() | F.isnan(roi), "roi").when(entry.isNull() | exit_.isNull(), "missing time").when(exit_ < entry, "exit before entry")
    return rows.select("token", entry.alias("entry"), exit_.alias("exit"), roi.alias("roi"), error.alias("error"))


def liquidity_values(events: DataFrame) -> DataFrame:
    """SRC-27: liquidity events with value: the liquidity, else the amount, else 0; action in lower case."""
    number = lambda c: F.col(c).try_cast("double") if c in events.columns else F.lit(None).cast("double")
    return events.withColumn("value", F.coalesce(number("liquidity"), number("amount"), F.lit(0.0))).withColumn("action", F.lower(F.coalesce("action", F.lit("")))).where("token IS NOT NULL AND token <> '' AND bt IS NOT NULL")


def holder_snapshots(holders: DataFrame) -> DataFrame:
    """SRC-27: of holder rows (token, bt, wallet, balance), for each token and snapshot: holders, positive ones, sum and largest balance; a missing balance is 0."""
    b = F.coalesce(F.col("balance").try_cast("double"), F.lit(0.0))
    return holders.where("token IS NOT NULL AND token <> '' AND bt IS NOT NULL").groupBy("token", "bt").agg(F.count("*").alias("n"), F.count_if(b > 0).alias("n_positive"), F.sum(b).alias("total"), F.max(b).alias("largest"))


def side_tables(metadata: DataFrame, events: DataFrame) -> DataFrame:
    """SRC-27: authority flags (any text counts) and liquidity added for each token."""
    flag = lambda c: (F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) != "").cast("int")
    added = events.where("action = 'add'").groupBy("token").agg(F.sum("amount").alias("added"))
    x = metadata.select("token", flag("mint_authority").alias("mintable"), flag("freeze_authority").alias("freezable"), F.col("is_mutable").cast("int").alias("mutable"))
    return x.join(added.hint("merge"), "token", "left").fillna(0, ["added"])


def rpc_events(tx: DataFrame, dex_programs: dict[str, str]) -> DataFrame:
    """SRC-5: one event for each instruction of parsed transactions (signature, slot, blockTime, instructions, accounts): SWAP for a known program, TRANSFER and MINT by parsed type, else OTHER with the first five accounts."""
    name = F.create_map(*[x for k, v in dex_programs.items() for x in (F.lit(k), F.lit(v))])
    x = tx.select("signature", "slot", "blockTime", "accounts", F.posexplode_outer("instructions").alias("index", "i"))
    known, parsed = F.try_element_at(name, F.col("i.programId")), F.col("i.parsedType")
    kind = F.when(known.isNotNull(), "SWAP").when(parsed.isin("transfer", "transferChecked"), "TRANSFER").when(parsed.isin("mintTo", "initializeMint"), "MINT").otherwise("OTHER")
    actors = F.when(F.size("i.accounts") > 0, F.col("i.accounts")).otherwise(F.slice("accounts", 1, 5))
    return x.select("signature", "slot", F.col("blockTime").alias("bt"), F.coalesce("index", F.lit(0)).alias("index"), kind.alias("event_type"), known.alias("dex"), actors.alias("actors"))


def enriched(tx: DataFrame, wallet: str = "wallet") -> DataFrame:
    """SRC-24: SOL before, after and change of a wallet in each transaction (arrays accountKeys, preBalances, postBalances), fee, and whether it failed; null where the wallet takes no part."""
    at = F.array_position("accountKeys", F.col(wallet)).cast("int")
    value = lambda c: F.when(at > 0, F.get(c, at - 1))
    x = tx.withColumn("pre", value("preBalances")).withColumn("post", value("postBalances"))
    return x.withColumn("sol_delta", (F.col("post") - F.col("pre")) / 1e9).withColumn("failed", F.coalesce(F.col("err") != "", F.lit(False)))


def program_ids(tx: DataFrame) -> DataFrame:
    """FN-19, SRC-24: tx with programs_top and programs_inner: sorted distinct programs of instructions and of inner instructions (arrays of structs with programId)."""
    ids = lambda x: F.array_sort(F.array_distinct(F.filter(F.transform(x, lambda i: i["programId"]), lambda p: p.isNotNull() & (p != ""))))
    inner = F.flatten(F.transform(F.coalesce("innerInstructions", F.array()), lambda g: g["instructions"]))
    return tx.withColumn("programs_top", ids(F.coalesce("instructions", F.array()))).withColumn("programs_inner", ids(inner))


def token_moves(tx: DataFrame, wallet: str = "wallet") -> DataFrame:
    """SRC-24: tx with spl_in and spl_out: its token transfers to and from the wallet, as (mint, amount)."""
    of = lambda field: F.transform(F.filter(F.coalesce("tokenTransfers", F.array()), lambda t: t[field] == F.col(wallet)), lambda t: F.struct(t["mint"].alias("mint"), t["tokenAmount"].alias("amount")))
    return tx.withColumn("spl_in", of("toUserAccount")).withColumn("spl_out", of("fromUserAccount"))


# The programs of tokens with extensions.
TOKEN_2022 = ("TokenzQdBNbLqP5VEhdkAS6EPFLC1PHnBqCXEpPxuEb", "TokenzQdBNo95A8A7n8C9y7SWr2zJxdyx3Y3G5M8b6")


def mint_security(accounts: DataFrame) -> DataFrame:
    """SRC-25: mint_account() with both authorities as base-58 text and the token program (owner), tagged where it is that of tokens with extensions."""
    from tidewake.functions.scalar import base58

    key = lambda flag, at: base58(F.when((F.length("data") >= 82) & (F.col(flag)), F.substring("data", at, 32)))
    x = accounts.select("*", *[c.alias(n) for n, c in _account_fields().items()])  # repeated mints keep their rows
    program = F.when(F.col("owner").isin(*TOKEN_2022), F.concat("owner", F.lit(":token-2022"))).otherwise(F.col("owner"))
    return x.select("mint", program.alias("token_program"), key("has_mint_authority", 5).alias("mint_authority"), key("has_freeze_authority", 51).alias("freeze_authority"), "decimals", "supply_raw")


def mint_account(accounts: DataFrame) -> DataFrame:
    """SRC-25: authority flags, supply and decimals out of the binary data of a mint account (82 bytes, little-endian)."""
    return accounts.select("mint", *[c.alias(n) for n, c in _account_fields().items()])


def _account_fields() -> dict[str, Column]:
    byte = lambda k: F.conv(F.hex(F.substring(F.col("data"), k + 1, 1)), 16, 10).cast("long")
    supply = sum((byte(36 + k).cast("decimal(38,0)") * F.lit(256**k).cast("decimal(38,0)") for k in range(1, 8)), byte(36).cast("decimal(38,0)"))
    ok = F.length("data") >= 82
    return {"has_mint_authority": F.when(ok, byte(0) == 1), "supply_raw": F.when(ok, supply.cast("decimal(20,0)")), "decimals": F.when(ok, byte(44)), "has_freeze_authority": F.when(ok, byte(46) == 1)}


def side_class(n_in: Column, n_out: Column, sol_delta: Column) -> Column:
    """PRJ-3: BUY, SELL or OTHER by token transfers in and out and the SOL change."""
    return F.when((n_in > 0) & (sol_delta < 0), "BUY").when((n_out > 0) & (sol_delta > 0), "SELL").otherwise("OTHER")


def in_range(df: DataFrame, since: int | None = None, until: int | None = None, last_hours: float | None = None, time: str = "bt") -> DataFrame:
    """PRJ-9: rows within explicit bounds, or of the last hours before the latest row."""
    if last_hours is not None:
        end = df.groupBy().agg(F.max(time).alias("_end"))
        df = df.join(F.broadcast(end)).where(F.col(time) >= F.col("_end") - int(last_hours * 3600)).drop("_end")  # one row
    if since is not None:
        df = df.where(F.col(time) >= since)
    return df.where(F.col(time) <= until) if until is not None else df


def pool_of(tx: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """FN-20: the pool field where there is one, else the most frequent account of a signature's instructions, known ones excluded, ties by address."""
    x = tx.where("pool IS NULL").select("signature", F.explode("accounts").alias("account")).where(~F.col("account").isin(*excluded))
    n = x.groupBy("signature", "account").agg(F.count("*").alias("n"))
    best = n.groupBy("signature").agg(F.min(F.struct((-F.col("n")).alias("k"), "account"))["account"].alias("_best"))
    y = tx.join(best.hint("merge"), "signature", "left")
    return y.select("signature", F.coalesce("pool", "_best").alias("pool"), F.when(F.col("pool").isNotNull(), "field").when(F.col("_best").isNotNull(), "accounts").alias("method"))


def compute_budget(data: Column) -> Column:
    """FN-19: units and price of compute budget instructions given as (kind, value) structs."""
    first = lambda kind: F.get(F.filter(data, lambda d: d["kind"] == kind), F.lit(0))["value"]
    return F.struct(first("limit").alias("unit_limit"), first("price").alias("unit_price"), (first("limit") * first("price") / 1e6).alias("priority_fee"))
