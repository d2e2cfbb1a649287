"""Scalar functions as Column expressions (FN-1..28), and the two small per-token parameter tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAMPORTS = 1e9


def epoch_seconds(x: Column) -> Column:
    """FN-1: any time as epoch seconds. x: text; digits beyond 1e10 are milliseconds, else ISO-8601 (naive is UTC); null if neither."""
    number = F.try_to_number(F.trim(x), F.lit("99999999999999999999")).cast("double")
    number = F.coalesce(number, x.try_cast("double"))
    stamp = F.unix_seconds(F.try_to_timestamp(F.regexp_replace(F.trim(x), "Z$", "+00:00")))
    return F.coalesce(F.when(number > 1e10, F.floor(number / 1000)).otherwise(F.floor(number)), stamp).cast("long")


def iso_utc(x: Column) -> Column:
    """FN-2: epoch seconds as ISO-8601 with Z (session time zone UTC)."""
    return F.date_format(F.timestamp_seconds(x), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def lenient(x: Column, kind: str, default=None) -> Column:
    """FN-3: a cast that gives default instead of failing."""
    return F.coalesce(F.trim(x.cast("string")).try_cast(kind), F.lit(default).cast(kind))


def sol(lamports: Column) -> Column:
    """FN-4: lamports as SOL."""
    return lamports / F.lit(LAMPORTS)


def sol_text(lamports: Column) -> Column:
    """FN-4: SOL with nine decimals."""
    return (lamports.cast("decimal(38,9)") / F.lit(1_000_000_000)).cast("decimal(38,9)").cast("string")


def token_amount(x: Column) -> Column:
    """FN-5: an amount given as JSON text: a number, a string, an object with uiAmount, uiAmountString or amount and decimals."""
    field = lambda name: F.get_json_object(x, f"$.{name}").try_cast("double")
    raw = field("amount") / F.pow(F.lit(10.0), field("decimals"))
    return F.coalesce(field("uiAmount"), field("uiAmountString"), raw, F.regexp_replace(x, '^"|"$', "").try_cast("double"))


def liquidity_estimate(flows: DataFrame, rows: int = 20, share: float = 0.01, least: float = 5, most: float = 10_000, sizes: tuple[float, float] = (0.01, 1000), default: float = 50.0) -> DataFrame:
    """AGG-26: a token's pool size (SOL) from the mean size of its first flows, of those between the two sizes (SOL, both excluded); default where none is."""
    w = Window.partitionBy("token").orderBy("bt", "seq")
    x = flows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= rows)
    usual = F.when((F.col("lamports") > round(sizes[0] * LAMPORTS)) & (F.col("lamports") < round(sizes[1] * LAMPORTS)), F.col("lamports"))
    mean = F.sum(usual) / F.count(usual) / F.lit(1e9) / F.lit(share)
    pool = F.when(F.count(usual) > 0, F.greatest(F.lit(float(least)), F.least(mean, F.lit(float(most))))).otherwise(F.lit(default))
    return x.groupBy("token").agg(pool.alias("pool"))


# Share of the pool, least and most SOL of each threshold.
DYNAMIC = (("whale_tx", 0.005, 0.1, 100.0), ("whale_5m", 0.01, 0.5, 250.0), ("whale_15m", 0.02, 1.0, 500.0))


def dynamic_thresholds(pools: DataFrame, default_pool: float = 50.0) -> DataFrame:
    """FN-6: thresholds of each token from its pool (SOL); a missing or non-positive pool counts as default_pool."""
    pool = F.when(F.col("pool") > 0, F.col("pool")).otherwise(F.lit(default_pool))
    return pools.select("token", *[F.greatest(F.lit(lo), F.least(pool * F.lit(share), F.lit(hi))).alias(name) for name, share, lo, hi in DYNAMIC])


def entry_bucket(seconds: Column, fast: int = 5, mid: int = 60) -> Column:
    """FN-7: FAST, MID or SLOW entry by its delay; null stays null."""
    return F.when(seconds.isNull(), F.lit(None).cast("string")).when(seconds <= fast, "FAST").when(seconds <= mid, "MID").otherwise("SLOW")


# Upper bounds (inclusive) and names of the return buckets.
ROI_BUCKETS = ((-0.284211, "big_loss"), (-0.121632, "mid_loss"), (0.253085, "mid"), (0.688854, "good"), (1.118921, "very_good"))


def roi_bucket(roi: Column) -> Column:
    """FN-7: one of six return buckets."""
    out = F.when(roi.isNull(), F.lit(None).cast("string"))
    for bound, name in ROI_BUCKETS:
        out = out.when(roi <= bound, name)
    return out.otherwise("extreme")


def panel(mcap: Column) -> Column:
    """FN-7: panel of a market cap."""
    return F.when(mcap.isNull(), "Unknown").when(mcap < 10_000, "New Pairs").when(mcap < 35_000, "Final Stretch").otherwise("Migrated")


def tempo(n_events: Column) -> Column:
    """FN-7: pace of a token by its number of events."""
    return F.when(n_events >= 24, "high").when(n_events >= 8, "mid").otherwise("low")


def confidence(x: Column, least: int = 35, most: int = 95, step: int = 5) -> Column:
    """FN-8: clamped, then to a multiple of step, half to even."""
    return (F.bround(F.greatest(F.lit(float(least)), F.least(x.cast("double"), F.lit(float(most)))) / step) * step).cast("int")


def composite_confidence(aligned: Column, contrary: Column, persistence: Column) -> Column:
    """FN-8: confidence from counts of aligned and contrary signals and of persistent steps."""
    return confidence(45 + aligned * 8 + F.least(F.lit(20), persistence * 3) - contrary * 7)


def dominance(plus: Column, minus: Column, margin: float = 0.12) -> Column:
    """FN-9: PUMP or DUMP if one score exceeds the other by the margin, else NEUTRAL."""
    return F.when((plus <= 0) & (minus <= 0), "NEUTRAL").when(plus > minus * (1 + margin), "PUMP").when(minus > plus * (1 + margin), "DUMP").otherwise("NEUTRAL")


# Archetypes by priority, with the signal that calls for each and its reason text.
ARCHETYPES = (
    ("The Vampire", "vampire", "G3 liquidity extraction + G1 outflow"),
    ("The Time Bomb", "time_bomb", "G5 authority risk + G4 concentration"),
    ("The Bot Farm", "bot_farm", "G2 coordination burst"),
    ("The Phoenix", "phoenix", "G6 resurrection after silence"),
    ("The Ghost", "ghost", "G6 prolonged inactivity"),
    ("The Accumulator", "accumulator", "G1 inflow/entry persistence"),
    ("The Distributor", "distributor", "G1 outflow/exit persistence"),
)


# Texts where an alert and risk contradict, of a sure and of a possible case.
CONFLICTS = ("SHOUT: CONFLICT — engineered {} confirmed", "WARNING: CONFLICT — engineered {} conditions")


def archetype(current: Column, can_flip: Column) -> Column:
    """FN-10: the first archetype whose boolean column is true, if a flip is allowed; else the current one."""
    first = F.coalesce(*[F.when(F.col(key), F.lit(name)) for name, key, _ in ARCHETYPES], current)
    return F.when(can_flip, first).otherwise(current)


def archetype_reason() -> Column:
    """FN-10: the reasons of the first two signals that hold."""
    reasons = F.array_compact(F.array(*[F.when(F.col(key), F.lit(text)) for _, key, text in ARCHETYPES]))
    return F.when(F.size(reasons) == 0, "mixed low-signal state").otherwise(F.array_join(F.slice(reasons, 1, 2), "; "))


def capital_verdict(net: Column, volume: Column, strong: float = 0.15) -> Column:
    """FN-13: direction of the net flow, STRONG from that share of the volume."""
    size = F.when((volume > 0) & (F.abs(net) / volume >= strong), "STRONG").otherwise("WEAK")
    return F.when(net > 0, F.concat(F.lit("INFLOW_"), size)).when(net < 0, F.concat(F.lit("OUTFLOW_"), size)).otherwise("NEUTRAL")


def exhaustion_label(share: Column) -> Column:
    """FN-14: label of the silent share of a wave's cohort; null (no cohort) is NONE."""
    return F.when(share >= 0.85, "CRITICAL").when(share >= 0.70, "SEVERE").when(share >= 0.50, "SIGNIFICANT").when(share >= 0.30, "EARLY").otherwise("NONE")


def severity(to_state: Column, trigger: Column, n: Column, share: Column, seconds: Column, n_early: Column, last: Column) -> Column:
    """FN-15: S1 to S5 of a transition; null for QUIET.

    n: the count that the state goes by (wallets, whales), share: silent share, last: the severity before in the episode.
    """
    by_count = lambda *steps: _steps(n, steps)
    return (
        F.when(to_state == "QUIET", F.lit(None).cast("string"))
        .when(to_state == "IGNITION", F.when(n_early >= 2, "S2").otherwise("S1"))
        .when(to_state == "COORDINATION_SPIKE", by_count((6, "S5"), (5, "S4"), (4, "S3"), (None, "S2")))
        .when(to_state == "EARLY_PHASE", F.when((seconds >= 180) & (n_early >= 3), "S3").otherwise("S2"))
        .when(to_state == "PERSISTENCE_CONFIRMED", by_count((4, "S5"), (3, "S4"), (None, "S3")))
        .when(to_state == "PARTICIPATION_EXPANSION", F.when(trigger == "new_whale_burst_reversal", "S4").otherwise(by_count((3, "S4"), (2, "S3"), (None, "S2"))))
        .when(to_state == "PRESSURE_PEAKING", by_count((10, "S5"), (7, "S4"), (None, "S3")))
        .when(to_state == "EXHAUSTION_DETECTED", _steps(share, ((0.80, "S5"), (0.70, "S4"), (None, "S3"))))
        .when(to_state == "DISSIPATION", F.when(last.isin("S4", "S5"), "S4").otherwise("S2"))
        .otherwise("S2")
    )


def _steps(x: Column, steps) -> Column:
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for bound, name in steps:
        out = out.when(x >= bound, name) if bound is not None else out.otherwise(name)
    return out


def whale_verdict(last_seen: Column, now: Column, wave_start: Column, silent: Column, bought: Column, sold: Column, recent_sell: Column, net_2m: Column) -> Column:
    """FN-16: what a wallet is doing now. recent_sell: its last three flows lean to the sell side (and are two at least)."""
    idle = now - last_seen > 120
    return (
        F.when((last_seen < wave_start) & idle, "GONE").when(silent, "GONE").when(idle, "INACTIVE")
        .when((bought > 0) & (sold >= bought * 0.30) & recent_sell & (net_2m < 0), "FLIPPING")
        .when(sold > bought, "DISTRIBUTING").when((bought > sold) & (net_2m > 0), "ACCUMULATING").when(bought > sold, "BUILDING").otherwise("INACTIVE")
    )


#: TOP-6: order in which verdicts are shown.
VERDICT_ORDER = ("FLIPPING", "DISTRIBUTING", "ACCUMULATING", "BUILDING", "INACTIVE", "GONE")


def verdict_priority(verdict: Column) -> Column:
    return F.coalesce(*[F.when(verdict == v, k) for k, v in enumerate(VERDICT_ORDER, 1)], F.lit(len(VERDICT_ORDER) + 1))


def whale_tier(total: Column) -> Column:
    """FN-16: tier 0 to 3 of a wallet's gross SOL."""
    return F.when(total >= 50, 3).when(total >= 25, 2).when(total >= 10, 1).otherwise(0)


def cluster_letter(wave: Column) -> Column:
    """FN-28: A for wave 1, B for 2, and so on, around after Z."""
    return F.char(F.lit(65) + F.pmod(wave - 1, F.lit(26)))


# FN-27, the phase shown for each state.
PHASES = {
    "QUIET": "Dead", "IGNITION": "Igniting", "COORDINATION_SPIKE": "Coordinating", "EARLY_PHASE": "Early Entry", "PERSISTENCE_CONFIRMED": "Building",
    "PARTICIPATION_EXPANSION": "Expanding", "PRESSURE_PEAKING": "Peak Pressure", "EXHAUSTION_DETECTED": "Exhausting", "DISSIPATION": "Dying",
}


def phase(state: Column) -> Column:
    out = F.when(state.isNull(), F.lit(None).cast("string"))
    for k, v in PHASES.items():
        out = out.when(state == k, v)
    return out.otherwise("UNKNOWN")


def replacement_shown(replaced: Column, wave_trend: Column) -> Column:
    """FN-27: YES turns to EXIT? while the wave fades."""
    return F.when(replaced & wave_trend.isin("FADING", "COLLAPSING"), "EXIT?").when(replaced, "YES").otherwise("NO")


def clean_text(x: Column) -> Column:
    """SRC-22: text for a TSV field."""
    return F.regexp_replace(F.coalesce(x.cast("string"), F.lit("")), "[\\t\\r\\n]", " ")


def capped_text(x: Column, most: int = 320) -> Column:
    """SRC-11: text of at most so many characters, then an ellipsis."""
    return F.when(F.length(x) > most, F.concat(F.substring(x, 1, most), F.lit("..."))).otherwise(x)


def platform(source: Column, mint: Column, accounts: Column) -> Column:
    """PRJ-8: the source as given, else by the mint's ending or an account's name; empty if unknown."""
    return F.when(F.coalesce(source, F.lit("")) != "", source).when(mint.endswith("pump"), "PUMP_FUN").when(F.exists(F.coalesce(accounts, F.array()), lambda a: F.lower(a).contains("pump")), "PUMP_FUN_RELATED_ACCOUNT").otherwise("")


# Programs of known venues, in the order in which they name a route.
VENUES = {
    "6EF8rrecthR5Dkzon8Nwu78hRvfCKubJ14M5uBEwF6P": "Pump.fun",
    "675kPX9MHTjS2zt1qfr1NYHuzeLXfQM9H24wFSUt1Mp8": "Raydium",
    "CAMMCzo5YL8w4VFF8KVHrK22GGUQYQ5eR2Q3z9wKQfK": "Raydium",
    "CPMMoo8L3F4NbTegBCKVNqj8fJ8oPt7Q2Nm2nY6KQfK": "Raydium",
    "routeUGWgWzqBWFcrCfv8tritsqukccJPu3q5GPP3xS": "Raydium",
}


def route_of(programs: Column, venues: dict[str, str] | None = None) -> Column:
    """PRJ-8: the venue of the programs of a transaction: the first that one of its programs belongs to, else Other."""
    venues = VENUES if venues is None else venues
    out = F.when(F.lit(False), "")
    for name in dict.fromkeys(venues.values()):
        out = out.when(F.arrays_overlap(programs, F.array(*[F.lit(p) for p, v in venues.items() if v == name])), name)
    return out.otherwise("Other")


# Names of the native token, and the alphabet of base 58.
SOL_NAMES = ("sol", "wsol", "wrapped sol", "wrapped_sol", "native sol", "so11111111111111111111111111111111111111112")
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"


def base58(data: Column) -> Column:
    """Bytes as base-58 text."""
    import pyarrow as pa

    def text(raw: bytes) -> str:
        number, out = int.from_bytes(raw, "big"), ""
        while number:
            number, k = divmod(number, 58)
            out = BASE58[k] + out
        return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + out

    return F.arrow_udf(lambda x: pa.array([None if v is None else text(v) for v in x.to_pylist()], pa.string()), "string")(data)


def or_null_token(x: Column, token: str = "NULL") -> Column:
    """FN-26: a null as a word."""
    return F.coalesce(x.cast("string"), F.lit(token))
