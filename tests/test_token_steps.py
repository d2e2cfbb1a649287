"""Archetypes with steps of 20 or 60 seconds by token, against a plain loop over every step."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_archetype import LEVELS
from tidewake.functions import scalar as S
from tidewake.operators import archetype as R

FLOW = "wallet string, token string, bt long, direction string, lamports long, signature string, seq long"


def mad(v):
    m = sum(v) / len(v) if v else 0
    return sum(abs(x - m) for x in v) / len(v) if v else 0.0


def gini(v):
    v, n = sorted(x for x in v if x >= 0), sum(x >= 0 for x in v)
    return 2 * sum((i + 1) * x for i, x in enumerate(v)) / (n * sum(v)) - (n + 1) / n if sum(v) > 0 else 0.0


def loop(rows, pool, snapshots, meta):
    """One token, step by step: (seconds, shown changes, flips, counts). rows: (bt, wallet, SOL, sells) in order."""
    times = [r[0] for r in rows]
    gaps = [b - a for a, b in zip(times, times[1:]) if b > a]
    seconds = 20 if len(times) >= 3 and gaps and min(gaps) <= 20 else 60
    t0, t1 = times[0], times[-1]
    first, volume = {}, {}
    for bt, w, x, _ in rows:
        first.setdefault(w, bt)
        volume[w] = volume.get(w, 0) + x
    top = {w for w, _ in sorted(volume.items(), key=lambda p: (-p[1], p[0]))[:10]}
    thin_at = sorted(a for _, _, a in pool)[int(0.2 * (len(pool) - 1))] if pool else 0
    spikes, last = set(), 0.0
    for bt, balances in sorted(snapshots.items()):
        g = gini(balances)
        if g - last > 0.08:
            spikes.add((bt - t0) // seconds)
        last = g
    d, r = [0, "NONE"], [0, "NONE"]
    silent, back, name, counts, flips, before, recent, shown = 0, 0, "The Ghost", {}, [], None, [], []
    for k, at in enumerate(range(t0, t1 + seconds, seconds)):
        own = [x for x in rows if at <= x[0] < at + seconds]
        n = len(own)
        inflow, outflow = sum(x for _, _, x, out in own if not out), sum(x for _, _, x, out in own if out)
        new = {w for _, w, _, _ in own if (first[w] - t0) // seconds == k}
        entries = sum(first[w] <= t0 + 600 for w in new)
        exits = sum(first[w] <= t0 + 600 and out for _, w, _, out in own)
        top_out = sum(x for _, w, x, out in own if out and w in top)
        events = [(action, a) for bt, action, a in pool if (bt - t0) // seconds == k]
        recent = (recent + [a for _, a in events])[-12:]
        vol = mad(recent) if len(recent) >= 2 else 0.0
        removals, thin = sum("remove" in a.lower() or "withdraw" in a.lower() for a, _ in events), int(bool(events) and min(a for _, a in events) <= thin_at)
        spike = int(k in spikes)
        pauses = [b[0] - a[0] for a, b in zip(own, own[1:])]
        timing, size = 1 / (1 + mad(pauses)), 1 / (1 + mad([x for _, _, x, _ in own]))
        busy = {}
        for _, w, _, _ in own:
            busy[w] = busy.get(w, 0) + 1
        density = sum(sorted(busy.values())[-10:]) / n if n else 0.0
        if n:
            back += silent * seconds >= 600
            silent = 0
        else:
            silent += 1
        ghost = silent * seconds >= 600
        plus = 1.4 * inflow + 1.1 * entries + len(new) + 0.8 / (1 + vol)
        minus = 1.4 * outflow + 1.1 * exits + top_out + 0.9 * vol + 0.8 * spike
        fragile = 1.1 * timing + size + 1.1 * density + 0.9 * removals + 1.2 * thin + sum(meta) + 0.8 * spike
        dom = dominance(plus, minus)
        risk = fragile / (1 + abs(plus - minus) / (1 + n))
        tempo = "high" if n >= 24 else "mid" if n >= 8 else "low"
        for state, on in ((d, dom != "NEUTRAL"), (r, risk >= 0.55)):
            state[0] = state[0] + 1 if on else max(0, state[0] - 1)
            won, woff, son, soff = LEVELS[tempo]
            c, was = state[0], state[1]
            state[1] = "SHOUT" if c >= son or was == "SHOUT" and c >= soff else "WARNING" if c >= (woff if was == "WARNING" else won) else "NONE"
        conf = lambda good, bad, c: int(round(min(95, max(35, 45 + 8 * good + min(20, 3 * c) - 7 * bad)) / 5) * 5)
        now = conf((dom != "NEUTRAL") + (risk >= 0.55), dom == "NEUTRAL", d[0]), conf((risk >= 0.55) + (risk >= 0.75), risk < 0.55, r[0])
        signs = [removals > 0 and outflow > inflow, (meta[0] or meta[1]) and spike == 1, timing > 0.7 and size > 0.7 and density > 0.75, back > 0 and inflow > outflow, ghost, dom == "PUMP" and d[0] >= 2, dom == "DUMP" and d[0] >= 2]
        want = next((a for (a, _, _), on in zip(S.ARCHETYPES, signs, strict=True) if on), name)
        if (d[1] == "SHOUT" or ghost) and not (ghost and silent < 5) and want != name:
            name = want
            flips.append((k, name))
        counts[name] = counts.get(name, 0) + 1
        if now != before:
            level = "HIGH" if risk >= 0.75 else "ELEVATED" if risk >= 0.55 else "LOW"
            shown.append((k, name, f"{d[1]}:{dom}", now[0], f"{r[1]}:{level}", now[1]))
        before = now
    return seconds, shown, flips, counts


def dominance(plus, minus, margin=0.12):
    if plus > minus * (1 + margin):
        return "PUMP"
    return "DUMP" if minus > plus * (1 + margin) else "NEUTRAL"


def some_token(rng, fast):
    """Flows with pauses of a few seconds, or none below 21, and silences; with a pool, snapshots and authorities."""
    bt, rows = rng.randrange(1_000, 2_000), []
    for _ in range(rng.randrange(3, 60)):
        rows.append((bt, f"w{rng.randrange(16)}", rng.choice([1, 1, 2, 5]) * 250_000_000, rng.random() < 0.4))
        bt += rng.choice([0, 3, 9, 25, 70, 70, 200, 900, 2500] if fast else [0, 21, 45, 60, 61, 130, 700, 2500])
    pool = sorted((rng.randrange(rows[0][0], rows[-1][0] + 1), rng.choice(["add", "remove", "WITHDRAW", "add"]), rng.choice([1.0, 2.0, 4.0, 8.5])) for _ in range(rng.choice([0, 1, 5, 40])))
    shots = {t: [float(rng.choice([0, 1, 5, 100])) for _ in range(rng.randrange(1, 6))] for t in sorted({rng.randrange(rows[0][0], rows[-1][0] + 1) for _ in range(rng.choice([0, 2, 6]))})}
    return rows, pool, shots, tuple(rng.choice([0, 1]) for _ in range(3))


@pytest.mark.parametrize("seed", range(3))
def test_both_widths_against_a_plain_loop(spark, seed):
    rng = random.Random(seed)
    tokens = {f"t{i}": some_token(rng, i % 2 == 0) for i in range(14)}
    flows = spark.createDataFrame([(w, t, bt, "sell" if out else "buy", x, f"{t}{i}", i) for t, (rows, *_) in tokens.items() for i, (bt, w, x, out) in enumerate(rows)], FLOW)
    pool = spark.createDataFrame([(t, bt, i, a, x) for t, (_, p, _, _) in tokens.items() for i, (bt, a, x) in enumerate(p)], "token string, bt long, seq long, action string, amount double")
    holders = spark.createDataFrame([(t, bt, f"w{i}", b) for t, (_, _, s, _) in tokens.items() for bt, v in s.items() for i, b in enumerate(v)], "token string, bt long, wallet string, balance double")
    meta = spark.createDataFrame([(t, str(m[0]), "x" if m[1] else None, bool(m[2])) for t, (*_, m) in tokens.items()], "token string, mint_authority string, freeze_authority string, is_mutable boolean")
    x = R.signals(R.scores(R.with_sides(R.step_features(flows, None), flows, None, pool, holders, meta)))
    rows = R.evaluated(x).cache()
    widths, changes, flips, total = ({} for _ in range(4))
    for r in x.select("token", "seconds").distinct().collect():
        widths[r.token] = r.seconds
    for r in R.changes(rows).orderBy("step").collect():
        changes.setdefault(r.token, []).append((r.step, r.archetype, r.direction_alert, r.direction_conf, r.risk_alert, r.risk_conf))
    for r in R.exemplars(rows).orderBy("step").collect():
        flips.setdefault(r.token, []).append((r.step, r.archetype))
    for r in R.summary(rows).collect():
        total[r.token] = (r.n_steps, r.by_archetype, r.flips)
    rows.unpersist()
    for t, (own, p, s, m) in tokens.items():
        seconds, shown, flipped, counts = loop([(bt, w, x / 1e9, out) for bt, w, x, out in own], p, s, m)
        assert widths[t] == seconds and changes[t] == shown and flips.get(t, []) == flipped, t
        assert total[t] == (sum(counts.values()), ";".join(f"{k}:{v}" for k, v in sorted(counts.items())), len(flipped))
    assert set(widths.values()) == {20, 60}


def test_recent_rows_of_a_hot_token(spark):
    """One token with a third of all rows: the deviation of the last twelve equals the plain window, in many blocks."""
    x = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 50)).alias("token"), F.floor(F.col("id") / 4).alias("bt"), F.col("id").alias("seq"), ((F.col("id") * 7919) % 1000 / 8).alias("amount"))
    got = R.recent_mad(x, block=256, chunk=500)
    assert len(got.columns) == 5 and got.count() == 30_000
    values = {}
    for r in got.orderBy("token", "bt", "seq").collect():
        own = values.setdefault(r.token, [])
        own.append(r.amount)
        assert r._mad == pytest.approx(mad(own[-12:]) if len(own) > 1 else 0.0, abs=1e-9)
    sizes = R.numbered(x, "token", "bt", "seq", 500).groupBy("token", (F.col("_row") / 256).cast("int")).count()
    assert sizes.agg(F.max("count")).first()[0] == 256


def test_best_of_parts(spark):
    x = spark.range(5000).select((F.col("id") % 2).cast("string").alias("token"), F.col("id").cast("string").alias("wallet"), (F.col("id") * 31 % 97).alias("v"))
    want = {}
    for r in x.collect():
        want.setdefault(r.token, []).append((-r.v, r.wallet))
    got = {}
    for r in R.best(x, ["token"], "v", 10).collect():
        got.setdefault(r.token, []).append((-r.v, r.wallet))
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v)[:10] for k, v in want.items()}


def test_flows_are_dealt_once(spark, sf_dir):
    """flows meet marked wallets only and are dealt by token and step; steps are dealt by token once, whatever sides they have."""
    from tidewake.plans import lifecycle_queries as L
    from tidewake.sources.canonical import Tables

    plan = R.evaluated(L.trade_scores(Tables(spark, sf_dir)), dealt=True)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    # 58 before
    assert "MapInArrow" in plan and len(dealt) <= 14, len(dealt)
    assert sum("wallet#" in x for x in dealt) == 1  # holders; flows are not dealt by wallet


def test_step_size_over_chunks(spark):
    """Pauses in a chunk of time and between two of them, equal times, and times without an order."""
    day = R.PAUSE_CHUNK
    times = {"across": [day - 5, day + 15, 9 * day], "far": [day - 6, day + 15, 9 * day], "equal": [7, 7, 7, 900], "two": [1, 2], "within": [40, 9 * day, 60], "none": [None, 5, 20]}
    x = spark.createDataFrame([(k, t) for k, v in times.items() for t in v], "token string, bt long")
    assert {r.token: r.step for r in R.step_size(x).collect()} == {"across": 20, "far": 60, "equal": 60, "two": 60, "within": 20, "none": 60}
