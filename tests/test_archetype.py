"""The archetype fold against a plain count over every single step, and features with side tables by hand."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.functions import scalar as S
from tidewake.operators import archetype as R

LEVELS = {"low": (3, 2, 6, 4), "mid": (2, 2, 4, 3), "high": (2, 1, 3, 2)}


def naive(rows, n_steps, seconds):
    """All steps of one token, one by one: (shown rows, counts by archetype, flips). rows: {step: (n, dominant, risk, tempo, signals, quiet dominant, quiet risk)}."""
    state = {"d": [0, "NONE"], "r": [0, "NONE"]}
    quiet_like, silent, name, counts, flips, before, out = ("NEUTRAL", 0.0), 0, "The Ghost", {}, 0, None, []
    for k in range(max(n_steps, max(rows) + 1)):
        n, dom, risk, tempo, found, q_dom, q_risk = rows.get(k, (0, *quiet_like, "low", (False,) * 4, *quiet_like))
        quiet_like = (q_dom, q_risk)
        silent = 0 if n else silent + 1
        for which, on in (("d", dom != "NEUTRAL"), ("r", risk >= 0.55)):
            c, lvl = state[which]
            c = c + 1 if on else max(0, c - 1)
            won, woff, son, soff = LEVELS[tempo]
            new = "NONE"
            if lvl == "SHOUT":
                new = "SHOUT" if c >= soff else "WARNING" if c >= won else "NONE"
                new = "SHOUT" if c >= son else new
            elif c >= son:
                new = "SHOUT"
            elif c >= (woff if lvl == "WARNING" else won):
                new = "WARNING"
            state[which] = [c, new]
        conf = lambda good, bad, c: int(round(min(95, max(35, 45 + 8 * good + min(20, 3 * c) - 7 * bad)) / 5) * 5)
        now = conf((dom != "NEUTRAL") + (risk >= 0.55), dom == "NEUTRAL", state["d"][0]), conf((risk >= 0.55) + (risk >= 0.75), risk < 0.55, state["r"][0])
        ghost = silent * seconds >= 600
        signs = [*found, ghost, dom == "PUMP" and state["d"][0] >= 2, dom == "DUMP" and state["d"][0] >= 2]
        want = next((a for (a, _, _), on in zip(S.ARCHETYPES, signs, strict=True) if on), name)
        flip = (state["d"][1] == "SHOUT" or ghost) and not (ghost and silent < 5) and want != name
        if flip:
            name, flips = want, flips + 1
        counts[name] = counts.get(name, 0) + 1
        if k in rows or now != before or flip:
            out.append((k, name, state["d"][1], state["r"][1], dom, state["d"][0], *now, now != before, flip))
        before = now
    return out, counts, flips


def scored(rows, token="a", n_steps=0):
    return [(token, k, n, dom, risk, tempo, qd, qr, n_steps, *found) for k, (n, dom, risk, tempo, found, qd, qr) in rows.items()]


COLS = "token string, step long, n long, dominant string, risk double, tempo string, quiet_dominant string, quiet_risk double, n_steps long, vampire boolean, time_bomb boolean, bot_farm boolean, phoenix boolean"


@pytest.mark.parametrize("seed", range(6))
def test_fold_against_every_step(spark, seed):
    rng = random.Random(seed)
    tokens = {}
    for t in "abc":
        rows, k = {}, 0
        for _ in range(rng.randrange(1, 40)):
            signs = tuple(rng.random() < 0.1 for _ in range(4))
            rows[k] = (rng.choice([0, 1, 1, 9]), rng.choice(["PUMP", "DUMP", "NEUTRAL"]), rng.choice([0.1, 0.6, 0.9]), rng.choice(["low", "mid", "high"]), signs, rng.choice(["PUMP", "NEUTRAL"]), rng.choice([0.0, 0.9]))
            k += rng.choice([1, 1, 1, 2, 5, 40, 400])
        tokens[t] = (rows, k + rng.choice([0, 3, 70]))
    x = spark.createDataFrame([r for t, (rows, n) in tokens.items() for r in scored(rows, t, n)], COLS)
    got = R.evaluated(x, 60).collect()
    totals = {r.token: r for r in R.summary(R.evaluated(x, 60)).collect()}
    for t, (rows, n) in tokens.items():
        want, counts, flips = naive(rows, n, 60)
        own = sorted((r for r in got if r.token == t and r.step is not None), key=lambda r: r.step)
        assert [(r.step, r.archetype, r.direction_level, r.risk_level, r.dominant, r.persistence, r.direction_conf, r.risk_conf, r.changed, r.flipped) for r in own] == want
        assert totals[t].by_archetype == ";".join(f"{k}:{v}" for k, v in sorted(counts.items())) and (totals[t].flips, totals[t].n_steps) == (flips, sum(counts.values()))


def test_quiet_steps_do_not_swallow_a_step(spark):
    rows = lambda steps: spark.createDataFrame([("a", k, "PUMP", 0.9, "high") for k in steps], "token string, step long, dominant string, risk double, tempo string")
    assert {r.step: r.persistence for r in R.timeline(rows([0, 5])).collect()} == {0: 1, 5: 1}
    assert {r.step: r.direction_level for r in R.timeline(rows([0, 5, 6, 7])).collect()}[6] == "WARNING"


def test_side_features_by_hand(spark):
    flows = spark.createDataFrame([(w, "t", bt, d, 1_000_000_000, f"s{i}", i) for i, (w, bt, d) in enumerate([("a", 100, "buy"), ("b", 130, "buy"), ("a", 1000, "sell"), ("b", 1005, "buy")])], "wallet string, token string, bt long, direction string, lamports long, signature string, seq long")
    pool = spark.createDataFrame([("t", 50, 0, "add", 9.0), ("t", 110, 1, "add", 4.0), ("t", 115, 2, "REMOVE", 2.0), ("t", 400, 3, "withdraw", 6.0), ("t", 9000, 4, "add", 1.0)], "token string, bt long, seq long, action string, amount double")
    holders = spark.createDataFrame([("t", 110, "a", 1.0), ("t", 110, "b", 1.0), ("t", 700, "a", 1.0), ("t", 700, "b", 99.0)], "token string, bt long, wallet string, balance double")
    meta = spark.createDataFrame([("t", "x", None, True)], "token string, mint_authority string, freeze_authority string, is_mutable boolean")
    x = R.signals(R.scores(R.with_sides(R.step_features(flows, 60), flows, 60, pool, holders, meta)))
    got = {r.step: r for r in x.collect()}
    assert sorted(got) == [0, 5, 10, 15]
    assert [(got[k].n, got[k].removals, got[k].thin, got[k].spike) for k in sorted(got)] == [(2, 1, 0, 0), (0, 1, 0, 0), (0, 0, 0, 1), (2, 0, 0, 0)]
    assert [round(got[k].liquidity_mad, 6) for k in sorted(got)] == [1.0, 1.333333, 1.333333, 1.333333]
    assert all(r.authorities == 2 and r.n_steps == 17 for r in got.values()) and got[10].time_bomb and not got[0].vampire and got[15].resurrections == 1
    assert got[0].p_plus == pytest.approx(1.4 * 2 + 1.1 * 2 + 2 + 0.8 / 2) and got[5].quiet_risk == pytest.approx((2.1 + 2) / (1 + abs(0.8 / (1 + 4 / 3) - 0.9 * 4 / 3)))
    assert R.step_size(flows.withColumn("bt", F.col("bt") * 10)).first().step == 60 and R.step_size(flows).first().step == 20
