"""What follows from the life cycle, counted by hand: waves, entry signals, severities, conflicts, and the labels of wallets."""

import itertools

import pytest
from pyspark.sql import functions as F

from tests.test_operators import demo_rows, flows
from tidewake.operators import evidence as V
from tidewake.operators import machine as M
from tidewake.plans import network as N


@pytest.fixture(scope="module")
def changes(spark):
    parts = [flows(spark, demo_rows(seed, 400)).withColumn("token", F.lit(f"t{seed}")) for seed in (5, 6, 7)]
    return M.transitions(parts[0].union(parts[1]).union(parts[2])).cache()


def by(rows, *keys):
    order = sorted(rows, key=lambda r: [r[k] for k in keys] + [r.bt, r.seq])
    return {k: list(g) for k, g in itertools.groupby(order, key=lambda r: tuple(r[k] for k in keys))}


def test_waves_and_entry_signals(changes):
    rows = changes.collect()
    want = {k: (min(r.bt for r in g), max(r.bt for r in g), max(r.n_early for r in g), max(r.share for r in g)) for k, g in by(rows, "token", "episode", "wave").items()}
    assert {(r.token, r.episode, r.wave): (r.start_bt, r.end_bt, r.n_early, r.peak_silent) for r in M.waves(changes).collect()} == want
    first = {k: next((r.bt, r.seq) for r in g if r.to_state == "PRESSURE_PEAKING") for k, g in by(rows, "token", "episode").items() if any(r.to_state == "PRESSURE_PEAKING" for r in g)}
    assert {(r.token, r.episode): (r.bt, r.seq) for r in M.entry_signals(changes).collect()} == first


def steps(x, *pairs):
    return next(name for bound, name in pairs if bound is None or x >= bound)


def grade(r, before):
    s, n = r.to_state, r.n
    if s == "QUIET":
        return None
    if s == "IGNITION":
        return "S2" if r.n_early >= 2 else "S1"
    if s == "COORDINATION_SPIKE":
        return steps(n, (6, "S5"), (5, "S4"), (4, "S3"), (None, "S2"))
    if s == "EARLY_PHASE":
        return "S3" if r.seconds >= 180 and r.n_early >= 3 else "S2"
    if s == "PERSISTENCE_CONFIRMED":
        return steps(n, (4, "S5"), (3, "S4"), (None, "S3"))
    if s == "PARTICIPATION_EXPANSION":
        return "S4" if r.trigger == "new_whale_burst_reversal" else steps(n, (3, "S4"), (2, "S3"), (None, "S2"))
    if s == "PRESSURE_PEAKING":
        return steps(n, (10, "S5"), (7, "S4"), (None, "S3"))
    if s == "EXHAUSTION_DETECTED":
        return steps(r.share, (0.8, "S5"), (0.7, "S4"), (None, "S3"))
    return "S4" if before in ("S4", "S5") else "S2"


def test_severities(changes):
    seen = set()
    for g in by(changes.collect(), "token", "episode").values():
        before = None  # the severity that the row before has of itself
        for r in g:
            assert r.severity == grade(r, before)
            before = grade(r, None)
            seen.add(r.to_state)
    assert len(seen) >= 6


def test_conflicts(spark):
    rows = [(lvl, dom, on, high) for lvl in ("NONE", "WARNING", "SHOUT") for dom in ("PUMP", "DUMP", "NEUTRAL") for on, high in ((False, False), (True, False), (True, True))]
    x = spark.createDataFrame(rows, "l string, d string, a boolean, b boolean")
    for r in x.withColumn("t", V.conflict(F.col("l"), F.col("d"), F.col("a"), F.col("b"))).collect():
        way = "pump" if r.d == "PUMP" else "dump"
        sure, maybe = r.l == "SHOUT" and r.b, r.l != "NONE" and r.a
        assert r.t == (f"SHOUT: CONFLICT — engineered {way} confirmed" if sure else f"WARNING: CONFLICT — engineered {way} conditions" if maybe else "")


def test_labels_of_wallets(spark):
    rows = [(1.0, 1, 1, 500, 0.1, 1.0), (7.0, 2, 2, 500, 0.1, 1.0), (2.0, 2, 9, 500, 0.1, 1.0), (2.0, 2, 2, 20, 0.1, 30.0), (2.0, 2, 2, 500, 0.6, 1.0), (2.0, 2, 2, 500, 0.1, 1.0)]
    x = spark.createDataFrame([(*map(float, r),) for r in rows], "median_buys double, attempts_median double, attempts_p90 double, median_hold double, partial_exit_rate double, per_hour double")
    assert [r[0] for r in x.select(N.seed_archetype()).collect()] == ["sniper", "ladder_accumulator", "ladder_accumulator", "recycler", "hybrid", "controlled_scaler"]
    y = spark.createDataFrame([(0.9, 4.0, 0.5, 2), (0.9, 4.0, 0.5, 0), (0.75, 9.0, 0.5, 5), (0.9, 40.0, 0.5, 0), (0.1, 40.0, 0.5, 0)], "lead_power double, lead_delay double, overlap_power double, n_shared long")
    y = y.withColumn("suspicion", N.suspicion())
    assert [(r.suspicion, r.x) for r in y.withColumn("x", N.replicable()).collect()] == [("high", "no"), ("high", "partial"), ("high", "partial"), ("medium", "yes"), ("low", "yes")]


def test_full_verdicts_by_hand(spark):
    x = flows(spark, demo_rows(5, 400)).withColumn("token", F.lit("a")).unionByName(flows(spark, demo_rows(6, 40)).withColumn("token", F.lit("b")))
    moves = [("a", 100, 1, "IGNITION", 1), ("a", 900, 2, "PRESSURE_PEAKING", 7), ("b", 100, 1, "PRESSURE_PEAKING", 5), ("b", 300, 2, "EXHAUSTION_DETECTED", 4)]
    changes = spark.createDataFrame(moves, "token string, bt long, seq long, to_state string, n long")
    cohorts = spark.createDataFrame([("a", 0, 10), ("a", 1, 2), ("a", 2, 2)], "token string, wave long, n long")
    got = {r.token: r for r in V.full_verdicts(x, changes, cohorts).collect()}
    plain = {r.token: r for r in V.verdict_record(x).collect()}
    assert set(got) == {"a", "b"} and all((got[t].capital, got[t].silent_share, got[t].exhaustion) == (plain[t].capital, plain[t].silent_share, plain[t].exhaustion) for t in got)
    # the last wave equals the one before, after a fall from 10 to 2; the peak of pressure of a stands, that of b is over
    assert (got["a"].trend, got["a"].cliff, got["a"].ghost, got["a"].peak, got["a"].entry, got["a"].entry_buyers) == ("STABLE", False, False, 10, True, 7)
    assert (got["b"].trend, got["b"].cliff, got["b"].ghost, got["b"].entry, got["b"].entry_buyers) == ("INSUFFICIENT_DATA", False, False, False, None)
    rows = [(r.wallet, r.bt, r.direction, r.lamports) for r in x.where("token = 'a'").collect()]
    end, last = max(r[1] for r in rows), {}
    for w, bt, _, _ in rows:
        last[w] = max(last.get(w, 0), bt)
    assert got["a"].silent_share == pytest.approx(sum(end - t > 120 for t in last.values()) / len(last))
    net = sum(v if d == "buy" else -v for _, _, d, v in rows)
    assert got["a"].capital == (1 if net > 0 else -1) * (2 if abs(net) / sum(r[3] for r in rows) >= 0.15 else 1)
