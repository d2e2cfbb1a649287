"""Edge cases and folds against plain Python."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tidewake.functions import scalar as S
from tidewake.operators import joins as J
from tidewake.operators import machine as M
from tidewake.operators import positions as P
from tidewake.operators import windows as W
from tidewake.sources import ingest as I

FLOWS = "wallet string, token string, bt long, direction string, lamports long, signature string, seq long"
SOL = 1_000_000_000


def flows(spark, rows):
    """rows: (wallet, bt, direction, sol), in arrival order."""
    return spark.createDataFrame([(w, "T", t, d, int(x * SOL), f"s{i}", i) for i, (w, t, d, x) in enumerate(rows)], FLOWS)


def test_latches_and_window_edges(spark):
    # a crossing counts once; a row exactly 300 s old is inside; one of the same second that came later is not
    x = flows(spark, [("a", 0, "buy", 12), ("a", 10, "buy", 13), ("b", 0, "sell", 24), ("b", 300, "sell", 1), ("c", 0, "buy", 24), ("c", 301, "buy", 1), ("d", 5, "buy", 9), ("d", 5, "buy", 16)])
    got = {(r.wallet, r.event_type, r.bt, r.seq) for r in W.whale_crossings(x).collect()}
    assert got == {("a", "WHALE_TX", 0, 0), ("a", "WHALE_CUM_5M", 10, 1), ("b", "WHALE_TX", 0, 2), ("b", "WHALE_CUM_5M", 300, 3), ("c", "WHALE_TX", 0, 4), ("d", "WHALE_TX", 5, 7), ("d", "WHALE_CUM_5M", 5, 7)}


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_sums_by_hand(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("ab"), rng.randrange(20_000), "buy", rng.randrange(1, 9)) for _ in range(300)]
    got = {r.seq: (r.sum_5m, r.sum_15m) for r in W.rolling_sums(flows(spark, rows)).collect()}
    for i, (w, t, _, _) in enumerate(rows):
        back = lambda s: sum(x * SOL for j, (v, u, _, x) in enumerate(rows) if v == w and t - s <= u <= t and (u < t or j <= i))  # noqa: B023, E731
        assert got[i] == (back(300), back(900))


def machine_by_hand(rows):
    """Transitions by the table of conditions, from all rows so far at every step."""
    out, state, since, early, cohort, wave_start, checked, flagged = [], "QUIET", None, [], [], rows[0][1], set(), set()
    last_whale, peak, crossed, episode = None, 0, {}, 0
    for i, (w, t, d, x) in enumerate(rows):
        own = [(u, y) for v, u, _, y in rows[: i + 1] if v == w]
        kinds = {k for k, s, lim in (("tx", 0, 10), ("5", 300, 25), ("15", 900, 50)) if (x if k == "tx" else sum(y for u, y in own if u >= t - s)) >= lim}
        whale = bool(kinds - crossed.setdefault(w, set()))
        crossed[w] |= kinds
        seen = {}
        for v, u, _, _ in rows[:i]:
            seen[v] = u
        if w in seen and i and rows[i - 1][1] - seen[w] > 120:
            flagged.add(w)
        if d == "buy":
            flagged.discard(w)
        seen[w] = t
        previous = last_whale
        if whale:
            if w not in checked:
                checked.add(w)
                if 0 <= own[0][0] - wave_start <= 300:
                    early += [w] * (w not in early)
                    cohort += [w] * (w not in cohort)
            last_whale = t
        active = lambda s, without=(): [v for v, u in seen.items() if t - u < s and v not in without]  # noqa: B023, E731
        new = None
        if state != "QUIET" and previous is not None and t - previous >= 600:
            new = "QUIET"
        elif state == "QUIET":
            if whale:
                new = "IGNITION"
                if previous is None or t - previous >= 600:
                    episode, wave_start, peak = episode + 1, t, 0
                    cohort = [v for v in cohort if min(u for a, u, _, _ in rows if a == v) >= t]
        elif state == "IGNITION":
            new = "COORDINATION_SPIKE" if len(early) >= 3 else None
        elif state == "COORDINATION_SPIKE":
            new = "EARLY_PHASE" if t - since >= 120 else None
        elif state == "EARLY_PHASE":
            minutes = {}
            for v, u, _, _ in rows[: i + 1]:
                minutes.setdefault(v, set()).add(u // 60)
            new = "PERSISTENCE_CONFIRMED" if sum(len(m) >= 2 for m in minutes.values()) >= 2 else None
        elif state == "PERSISTENCE_CONFIRMED":
            new = "PARTICIPATION_EXPANSION" if active(300, early) else None
        elif state == "PARTICIPATION_EXPANSION":
            recent = [(v, u, b) for v, u, b in whales_so_far(rows, i) if u >= t - 120]
            best = len({v for v, _, _ in recent}) > peak
            peak = max(peak, len({v for v, _, _ in recent}))
            new = "PRESSURE_PEAKING" if best and sum(b for _, _, b in recent) >= 5 else None
        elif state == "PRESSURE_PEAKING":
            quiet = [v for v in cohort if v in flagged or t - seen[v] > 120]
            new = "EXHAUSTION_DETECTED" if cohort and len(quiet) / len(cohort) >= 0.6 else None
        elif state == "EXHAUSTION_DETECTED":
            if len(active(60, cohort)) >= 3:
                new, wave_start, cohort, peak = "PARTICIPATION_EXPANSION", t, [], 0
                checked, flagged = set(), set()
        if new:
            out.append((t, state, new))
            state, since = new, t
    return out


def whales_so_far(rows, i):
    crossed, out = {}, []
    for j, (w, t, d, x) in enumerate(rows[: i + 1]):
        own = [(u, y) for v, u, _, y in rows[: j + 1] if v == w]
        kinds = {k for k, s, lim in (("tx", 0, 10), ("5", 300, 25), ("15", 900, 50)) if (x if k == "tx" else sum(y for u, y in own if u >= t - s)) >= lim}
        if kinds - crossed.setdefault(w, set()):
            out.append((w, t, d == "buy"))
        crossed[w] |= kinds
    return out


def demo_rows(seed=5, n=160):
    rng, t, rows = random.Random(seed), 1_000_000, []
    for k in range(n):
        t += rng.choice([1, 3, 5, 20]) if k % 60 else rng.choice([130, 650])
        rows.append((rng.choice("abcdefghijkl"), t, rng.choice(["buy", "buy", "sell"]), rng.choice([1, 4, 11, 26])))
    return rows


@pytest.mark.parametrize("seed", [5, 6, 7])
def test_machine_by_hand(spark, seed):
    rows = demo_rows(seed)
    got = [(r.bt, r.from_state, r.to_state) for r in M.transitions(flows(spark, rows)).orderBy("bt", "seq").collect()]
    assert got == machine_by_hand(rows)
    assert len(got) > 3


def test_state_survives_saving():
    token, copy = M.Token(), M.Token()
    for w, t, d, x in demo_rows():
        assert token.step(w, t, d == "buy", x >= 10) == copy.step(w, t, d == "buy", x >= 10)
        copy = M.Token(copy.saved())


def test_stream_equals_batch(spark, tmp_path):
    from tidewake.streaming import pipeline

    rows = demo_rows(6)
    x = flows(spark, rows)
    land = tmp_path / "land"
    land.mkdir()
    lines = [r.asDict() for r in x.orderBy("seq").collect()]
    for k in range(0, len(lines), 60):
        (land / f"{k:04}.json").write_text("\n".join(map(json.dumps, lines[k : k + 60] + lines[k : k + 5])))
        os.utime(land / f"{k:04}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in order of their times
    stream = pipeline.transitions(pipeline.landed(spark, str(land), files_a_batch=1))
    q = stream.writeStream.format("memory").queryName("moves").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda df: sorted((r.bt, r.seq, r.from_state, r.to_state, r.n) for r in df.collect())
    assert key(spark.table("moves")) == key(M.transitions(x))


def test_positions_over_sell_and_ties(spark):
    rows = [("in", 5, 0), ("out", 9, 1), ("out", 2, 2), ("in", 4, 3), ("out", 4, 3), ("in", 1, 4)]
    x = spark.createDataFrame([("w", "t", bt, d, u, u * SOL, i, 0) for i, (d, u, bt) in enumerate(rows)], "wallet string, token string, bt long, flow_direction string, units long, lamports long, seq long, line long")
    got = [(r.position, r.entry, r.exit, r.n_buys, r.n_sells, r.max_size, r.over_sold) for r in P.positions(P.signed(x)).orderBy("position").collect()]
    assert got == [(1, 0, 1, 1, 1, 5, True), (2, 3, 3, 1, 1, 4, False), (3, 4, None, 1, 0, 1, False)]


def test_nearest_prefers_the_later_of_equals(spark):
    a = spark.createDataFrame([("t", 100), ("t", 500), (None, 100), ("u", 100)], "token string, bt long")
    b = spark.createDataFrame([("t", 90, 1), ("t", 110, 2), ("t", 111, None), ("t", 559, 3), ("t", 440, 4)], "token string, mcap_time long, mcap long")
    got = {(r.token, r.bt): r.mcap for r in J.nearest(a, b).collect()}
    assert got == {("t", 100): 2, ("t", 500): 3, (None, 100): None, ("u", 100): None}


def test_a_loop_counts_once(spark):
    e = spark.createDataFrame([("a", "a", 3), ("a", "b", 2), ("b", "a", 1)], "wallet_a string, wallet_b string, weight long")
    s = spark.createDataFrame([("a",), ("z",)], "wallet string")
    assert {(r.neighbour, r.weight) for r in J.neighbours(e, s).collect()} == {("a", 3), ("b", 3)}
    assert {r.wallet: r.degree for r in J.degrees(e, s).collect()} == {"a": 4, "z": 0}


def test_scalars(spark):
    x = spark.createDataFrame([("1704067200",), ("1704067200123",), ("2024-01-01T00:00:00Z",), ("2024-01-01T00:00:00",), ("nope",), (None,)], "x string")
    assert [r[0] for r in x.select(S.epoch_seconds(F.col("x"))).collect()] == [1704067200] * 4 + [None] * 2
    y = spark.createDataFrame([("3.5",), ('"4.5"',), ('{"uiAmount":1.5}',), ('{"uiAmountString":"2.5"}',), ('{"amount":"1500","decimals":3}',), ("{}",)], "x string")
    assert [r[0] for r in y.select(S.token_amount(F.col("x"))).collect()] == [3.5, 4.5, 1.5, 2.5, 1.5, None]
    z = spark.createDataFrame([(37.5,), (42.5,), (200.0,), (1.0,)], "x double")
    assert [r[0] for r in z.select(S.confidence(F.col("x"))).collect()] == [40, 40, 95, 35]


def test_canonicalize(spark):
    df = spark.createDataFrame([(1, "a")], "Block_Time long, token_mint string")
    assert I.canonicalize(df, {"bt": ("block_time", "ts"), "token": ("mint",)}).columns == ["bt", "token"]
    with pytest.raises(ValueError, match="no column"):
        I.canonicalize(df, {"x": ("wallet",)})
    with pytest.raises(ValueError, match="several"):
        I.canonicalize(df.withColumn("mint_b", F.lit(1)), {"x": ("mint",)})


def test_empty_flows(spark):
    x = spark.createDataFrame([], FLOWS)
    for f in (W.rolling_sums, W.whale_crossings, W.coordination, W.persistence, W.cohort_silence, M.transitions, W.silence_curve, W.episodes):
        assert f(x).count() == 0


def test_order_of_input_does_not_matter(spark):
    rows = demo_rows(9)
    x = flows(spark, rows)
    key = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert key(M.transitions(x)) == key(M.transitions(x.orderBy(F.rand(3))))


def test_value_at_an_index(spark):
    from tidewake.operators import aggregates as A

    rng = random.Random(8)
    groups = {"hot": [rng.expovariate(1) ** 6 for _ in range(3000)], "ties": [rng.choice([1.0, 1.0, 2.0]) for _ in range(50)], "one": [7.0], None: [rng.random() for _ in range(40)], "odd": [float("inf"), float("-inf"), 1.0, 2.0, float("nan")]}
    x = spark.createDataFrame([(k, v) for k, vs in groups.items() for v in vs] + [("hot", None), ("none", None)], "k string, v double")
    for share in (0.0, 0.2, 0.5, 1.0):
        got = {r.k: r._at for r in A.at_index(x, ("k",), "v", lambda n: F.floor(F.lit(share) * n)).collect()}
        order = lambda v: (v != v, v)  # noqa: E731  NaN last
        want = {k: sorted(vs, key=order)[min(int(share * len(vs)), len(vs) - 1)] for k, vs in groups.items()}
        assert set(got) == set(want) and all(got[k] == want[k] or got[k] != got[k] and want[k] != want[k] for k in want), share
