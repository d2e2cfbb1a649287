"""Streams that come out of order, forget, and count; the machine's other rules; and records by hand."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tests.test_operators import demo_rows, flows
from tidewake.functions import scalar as S
from tidewake.operators import machine as M
from tidewake.sources import ingest as I
from tidewake.streaming import pipeline


def landed(tmp_path, parts):
    land = tmp_path / "land"
    land.mkdir(exist_ok=True)
    for k, rows in enumerate(parts):
        (land / f"{k:04}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(land / f"{k:04}.json", (1_700_000_000 + k, 1_700_000_000 + k))  # files are taken in order of their times
    return str(land)


def finished(stream, name, tmp_path):
    q = stream.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"cp-{name}")).trigger(availableNow=True).start()
    q.awaitTermination(180)
    return q


def test_rows_out_of_order_across_batches(spark, tmp_path):
    x = flows(spark, demo_rows(6))
    lines = [r.asDict() for r in x.orderBy("seq").collect()]
    end = [{**lines[-1], "token": "zz", "bt": lines[-1]["bt"] + 100_000, "seq": 10_000 + k, "signature": f"end{k}"} for k in range(2)]
    parts = [lines[k : k + 20] for k in range(0, len(lines), 20)]
    parts[2], parts[3] = parts[3], parts[2]  # within the delay of the watermark
    path = landed(tmp_path, [*parts, end[:1], end[1:]])
    stream = pipeline.landed(spark, path, "100 minutes", 1)
    q = finished(pipeline.transitions(pipeline.audited(stream), ordered=True), "sorted_moves", tmp_path)
    key = lambda df: sorted((r.bt, r.seq, r.from_state, r.to_state, r.n) for r in df.where("token <> 'zz'").collect())
    assert key(spark.table("sorted_moves")) == key(M.transitions(x))
    counts = pipeline.audit(q)
    assert counts["rows"] == len(lines) + 2 and counts["late"] == 0 and counts["first_bt"] == lines[0]["bt"] and counts["state_rows"] > 0


def test_late_rows_are_counted_and_idle_state_ends(spark, tmp_path):
    row = lambda token, bt, k: {"wallet": "w", "token": token, "bt": bt, "direction": "buy", "lamports": 10**10, "signature": f"s{k}", "seq": k}
    path = landed(tmp_path, [[row("a", 1_000_000, 0)], [row("b", 1_100_000, 1)], [row("y", 1_150_000, 2)], [row("b", 1_200_000, 3)], [row("z", 1_250_000, 4)], [row("a", 1_000_001, 5)], [row("b", 1_300_000, 6)]])
    q = finished(pipeline.transitions(pipeline.landed(spark, path, "10 minutes", 1), idle=3600), "idle_moves", tmp_path)
    assert pipeline.audit(q)["late"] == 1
    got = [(r.token, r.bt, r.episode) for r in spark.table("idle_moves").where("to_state = 'IGNITION'").orderBy("bt").collect()]
    assert got == [("a", 1_000_000, 1), ("b", 1_100_000, 1), ("y", 1_150_000, 1), ("b", 1_200_000, 1), ("z", 1_250_000, 1), ("b", 1_300_000, 1)]  # each time anew


def compat_by_hand(rows, whales):
    """QUIET and IGNITION of the loose rules: any flow ignites once there was a whale; quiet by the whale before the last."""
    seen, state, out = [], "QUIET", []
    for (w, t, _, _), whale in zip(rows, whales, strict=True):
        seen += [t] * whale
        back = seen[-2] if len(seen) > 1 else seen[-1] if seen else None
        if state == "QUIET" and seen:
            state = "IGNITION"
            out.append((t, state))
        elif state == "IGNITION" and back is not None and t - back >= 600:
            state = "QUIET"
            out.append((t, state))
    return out


def test_loose_rules_alternate():
    rows = [("a", 0, "buy", 11), ("b", 700, "buy", 1), ("c", 701, "buy", 1), ("d", 702, "buy", 1), ("e", 703, "buy", 11), ("e", 704, "buy", 1), ("e", 1400, "buy", 1), ("e", 1401, "sell", 1)]
    whales = [r[3] >= 10 for r in rows]
    token = M.Token(strict=False)
    got = [(x[0], x[5]) for x in M.fold(iter([(t, k, w, d == "buy", whale) for k, ((w, t, d, _), whale) in enumerate(zip(rows, whales, strict=True))]), token)]
    assert got == compat_by_hand(rows, whales) and [s for _, s in got[:4]] == ["IGNITION", "QUIET", "IGNITION", "QUIET"]
    strict = M.Token()
    assert len(list(M.fold(iter([(t, k, w, d == "buy", whale) for k, ((w, t, d, _), whale) in enumerate(zip(rows, whales, strict=True))]), strict))) < len(got)


def test_second_machine_goes_through_its_states():
    token, steps = M.TokenV2(), []
    script = [("a", 0, True), ("b", 20, True), ("c", 40, True), ("a", 170, False), ("a", 300, False), ("b", 301, False), ("x", 310, True), ("y", 311, False), ("z", 312, True), ("u", 313, True), ("v", 314, True), ("q", 315, True), ("q", 700, False), ("q", 1001, False), ("k", 1002, True)]
    for w, t, whale in script:
        change = token.step(w, t, True, whale)
        if change:
            steps.append((t, change[1]))
    assert steps == [(0, "IGNITION"), (40, "COORDINATION_SPIKE"), (170, "EARLY_PHASE"), (301, "PERSISTENCE_CONFIRMED"), (310, "PARTICIPATION_EXPANSION"), (315, "PRESSURE_PEAKING"), (700, "EXHAUSTION_DETECTED"), (1001, "QUIET"), (1002, "IGNITION")]


def test_wallets_are_forgotten_but_for_the_cohort():
    token = M.Token()
    for k in range(50):
        token.step(f"w{k}", 1000 + k, True, k < 3)
    token.forget(10_000, 900)
    assert set(token.wallets) == set(token.cohort) | set(token.early) and token.persistent == 0


@pytest.mark.parametrize("raw", [b"", b"\0", b"\0\0\1", bytes(range(32)), b"\xff" * 32])
def test_base58(spark, raw):
    got = spark.createDataFrame([(raw,)], "x binary").select(S.base58(F.col("x"))).first()[0]
    number = 0
    for c in got:
        number = number * 58 + S.BASE58.index(c)
    assert got.startswith("1" * (len(raw) - len(raw.lstrip(b"\0")))) and number == int.from_bytes(raw, "big") and len(got) - len(got.lstrip("1")) == len(raw) - len(raw.lstrip(b"\0"))


def test_capped_details_at_any_depth(spark):
    value = {"a": list(range(9)), "b": {"c": ["x" * 400] * 7, "d": "y" * 320}, "e": None}
    got = spark.createDataFrame([(json.dumps(value),), ("no json",), (None,)], "x string").select(I.capped_details(F.col("x"))).collect()
    out = json.loads(got[0][0])
    assert out == {"a": [0, 1, 2, 3, 4], "b": {"c": ["x" * 320 + "..."] * 5, "d": "y" * 320}, "e": None} and got[1][0] == "no json" and got[2][0] is None


def test_resumable_run(spark):
    runs = spark.createDataFrame([("r1", "b", 1, 5), ("r2", "b", 7, None), ("r3", "c", 9, None)], "run_id string, kind string, started long, ended long")
    assert [r.run_id for r in I.resumable(runs, "b").collect()] == ["r2"]
    empty = spark.createDataFrame([], "key string, error string")
    run, errors = I.finished_run(None, "r4", "b", 1, 2, spark.range(3), empty)
    assert (run.first().status, run.first().n_done, errors.count()) == ("done", 3, 0)
