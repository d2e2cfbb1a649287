"""State that a batch touches, streams against batches, wallets that leave, and counters over many batches and restarts."""

import json
import random

from pyspark.sql import functions as F

from tests.test_streams import finished, landed
from tidewake.operators import machine as M
from tidewake.streaming import pipeline

FIELDS = ("wallet", "token", "bt", "direction", "lamports", "signature", "seq")


def some_flows(rng, n, tokens=3, wallets=40):
    bt, out = 1_000_000, []
    for k in range(n):
        bt += rng.choice([0, 1, 2, 5, 9, 30, 200] + [700] * (rng.random() < 0.05))
        out.append(dict(zip(FIELDS, (f"w{rng.randrange(wallets)}", f"t{rng.randrange(tokens)}", bt, rng.choice(["buy", "buy", "sell"]), rng.choice([1, 3, 6, 12]) * 10**9, f"s{k}", k))))
    return out


def moves(df):
    return sorted(tuple(r[c] for c in M.TRANSITIONS.names) for r in df.where("token <> 'zz'").select(*M.TRANSITIONS.names).collect())


def ends(rows, by=100_000):
    return [[{**rows[-1], "token": "zz", "bt": rows[-1]["bt"] + by * (k + 1), "seq": 10**6 + k, "signature": f"end{k}"}] for k in range(2)]


def test_stream_equals_batch(spark, tmp_path):
    rows = some_flows(random.Random(5), 700)
    rng = random.Random(6)
    late = sorted(rows, key=lambda r: r["bt"] + rng.randrange(0, 240))  # out of order by less than the delay
    q = finished(pipeline.transitions(pipeline.landed(spark, landed(tmp_path, [late[k : k + 90] for k in range(0, len(late), 90)] + ends(rows)), "10 minutes", 1), ordered=True), "random_moves", tmp_path)
    want = moves(M.transitions(spark.createDataFrame([tuple(r[c] for c in FIELDS) for r in rows], pipeline.FLOW_DDL)))
    got = moves(spark.table("random_moves"))
    assert got == want and len({r[6] for r in got}) >= 5 and q.exception() is None


def test_a_batch_touches_its_own_state(spark, tmp_path):
    """A token with 400 wallets: a batch of one row updates a handful of rows, however many wallets there are."""
    many = [dict(zip(FIELDS, (f"w{k}", "a", 1_000_000 + k, "buy", 10**9, f"s{k}", k))) for k in range(400)]
    one = [[dict(zip(FIELDS, (f"w{7 * k}", "a", 1_000_400 + k, "buy", 10**9, f"x{k}", 1000 + k)))] for k in range(3)]
    q = finished(pipeline.transitions(pipeline.landed(spark, landed(tmp_path, [many, *one]), "10 minutes", 1)), "touched", tmp_path)
    by_batch = [next(s for s in p.stateOperators if s.operatorName.startswith("transformWithState")) for p in q.recentProgress if p.numInputRows]
    assert by_batch[0].numRowsUpdated > 400 and by_batch[0].numRowsTotal > 400
    assert all(s.numRowsUpdated < 12 and s.numRowsTotal > 400 for s in by_batch[1:]) and len(by_batch) == 4


def test_wallets_leave_and_timers_clear(spark, tmp_path):
    row = lambda w, bt, k: dict(zip(FIELDS, (w, "a", bt, "buy", 10**9, f"s{k}", k)))
    parts = [[row(f"w{k}", 1_000_000 + k, k) for k in range(50)], *[[row("v", 1_000_000 + 3000 * k, 100 + k)] for k in range(1, 6)]]
    parts += [[{**row("x", 1_030_000 + 3000 * k, 200 + k), "token": "b"}] for k in range(3)]
    q = finished(pipeline.transitions(pipeline.landed(spark, landed(tmp_path, parts), "1 minutes", 1), idle=3600), "leaving", tmp_path)
    totals = [next(s for s in p.stateOperators if s.operatorName.startswith("transformWithState")).numRowsTotal for p in q.recentProgress]
    # wallets idle for long are swept while the token lives, and a token without flows leaves nothing
    assert max(totals) > 50 and totals[-1] < 12, totals


def test_counters_of_all_batches_and_restarts(spark, tmp_path):
    row = lambda k: dict(zip(FIELDS, ("" if k % 10 == 0 else "w", "a", 1_000_000 + k, "buy", 10**9, f"s{k}", k)))
    audit, folder = pipeline.Audit(spark, str(tmp_path / "audit")), tmp_path / "land"
    spark.streams.addListener(audit)

    def run():
        stream = spark.readStream.schema(pipeline.FLOW_DDL).option("maxFilesPerTrigger", 1).json(str(folder))
        q = pipeline.audited(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(240)
        return q

    landed(tmp_path, [[row(k)] for k in range(150)])
    q = run()
    got = audit.counters(q)
    assert len(q.recentProgress) <= 101 and (got["batches"], got["rows"], got["read"], got["no_wallet"], got["buys"]) == (150, 150, 150, 15, 150)
    assert (got["first_bt"], got["last_bt"]) == (1_000_000, 1_000_149)
    spark.streams.removeListener(audit)

    # a new driver: the counters go on from the file, and a batch that is reported again is not counted again
    again = pipeline.Audit(spark, str(tmp_path / "audit"))
    spark.streams.addListener(again)
    for k in range(150, 155):
        (folder / f"{k:04}.json").write_text(json.dumps(row(k)))
    q = run()
    got = again.counters(q)
    assert (got["batches"], got["rows"], got["no_wallet"], got["last_bt"]) == (155, 155, 16, 1_000_154)
    state = again.known[str(q.id)]
    again.onQueryProgress(type("E", (), {"progress": q.lastProgress})())
    assert again.known[str(q.id)] == state
    spark.streams.removeListener(again)


def test_progress_kept_by_the_query(spark, tmp_path):
    rows = some_flows(random.Random(1), 40)
    stream = pipeline.audited(spark.readStream.schema(pipeline.FLOW_DDL).json(landed(tmp_path, [rows])))
    q = finished(stream.select("seq"), "kept_progress", tmp_path)
    got = pipeline.audit(q)
    assert got["rows"] == 40 and got["batches"] >= 1 and spark.table("kept_progress").agg(F.max("seq")).first()[0] == 39
