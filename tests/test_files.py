"""File scans and sinks, and the stateless parts of the stream."""

import json

from pyspark.sql import functions as F

from tidewake.operators import joins as J
from tidewake.operators.episodes import token_episodes
from tidewake.sources import files, ingest
from tests.test_operators import demo_rows, flows


def test_event_log_round_trip(spark, tmp_path):
    x = spark.createDataFrame([("e1", "SWAP", "s1", 5, 100, "p", "m", None, ["a", 'b "q", c'], {"z": "1", "a": "2"}, "rpc", "1")], "event_id string, event_type string, signature string, slot long, block_time long, program_id string, token_mint string, pool_id string, actors array<string>, amounts map<string,string>, source string, version string")
    files.write_events(x, str(tmp_path / "log"))
    text = spark.read.text(str(tmp_path / "log")).collect()
    assert text[0][0].split(",")[:3] == ["event_id", "event_type", "signature"] and '{""a"":""2"",""z"":""1""}' in text[1][0].replace('\\"', '""')
    r = files.read_events(spark, str(tmp_path / "log")).collect()[0]
    assert (r.slot, r.block_time, r.actors, r.amounts) == (5, 100, ["a", 'b "q", c'], {"a": "2", "z": "1"})


def test_transition_tsv_round_trip(spark, tmp_path):
    x = spark.createDataFrame([tuple(f"v{i}\tx\ny" if i == 6 else f"v{i}" for i in range(10))], ", ".join(f"{c} string" for c in files.TRANSITION_COLUMNS))
    files.write_tsv(x, str(tmp_path / "t"))
    r = files.read_tsv(spark, str(tmp_path / "t")).collect()[0]
    assert r.trigger == "v6 x y" and r.version == "v9"


def test_session_replay_skips_malformed_lines(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text(json.dumps({"event_type": "SESSION_START", "timestamp": 1}) + "\n\nnot json\n" + json.dumps({"event_type": "WALLET_SIGNAL", "timestamp": 2, "signals": ["TIMING"]}) + "\n")
    good, bad = files.read_session(spark, str(p))
    assert [r.event_type for r in good.orderBy("timestamp").collect()] == ["SESSION_START", "WALLET_SIGNAL"] and [r.line for r in bad.collect()] == ["not json"]


def test_names_and_seeds(spark, tmp_path):
    (tmp_path / "n.json").write_text('{"A": "Alice", "B": null, "C": ""}')
    (tmp_path / "seeds.txt").write_text("# list\n b \na\nb\n\n")
    names = files.read_names(spark, str(tmp_path / "n.json"))
    assert [tuple(r) for r in names.collect()] == [("A", "Alice")]
    seeds = ingest.seeds_from_text(files.read_seeds(spark, str(tmp_path / "seeds.txt")))
    assert [r.seed for r in seeds.orderBy("line_no").collect()] == ["b", "a"]
    x = J.named(spark.createDataFrame([("A",), ("Z",)], "wallet string"), names)
    assert {r.wallet: r.name for r in x.collect()} == {"A": "Alice", "Z": "Z"}


def test_landed_swaps_with_faults(spark, tmp_path):
    w = "W" * 44
    good = {"signature": "s", "timestamp": 9, "type": "SWAP", "feePayer": w, "accountData": [{"account": w, "nativeBalanceChange": -5}], "nativeTransfers": None, "tokenTransfers": []}
    moved = good | {"signature": "t", "accountData": [], "nativeTransfers": [{"fromUserAccount": "x", "toUserAccount": w, "amount": 7}]}
    (tmp_path / "a.json").write_text("\n".join([json.dumps(good), json.dumps(moved), json.dumps(good | {"type": "BURN"}), json.dumps(good | {"feePayer": "short"}), "{oops"]))
    raw = ingest.read_swaps(spark, str(tmp_path))
    assert raw.where("corrupt IS NOT NULL").count() == 1
    got = {(r.signature, r.direction, r.lamports) for r in ingest.parse_swaps(raw.withColumn("token", F.lit("T"))).collect()}
    assert got == {("s", "buy", 5), ("t", "sell", 7)}


def test_session_levels(spark):
    x = flows(spark, demo_rows(1, 5))
    log = {"FLOW": x, "STATE_TRANSITION": x.limit(2)}
    assert ingest.session_log(log).count() == 7 and ingest.session_log(log, "MINIMAL").count() == 2


def test_stream_sessions_match_episodes(spark, tmp_path):
    from tidewake.streaming import pipeline

    x = flows(spark, demo_rows(3))
    x.coalesce(1).write.json(str(tmp_path / "in"))
    q = pipeline.sessions(pipeline.landed(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("gaps").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    # a session window ends gap seconds after its last flow, so a pause of exactly gap seconds starts another
    want = token_episodes(x, 599).groupBy("episode").agg(F.min("bt").alias("a"), F.count("*").alias("n"))
    assert sorted((r.start_bt, r.n_flows) for r in spark.table("gaps").collect()) == sorted((r.a, r.n) for r in want.collect())


def test_stream_minutes_and_log(spark, tmp_path):
    from tidewake.streaming import pipeline

    x = flows(spark, demo_rows(4, 60))
    x.coalesce(1).write.json(str(tmp_path / "in"))
    live = pipeline.landed(spark, str(tmp_path / "in"))
    q = pipeline.minute_totals(live).writeStream.format("memory").queryName("minutes").outputMode("complete").option("checkpointLocation", str(tmp_path / "c1")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = x.groupBy("token", "direction", (F.floor(F.col("bt") / 60) * 60).alias("minute")).agg(F.count("*").alias("n"))
    assert sorted((r.direction, r.minute, r.n) for r in spark.table("minutes").collect()) == sorted((r.direction, r.minute, r.n) for r in want.collect())
    q = pipeline.log_sink(live.select("wallet", "token", "bt"), str(tmp_path / "log"), str(tmp_path / "c2")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.read.json(str(tmp_path / "log")).count() == 60
