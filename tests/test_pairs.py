"""Joins of sets, pairs and paths against brute force, with hot items, hubs and ties; reports in order."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import evidence as V
from tidewake.operators import joins as J
from tidewake.sources import files, ingest, shared


def some_sets(rng, wallets=60, tokens=40):
    """Distinct (wallet, token, first_buy): one token that almost all hold, one wallet that holds almost all, an empty tail of rare ones."""
    out = {}
    for w in range(wallets):
        own = rng.sample(range(tokens), rng.choice([1, 2, 5, 20]))
        if w % 10:
            own.append(0)
        if w == 3:
            own = range(tokens)
        for t in own:
            out[f"w{w}", f"t{t}"] = rng.randrange(1000)
    return out


def frame(spark, sets):
    return spark.createDataFrame([(w, t, x) for (w, t), x in sets.items()], "wallet string, token string, first_buy long")


def naive_pairs(sets):
    by = {}
    for w, t in sets:
        by.setdefault(w, set()).add(t)
    return {(a, b): (len(by[a] & by[b]), min(len(by[a]), len(by[b]))) for a, b in itertools.combinations(sorted(by), 2)}


@pytest.mark.parametrize("seed", range(2))
def test_set_similarity_joins(spark, monkeypatch, seed):
    monkeypatch.setattr(J.dealt_join, "__defaults__", (7,))  # so small a block that hot tokens meet in many
    sets = some_sets(random.Random(seed))
    x, want = frame(spark, sets), naive_pairs(sets)
    for least in (1, 2, 4, 9, 50):
        for prefix in (True, False) if least > 1 else (None,):
            got = {(r.a, r.b): r.shared for r in J.sharing_pairs(x, least, prefix=prefix).collect()}
            assert got == {p: n for p, (n, _) in want.items() if n >= least}, (least, prefix)
    for share in (0.3, 0.5, 0.8, 1.0):
        for prefix in (True, False):
            rows = J.overlap_join(x, share, prefix=prefix).collect()
            assert len(rows) == len({(r.a, r.b) for r in rows})
            assert {(r.a, r.b): (r.shared, round(r.overlap, 9)) for r in rows} == {p: (n, round(n / m, 9)) for p, (n, m) in want.items() if n and n / m >= share}, share
    overlap = {(r.a, r.b): (r.shared, r.overlap) for r in J.token_overlap(x, x.select("wallet").distinct()).collect()}
    assert {p: v for p, v in overlap.items() if p[0] != p[1]} == {p: (n, n / m) for p, (n, m) in want.items() if n} and sum(a == b for a, b in overlap) == 60


@pytest.mark.parametrize("pays", [True, False])
def test_delays_only_of_pairs_that_share_enough(spark, monkeypatch, pays):
    sets = some_sets(random.Random(7))
    x, want = frame(spark, sets), naive_pairs(sets)
    whole = {(r.a, r.b): tuple(r) for r in J.pair_stats(x).collect()}
    monkeypatch.setattr(J, "prefix_pays", lambda *x: pays)
    some = {(r.a, r.b): tuple(r) for r in J.pair_stats(x, least_shared=5).collect()}
    assert set(whole) == {p for p, (n, _) in want.items() if n} and some == {p: v for p, v in whole.items() if v[2] >= 5} and some
    assert J.pair_stats(x.limit(0), least_shared=5).count() == 0 and J.overlap_join(x.limit(0)).count() == 0


def test_prefixes_leave_out_the_common_item(spark):
    """3,000 wallets hold one common token and three that they share with one other wallet: pairs of the common token alone are not formed where two are asked for."""
    n = 3000
    rows = spark.range(n * 4).select((F.col("id") % n).cast("string").alias("wallet"), F.when(F.col("id") < n, F.lit("hot")).otherwise(F.concat(F.lit("t"), F.floor(F.col("id") / 2).cast("string"))).alias("token"))
    ranked = J._ranked(rows, "wallet", "token").where(F.col("_row") < F.col("_n") - 1)
    assert ranked.where("token = 'hot'").count() == 0 and ranked.count() == 3 * n
    assert J.prefix_pays(rows, 2) and not J.prefix_pays(spark.range(400).select((F.col("id") % 20).alias("wallet"), F.floor(F.col("id") / 20).alias("token")), 2)
    assert [tuple(r) for r in J.sharing_pairs(rows, 2).groupBy("shared").count().collect()] == [(4, n // 2)] and J.sharing_pairs(rows, 5).count() == 0


def naive_routes(transfers, depth):
    """source -> target -> (hops, arrival, path), earliest arrivals kept by hop."""
    out = {}
    for source in {s for s, _, _ in transfers}:
        front = {source: (-(1 << 62), [])}
        best = {}
        for hop in range(1, depth + 1):
            new = {}
            for at, (since, path) in front.items():
                for s, d, t in transfers:
                    if s == at and t >= since and d != source:
                        option = (t, path + [at] if hop > 1 else path)
                        new[d] = min(new.get(d, option), option)
            for d, (t, path) in new.items():
                best.setdefault(d, (hop, t, path))
            front = new
        out[source] = best
    return out


def test_routes_against_brute_force(spark):
    rng = random.Random(3)
    names = [f"n{i}" for i in range(14)]
    transfers = [(rng.choice(names), rng.choice(names), rng.randrange(0, 400_000)) for _ in range(160)]
    transfers += [("hub", n, rng.randrange(0, 400_000)) for n in names for _ in range(4)] + [(n, "hub", rng.randrange(0, 300_000)) for n in names] + transfers[:20] + [("n1", "n1", 5), ("n2", "n3", 10), ("n2", "n3", 10)]
    t = spark.createDataFrame(transfers, "src string, dst string, bt long")
    creators, targets = t.select(F.col("src").alias("wallet")), t.select(F.col("dst").alias("wallet"))
    for depth in (1, 2, 3):
        want = naive_routes(transfers, depth)
        rows = J.funding_routes(t, creators, targets, depth, block=5).collect()
        assert {(r.source, r.target): (r.hops, r.arrival, r.path) for r in rows} == {(s, d): v for s, x in want.items() for d, v in x.items()} and len(rows) == sum(map(len, want.values())), depth
    some = {(r.source, r.target) for r in J.funding_paths(t, creators.where("wallet IN ('n1', 'hub')"), targets.where("wallet < 'n2'")).collect()}
    assert some == {(s, d) for s in ("n1", "hub") for d in naive_routes(transfers, 2)[s] if d < "n2"}


def test_hub_is_dealt_out(spark):
    """300 senders to one hub with 300 receivers: of 90,000 steps no task gets more than its pair of blocks."""
    front = spark.range(300).select(F.concat(F.lit("s"), "id").alias("source"), F.lit("hub").alias("src"))
    sent = spark.range(300).select(F.lit("hub").alias("src"), F.concat(F.lit("d"), "id").alias("dst"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        sizes = [r["count"] for r in J.dealt_join(front, sent, "src", 50).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 90_000 and len(sizes) == 4 and max(sizes) < 0.5 * 90_000
    blocks = J.dealt_join(front, sent, "src", 50).count()
    assert blocks == 90_000


def test_intermediaries_by_hand(spark):
    buyers = spark.createDataFrame([("t1", "c", "x"), ("t2", "c", "x"), ("t1", "c", "y"), ("t1", "c", "z"), ("t3", "e", "x")], "token string, creator string, wallet string")
    t = spark.createDataFrame([("c", "m", 1), ("m", "x", 2), ("c", "k", 1), ("k", "x", 2), ("m", "y", 9), ("c", "z", 1), ("c", "late", 50), ("late", "y", 3), ("e", "m", 100)], "src string, dst string, bt long")
    funded = V.funded_buyers(buyers, J.funding_routes(t, buyers.select(F.col("creator").alias("wallet")), buyers.select("wallet")))
    got = {(r.token, r.creator, r.wallet): (r.direct, r.indirect, r.path) for r in funded.collect()}
    assert got["t1", "c", "x"] == (False, True, ["k"]) and got["t1", "c", "y"] == (False, True, ["m"]) and got["t1", "c", "z"] == (True, False, []) and got["t3", "e", "x"] == (False, False, None)
    assert [tuple(r) for r in V.intermediaries(funded).orderBy("rank").collect()] == [("c", "k", 2, 2, 1), ("c", "m", 1, 1, 2)]
    assert [r.wallet for r in V.intermediaries(funded, 1).collect()] == ["k"]


def test_reports_in_order(spark):
    x = spark.range(5000).select((F.col("id") * 7919 % 100).alias("v"), F.col("id").cast("string").alias("name")).unionAll(spark.createDataFrame([(None, "none")], "v long, name string"))
    path = shared.new_path(spark, "test-report")
    files.write_ordered(x, [F.desc("v"), F.asc("name")], path, 7)
    got = files.read_ordered(spark, path).orderBy("row_no").collect()
    want = sorted(((r.v, r.name) for r in x.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    assert [(r.v, r.name) for r in got] == want and [r.row_no for r in got] == list(range(1, 5002))
    parts = [r["count"] for r in spark.read.parquet(path).groupBy("_part").count().collect()]
    assert len(parts) >= 5 and max(parts) < 3 * 5001 / 7
    files.write_ordered(x.limit(0), [F.asc("v")], path + "-none")
    assert files.read_ordered(spark, path + "-none").count() == 0


def test_repeated_mints_keep_their_rows(spark):
    data = bytes([1, 0, 0, 0]) + bytes(range(32)) + (10).to_bytes(8, "little") + bytes([6, 1]) + bytes(36)
    x = spark.createDataFrame([("m", data, "o"), ("m", data, "o"), ("n", b"", "o"), (None, data, "p")], "mint string, data binary, owner string")
    got = ingest.mint_security(x).collect()
    assert len(got) == 4 and sorted((r.mint or "", r.decimals, int(r.supply_raw or 0)) for r in got) == [("", 6, 10), ("m", 6, 10), ("m", 6, 10), ("n", None, 0)]
    assert ingest.mint_account(x).count() == 4
