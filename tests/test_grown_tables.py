"""What grew faster than its tables: rows that moved between tasks, steps that ran twice, partitions that AQE put together."""

import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import archetype as R
from tidewake.operators import joins as J
from tidewake.plans import network as N
from tidewake.plans import trade_queries as T
from tidewake.sources.canonical import Tables


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def some_firsts(spark, wallets=50, tokens=30):
    rng = random.Random(3)
    x = [(f"w{w}", f"t{t}", rng.choice([rng.randrange(9), rng.randrange(1 << 30)])) for w in range(wallets) for t in rng.sample(range(tokens), rng.choice([2, 12, 26]))]
    return spark.createDataFrame(x, "wallet string, token string, first_buy long").localCheckpoint()


def test_lead_metrics_either_way(spark):
    """figures of wallets from blocks of pairs are those from a row for each pair."""
    firsts = some_firsts(spark)
    seeds = firsts.select("wallet").distinct().where("wallet <> 'w7'")
    for least in (1, 10):
        one, two = ({r.wallet: tuple(r)[1:] for r in N.lead_metrics(firsts, seeds, least, blocks).select("wallet", "n_pairs", "lead_power", "lead_delay", "overlap_power").collect()} for blocks in (True, False))
        assert one.keys() == two.keys() and one
        for w in one:
            assert one[w] == pytest.approx(two[w], abs=1.1e-6), w


def test_report_of_dense_wallets_moves_no_pairs(spark):
    """of 300 wallets that hold the same 40 tokens no pair is a row; blocks leave a row for each wallet."""
    x = spark.range(300 * 40).select((F.col("id") % 300).cast("string").alias("wallet"), F.floor(F.col("id") / 300).cast("string").alias("token"), F.col("id").alias("first_buy")).localCheckpoint()
    got = N.lead_metrics(x, x.select("wallet").distinct())
    assert "FlatMapGroupsInArrow" in plan(got) and "median_delta" not in plan(got)
    assert {r.n_pairs for r in got.collect()} == {299}


def test_edges_are_made_once(spark, sf_dir):
    """either end of an edge comes from one pass, and tasks are bounded by rows, so AQE does not put them together."""
    t = Tables(spark, sf_dir)
    for df in (J.degrees(t.edges, T.wallets(t)), J.neighbours(t.edges, T.wallets(t), 5, t.parts("lineitem")), J.neighbour_wallets(t.edges, T.wallets(t))):
        optimized = df._jdf.queryExecution().optimizedPlan().toString()
        # the two sides of the join of an order with itself, and the seeds
        assert optimized.count("Relation [") == 3 and "RepartitionByExpression" in optimized


def some_transfers(spark):
    rng = random.Random(8)
    x = [(f"n{rng.randrange(9)}", f"n{rng.randrange(9)}", rng.randrange(12) * 30_000) for _ in range(160)]
    return spark.createDataFrame([*x, *x[:20], (None, "n1", 3), ("n1", None, 3), ("n2", "n3", None)], "src string, dst string, bt long").localCheckpoint()


def test_routes_either_way(spark):
    """transfers that each task has whole give the same routes as those that meet in blocks."""
    t = some_transfers(spark)
    ends = t.select(F.col("src").alias("wallet")).where("src IS NOT NULL").distinct()
    for depth in (1, 2, 3):
        for path in (True, False):
            one, two = ({tuple(map(str, r)) for r in J.funding_routes(t, ends, ends.where("wallet < 'n6'"), depth, 5, most, path).collect()} for most in (None, 0))
            assert one == two and one


def test_steps_of_a_source_stay_in_its_task(spark):
    """transfers of the wallets reached are sent to the steps of the sources, so no way but the best leaves a task."""
    t = some_transfers(spark)
    ends = t.select(F.col("src").alias("wallet")).distinct()
    text = J.funding_paths(t, ends, ends)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text


def test_co_wallets_either_way(spark):
    """pairs that meet in blocks are those that an interval join finds, for times far apart as well."""
    rng = random.Random(4)
    x = [(f"w{rng.randrange(30)}", f"t{rng.randrange(4)}", rng.choice([rng.randrange(200), (1 << 61) + rng.randrange(9)])) for _ in range(400)]
    for rows in (x, [r for r in x if r[2] < 1000]):
        buys = spark.createDataFrame([*rows, (None, "t1", 3), ("w1", None, 3), ("w1", "t1", None)], "wallet string, token string, bt long").localCheckpoint()
        one, two = ({tuple(r) for r in J.co_wallets(buys, buys, 5, blocks).select("anchor", "wallet", "n_tokens", "n_pairs").collect()} for blocks in (True, False))
        assert one == two and len(one) > 100


def test_dense_co_wallets_move_no_pairs(spark):
    """400 wallets that buy one token at once meet inside tasks."""
    buys = spark.range(400 * 20).select((F.col("id") % 400).cast("string").alias("wallet"), F.lit("t").alias("token"), F.floor(F.col("id") / 400).alias("bt")).localCheckpoint()
    got = J.co_wallets(buys, buys, 30)
    assert "MapInArrow" in plan(got) and got.count() == 400 * 399


def test_nearest_pairs_no_rows(spark):
    """F16: the nearest row comes from its neighbours in time, by no join; ties, nulls and repeated rows as before."""
    rng = random.Random(6)
    left = [(rng.choice(["a", "b"]), rng.choice([rng.randrange(900), rng.randrange(40)]), i % 40) for i in range(300)] + [(None, 5, 1), ("a", None, 2), ("a", 7, 3), ("a", 7, 3), ("c", 7, 4)]
    right = [(rng.choice(["a", "b"]), rng.randrange(900), rng.randrange(50)) for _ in range(200)] + [(None, 5, 1), ("a", None, 2), ("a", 7, None), ("b", 9, 5), ("b", 9, 8), ("b", 9, 6)]
    a, b = spark.createDataFrame(left, "token string, bt long, n long"), spark.createDataFrame(right, "token string, mcap_time long, mcap long")
    want = []
    for k, t, n in left:
        some = [(-abs(t - u), u, v) for j, u, v in right if k and j == k and t is not None and u is not None and v is not None and abs(t - u) <= 4]
        want.append((k, t, n, *((max(some)[2], max(some)[1]) if some else (None, None))))
    for parts in (None, 3):
        got = J.nearest(a, b, 4, parts=parts)
        assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got.select("token", "bt", "n", "mcap", "mcap_time").collect())
        assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_steps_need_no_expansion(spark, sf_dir):
    """distinct wallets of a step come from rows of wallets, not from copies of all flows, and flows meet their wallets only."""
    t = Tables(spark, sf_dir)
    flows = t.flows
    x = R.step_features(flows, None)
    text = x._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in x._jdf.queryExecution().executedPlan().toString() and text.count("Relation [") <= 5
    some = R.step_features(flows, None, mads=False, density=False)
    assert not {"pause_mad", "size_mad", "density"} & set(some.columns)
    assert {tuple(r) for r in some.collect()} == {tuple(r) for r in x.select(*some.columns).collect()}
