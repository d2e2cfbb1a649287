"""seed metrics come from one pass over the trades, in tasks of a bounded number of rows."""

import math
import random
import statistics
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewake.plans import QUERIES
from tidewake.plans import network as N

COLUMNS = ("wallet", "median_hold", "median_buys", "partial_exit_rate", "n_entered", "attempts_median", "attempts_p90", "per_hour")


def some_trades():
    rng = random.Random(12)
    x = [(f"w{rng.randrange(9)}", f"t{rng.randrange(7)}", rng.choice([rng.randrange(400), rng.randrange(90_000)]), rng.choice(["in", "in", "out", None])) for _ in range(900)]
    x += [("hot", "t1", i * 60, "in") for i in range(300)] + [("hot", None, 7, "out"), ("hot", None, 7, "out"), (None, "t1", 3, "in"), ("one", "t1", 5, "out"), ("late", "t1", None, "in"), ("late", "t1", None, "in"), ("late", "t2", 9, "in")]
    return [(*r, i, 1) for i, r in enumerate(x)]


def runs(times):
    """Lengths of runs without a pause of more than 90; a row without a time is one by itself."""
    found = [1] * times.count(None)
    last = None
    for t in sorted(t for t in times if t is not None):
        if last is None or t - last > 90:
            found.append(0)
        found[-1] += 1
        last = t
    return found


def median(x):
    return float(statistics.median(x)) if x else None


def span(times):
    known = [t for t in times if t is not None]
    return max(known) - min(known) if known else None


def loop(trades):
    own = defaultdict(list)
    for wallet, token, bt, side, *_ in trades:
        if wallet is not None:
            own[wallet].append((token, bt, side))
    for wallet, rows in own.items():
        tokens, sides = defaultdict(list), defaultdict(list)
        for token, bt, side in rows:
            tokens[token].append((bt, side))
            sides[token, side].append(bt)
        holds = [span([bt for bt, _ in r]) for r in tokens.values()]
        count = lambda side: [sum(s == side for _, s in r) for r in tokens.values()]  # noqa: B023, E731
        buys, sells = [b for b in count("in") if b], [s for s in count("out") if s]
        lengths = sorted(n for times in sides.values() for n in runs(times))
        hours = max(span([bt for _, bt, _ in rows]) or 0, 1) / 3600
        yield wallet, median([h for h in holds if h is not None]), median(buys), sum(s >= 2 for s in sells) / max(len(sells), 1), len(buys), median(lengths), float(lengths[math.ceil(0.9 * len(lengths)) - 1]), len(buys) / hours


@pytest.mark.parametrize("parts", [None, 3])
def test_metrics_against_a_loop(spark, parts):
    trades = some_trades()
    df = spark.createDataFrame(trades, "wallet string, token string, bt long, flow_direction string, seq long, lamports long")
    got = N.seed_metrics(df, parts)
    assert tuple(got.columns) == COLUMNS
    want = {r[0]: r[1:] for r in loop(trades)}
    found = {r.wallet: tuple(r)[1:] for r in got.collect()}
    assert found.keys() == want.keys() and {"hot", "one", "late"} < want.keys()
    for w, r in found.items():
        assert r == pytest.approx(want[w]), w


def test_one_pass_in_bounded_tasks(spark, sf_dir):
    """The trades are read once, nothing is joined, and AQE does not put the tasks together."""
    got = QUERIES["agg13_seed_metrics_all"](spark, sf_dir)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") == 1 and "Join" not in text and text.count("RepartitionByExpression") == 2
    assert got.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_many_trades_of_a_wallet_leave_few_rows(spark):
    """What goes to a wallet is a row for each token and length of episodes, not its trades."""
    x = spark.range(30_000).select(F.lit("w").alias("wallet"), (F.col("id") % 3).cast("string").alias("token"), (F.col("id") * 50).alias("bt"), F.lit("in").alias("flow_direction"), F.col("id").alias("seq"), F.lit(1).alias("lamports"))
    assert [tuple(r) for r in N.episode_lengths(x).select("wallet", "n_flows", "_c", "b", "s").collect()] == [("w", 1, 10_000, 10_000, 0)] * 3
    assert [tuple(r)[1:-1] for r in N.seed_metrics(x, 5).collect()] == [(29_997 * 50.0, 10_000.0, 0.0, 3, 1.0, 1.0)]


@pytest.mark.parametrize("name", ["win11_episodes", "agg13_seed_metrics"])
def test_episodes_in_bounded_tasks(spark, sf_dir, name):
    """The step that they share with the metrics of all wallets is dealt by a number of rows as well."""
    text = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [wallet#" in text and "direction#" in text.split("RepartitionByExpression")[1].split("]")[0]
