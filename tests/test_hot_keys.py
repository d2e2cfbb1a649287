"""Orders within a hot key, taken in chunks or bins, against plain loops."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tidewake.operators import aggregates as A
from tidewake.operators import evidence as V
from tidewake.operators import windows as W


def hot(spark, n=12_000):
    """One token with a third of all rows, ties of time, a token of one row and one without a name."""
    token = F.when(F.col("id") == 5, "one").when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 97 == 1, F.lit(None)).otherwise(F.concat(F.lit("t"), F.col("id") % 20))
    time = F.floor(F.col("id") / 4) * 50 + F.when(F.col("id") > n / 2, 300_000).otherwise(0)
    return spark.range(n).select(token.alias("token"), F.concat(F.lit("w"), F.col("id") * 31 % 700).alias("wallet"), time.cast("long").alias("bt"), F.col("id").alias("seq"))


@pytest.mark.parametrize("chunk", [60, 7000, 10**7])
def test_previous_rows_and_pauses(spark, chunk):
    x = hot(spark)
    own = defaultdict(list)
    for r in x.collect():
        own[r.token].append((r.bt, r.seq))
    before = {}
    for rows in own.values():
        rows.sort()
        before |= {s: rows[i - 1][0] if i else None for i, (_, s) in enumerate(rows)}
    assert {r.seq: r["_before"] for r in W.with_previous(x, ("token",), chunk).collect()} == before
    pauses = {t: max((b[0] - a[0] for a, b in zip(rows, rows[1:])), default=0) for t, rows in own.items()}
    assert {r.token: r.gap for r in W.longest_pauses(x).collect()} == pauses
    assert pauses["one"] == 0 and pauses["hot"] >= 300_000


@pytest.mark.parametrize("kind", ["long", "double"])
def test_gini_with_ties(spark, kind):
    value = F.when(F.col("seq") % 11 == 0, -5).when(F.col("seq") % 2 == 0, 7).otherwise(F.pow(F.lit(1.003), F.col("seq")) % 100_003)
    x = hot(spark).withColumn("balance", value.cast(kind))
    own = defaultdict(list)
    for r in x.collect():
        if r.balance > 0:
            own[r.token].append(r.balance)
    got = {r.token: (r.n, r.gini) for r in A.gini(x, ("token",)).collect()}
    assert set(got) == set(own)
    for t, b in own.items():
        b.sort()
        n = len(b)
        want = 2 * sum(i * v for i, v in enumerate(b, 1)) / (n * sum(b)) - (n + 1) / n
        assert got[t][0] == n and got[t][1] == pytest.approx(want, abs=2e-6)


def test_gini_of_nothing(spark):
    assert A.gini(spark.createDataFrame([("t", "w", 0), ("t", "v", -1), ("u", "w", None)], "token string, wallet string, balance long"), ("token",)).count() == 0


def test_share_of_the_busiest(spark):
    x = hot(spark).groupBy("token", "wallet").agg(F.count("*").alias("c"))
    own = defaultdict(list)
    for r in x.collect():
        own[r.token].append(r.c)
    want = {t: sum(sorted(c)[-10:]) / sum(c) for t, c in own.items()}
    assert {r.token: r.density for r in A.busiest_share(x).collect()} == pytest.approx(want)


def test_exhaustion_over_days(spark):
    """The largest tenth of earlier days counts, and shares that fall do not start anew."""
    shares = [(0, 2), (90_000, 6), (180_000, 5), (200_000, 6), (270_000, 7), (500_000, 10)]
    curve = spark.createDataFrame([("t", at, 10, s) for at, s in shares] + [("u", 0, 0, 0)], "token string, at long, n_seen long, n_silent long")
    assert [(r.at, r.share) for r in V.exhaustion_steps(curve).orderBy("at").collect()] == [(90_000, 0.6), (270_000, 0.7), (500_000, 1.0)]
