"""Pairs of keys in blocks against brute force: block pairs, chunks of keys, ties, unknown values, names of any order; dense sets are not joined by item."""

import math
import random
import statistics

from pyspark.sql import functions as F

from tidewake.operators import joins as J
from tidewake.operators import pair_blocks as B


def naive(sets, least):
    by = {}
    for w, t, x in sets:
        by.setdefault(w, {})[t] = x
    out = {}
    for a in by:
        for b in by:
            common = by[a].keys() & by[b].keys()
            if a < b and len(common) >= max(least, 1):
                d = sorted(by[b][t] - by[a][t] for t in common if by[a][t] is not None and by[b][t] is not None)
                figures = (statistics.median(d), float(d[math.ceil(0.9 * len(d)) - 1])) if d else (None, None)
                out[a, b] = (len(by[a]), len(by[b]), len(common), sum(x > 0 for x in d) / len(common), *figures)
    return out


def test_blocks_against_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(f"w{w}", f"t{t}", None if rng.random() < 0.1 else rng.choice([rng.randrange(9), rng.randrange(1 << 40)])) for w in range(40) for t in rng.sample(range(30), rng.choice([1, 3, 25]))]
    x = spark.createDataFrame([*rows, (None, "t1", 3), ("w1", None, 3)], "wallet string, token string, first_buy long").localCheckpoint()
    for held in (1, 90, 2_000_000):
        monkeypatch.setattr(B, "HELD", held)
        for blocks, least in ((1, 1), (3, 4), (7, 1)):
            got = {(r.a, r.b): tuple(r)[2:] for r in B.pairs_in_blocks(x, "wallet", "token", "first_buy", least, blocks).collect()}
            assert got == naive(rows, least), (held, blocks, least)
    table_rows = list(B._pairs(True, 1)(iter([])))
    assert table_rows == [] and B.pairs_in_blocks(x.limit(0), "wallet", "token").count() == 0


def test_either_way_gives_the_same(spark):
    rng = random.Random(9)
    x = spark.createDataFrame([(w, t, rng.randrange(50)) for w in range(60) for t in rng.sample(range(20), 12)], "wallet long, token long, first_buy long").localCheckpoint()
    for least in (1, 6):
        one, two = ({tuple(r) for r in J.pair_stats(x, least_shared=least, blocks=b).collect()} for b in (True, False))
        assert one == two and one
        one, two = ({tuple(r) for r in J.sharing_pairs(x, least, prefix=False, blocks=b).collect()} for b in (True, False))
        assert one == two and one
    one, two = ({tuple(r) for r in J.overlap_join(x, 0.6, prefix=False, blocks=b).collect()} for b in (True, False))
    assert one == two and one


def test_dense_sets_are_not_joined_by_item(spark):
    """400 wallets that all hold 40 tokens: the 3,192,000 rows of equal tokens are formed inside tasks, none is moved."""
    x = spark.range(400 * 40).select((F.col("id") % 400).cast("string").alias("wallet"), F.floor(F.col("id") / 400).cast("string").alias("token"), F.col("id").alias("first_buy"))
    for df in (J.pair_stats(x), J.sharing_pairs(x, 1), J.overlap_join(x, 0.85)):
        assert "MapInArrow" in df._jdf.queryExecution().toString() and df.count() == 400 * 399 // 2
