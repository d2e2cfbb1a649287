"""Shared groups by classes of seeds, and percentiles from ordered partitions, against brute force."""

import random

import numpy as np

from tidewake.operators import aggregates as A
from tidewake.operators import joins as J


def test_shared_groups_by_classes(spark):
    rng = random.Random(2)
    rows = [(f"w{rng.randrange(30)}", rng.choice([None, *range(6)])) for _ in range(45)]
    seeds = [f"w{i}" for i in range(0, 34, 2)]
    by = {}
    for w, g in rows:
        if w in seeds and g is not None:
            by.setdefault(w, set()).add(g)
    want = {s: sum(bool(by[s] & by[o]) for o in by if o != s) if s in by else 0 for s in seeds}
    got = J.shared_groups(spark.createDataFrame(rows, "wallet string, group_id long"), spark.createDataFrame([(s,) for s in seeds], "wallet string"))
    assert {r.wallet: r.n_shared for r in got.collect()} == want


def test_a_large_group_is_one_class(spark):
    """200,000 seeds of one group: 40,000,000,000 pairs, one class."""
    seeds = spark.range(200_000).selectExpr("cast(id as string) AS wallet")
    assert [tuple(r) for r in J.shared_groups(seeds.selectExpr("wallet", "7L AS group_id"), seeds).groupBy("n_shared").count().collect()] == [(199_999, 200_000)]


def test_percentiles_from_ordered_partitions(spark):
    rng = random.Random(4)
    rows = [(rng.choice([0.0, rng.gauss(0, 1e6), -1e-9]), rng.choice([None, float(rng.randrange(5))]), None) for _ in range(701)]
    x = spark.createDataFrame(rows, "u double, v double, none double")
    ps = (1, 25, 50, 99)
    got = A.linear_percentiles(x, {"u": ps, "v": ps, "none": (50,)}).first()
    for c, values in (("u", [r[0] for r in rows]), ("v", [r[1] for r in rows if r[1] is not None])):
        assert np.allclose([got[f"{c}_{p}"] for p in ps], np.percentile(values, ps), rtol=1e-12, atol=0)
    assert got["none_50"] is None and A.linear_percentiles(x.limit(0), {"u": ps}).first()["u_50"] is None
