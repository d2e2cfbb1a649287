"""Pairs of keys from tables of keys by items and from the items that they share; what moves to the blocks; prefixes that are not taken."""

import random

import pytest
from pyspark.sql import functions as F

from tests.test_pair_blocks import naive
from tidewake.operators import joins as J
from tidewake.operators import pair_blocks as B
from tidewake.plans.record_queries import in_order


@pytest.fixture(scope="module")
def firsts(spark):
    rng = random.Random(8)
    rows = [(f"w{w}", f"t{t}", None if rng.random() < 0.1 else rng.choice([rng.randrange(9), 5 - rng.randrange(1000)])) for w in range(30) for t in rng.sample(range(70), rng.choice([1, 3, 60]))]
    x = spark.createDataFrame(rows, "wallet string, token string, first_buy long").localCheckpoint()
    return rows, {(value, blocks): B._dealt(x, "wallet", "token", value, blocks)[0].toArrow().to_batches() for value in (None, "first_buy") for blocks in (1, 3)}


@pytest.mark.parametrize("dense", [0, 1000])
@pytest.mark.parametrize("least", [1, 4])
def test_either_kind_against_brute_force(firsts, monkeypatch, dense, least):
    rows, dealt = firsts
    monkeypatch.setattr(B, "DENSE", dense)
    for held, tile, line in ((1, 1, 1), (90, 50, 300), (2_000_000, 100_000, 200_000)):
        for name, size in (("HELD", held), ("TILE", tile), ("SORTED", line)):
            monkeypatch.setattr(B, name, size)
        for (value, _), batches in dealt.items():
            # the tasks have no more to do with each other than the batches of one
            got = {}
            for batch in B._pairs(value is not None, least)(iter(batches)):
                got |= {tuple(r.values())[:2]: tuple(r.values())[2:] for r in batch.to_pylist()}
            want = naive(rows, least)
            assert got == (want if value else {k: v[:3] for k, v in want.items()}), (held, value)


def test_wide_values_and_shares(spark):
    rows = [("a", "x", 0), ("a", "y", 1 << 45), ("b", "x", 1 << 44), ("b", "y", 3), ("c", "x", -7)]
    x = spark.createDataFrame(rows, "wallet string, token string, first_buy long").localCheckpoint()
    assert {tuple(r)[:2]: tuple(r)[2:] for r in B.pairs_in_blocks(x, "wallet", "token", "first_buy").collect()} == naive(rows, 1)
    assert [tuple(r) for r in B.pairs_in_blocks(x, "wallet", "token", share=1.0).orderBy("a", "b").collect()] == [("a", "b", 2, 2, 2), ("a", "c", 2, 1, 1), ("b", "c", 2, 1, 1)]


def test_sets_move_as_bits(spark):
    """600 keys of 150 items: a key moved 150 pairs of numbers to each block before, now four words."""
    x = spark.range(600 * 150).select((F.col("id") % 600).alias("wallet"), F.floor(F.col("id") / 600).alias("token")).localCheckpoint()
    dealt = B._dealt(x, "wallet", "token", None, 2)[0].toArrow()
    assert dealt.num_rows == 1200 and dealt.nbytes < 200_000


def test_few_blocks_of_many_keys():
    """60,000 keys of 164 items went to 118 blocks, and 360,000 to 704."""
    assert B.n_blocks(60_000, 9_840_000) == 24 and B.n_blocks(360_000, 59_040_000) == 44 and B.n_blocks(1_000, 164_000) == 2


def test_dense_sets_are_not_ranked(spark, monkeypatch):
    """Where any prefix forms too many pairs, none is taken."""
    monkeypatch.setattr(J, "_ranked", lambda *a: pytest.fail("ranked"))
    x = spark.range(400 * 100).select((F.col("id") % 400).alias("wallet"), F.floor(F.col("id") / 400).alias("token"), F.col("id").alias("first_buy")).localCheckpoint()
    assert not J.prefix_pays(x, 20) and J.pair_stats(x, least_shared=20).count() == 400 * 399 // 2


def test_reports_in_order_by_rows(spark):
    """A report of pairs is put in order in tasks of a bounded number of rows."""
    x = spark.range(1000).select((F.col("id") * 7 % 1000).alias("v")).localCheckpoint()
    y = in_order(x, "some", F.asc("v"), rows=50)
    assert [tuple(r) for r in y.orderBy("row_no").collect()] == [(i, i + 1) for i in range(1000)]
    parts = spark.read.parquet(y.inputFiles()[0].rsplit("/", 1)[0]).groupBy("_part").count().collect()
    assert len(parts) >= 15 and max(r["count"] for r in parts) <= 150


@pytest.mark.parametrize("wide", [1, 1 << 40])
def test_co_buys_in_parts(spark, monkeypatch, wide):
    rng = random.Random(3)
    rows = [(f"w{rng.randrange(12)}", f"t{rng.randrange(4)}", rng.choice([None, *[rng.randrange(-300, 300) * wide] * 9])) for _ in range(300)]
    x = spark.createDataFrame(rows, "wallet string, token string, bt long").localCheckpoint()
    within, want = 10 * wide, {}
    for w, t, at in rows:
        for v, u, other in rows:
            if w != v and t == u and at is not None and other is not None and abs(at - other) <= within:
                want.setdefault((w, v), []).append(t)
    want = {k: (len(set(v)), len(v)) for k, v in want.items()}
    if wide > 1:
        # times that don't fit a number beside the items
        monkeypatch.setattr(B, "_finder", lambda code, at, within, n, whole=B._finder: whole(code, at, within, 1 << 62))
    for blocks in (1, 3):
        batches = B._dealt(x, "wallet", "token", "bt", blocks)[0].toArrow().to_batches()
        for part, held in ((1, 1), (40, 7), (1_000_000, 2_000_000)):
            monkeypatch.setattr(B, "CO_PART", part)
            monkeypatch.setattr(B, "HELD", held)
            got = [tuple(r.values()) for b in B._co_pairs(within)(iter(batches)) for r in b.to_pylist()]
            assert len(got) == len(want) and {r[:2]: r[2:] for r in got} == want


def test_buys_move_as_small_numbers(spark):
    """80,000 buys in two blocks: 16 bytes a row and block before, and 41 blocks for 123,000,000 rows."""
    x = spark.range(80_000).select((F.col("id") % 200).alias("wallet"), (F.col("id") % 7).alias("token"), (1_700_000_000 + F.col("id") * 900).alias("bt")).localCheckpoint()
    assert B._dealt(x, "wallet", "token", "bt", 2)[0].toArrow().nbytes < 80_000 * 2 * 9
    assert B.co_blocks(123_000_000) == 16 and B.co_blocks(1000) == 8
