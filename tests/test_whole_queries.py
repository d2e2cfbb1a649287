"""Queries work on whole tables: no list of ids in their SQL, and no query is registered under two names."""

import pytest

from tests.compare import same
from tidewake.plans import ORACLES, QUERIES
from tidewake.sources.canonical import oracle

NAMES = ["join7_co_wallets", "join11_token_overlap", "join12_top_neighbours", "join13_degrees", "join14_shared_groups", "join18_funding_paths", "set1_seeds_and_neighbours", "top9_co_wallet_leaders", "fn24_seed_verification", "fn10_archetypes"]
HOLDS = oracle("SELECT wallet, median(hold) AS median_hold, count(*) FILTER (b > 0) AS n_entered FROM (SELECT wallet, token, max(bt) - min(bt) AS hold, count(*) FILTER (flow_direction = 'in') AS b FROM valid GROUP BY wallet, token) GROUP BY wallet", "valid")
LISTS = ("wallet::INT %", "src::INT %", "w::INT %", "WHERE line", "token::INT <", "token::INT % 4", "p_partkey <")


@pytest.mark.parametrize("name", NAMES)
def test_whole_tables(name):
    assert not any(x in ORACLES[name] for x in LISTS)
    assert name in QUERIES and f"{name}_all" not in QUERIES


def test_no_query_has_two_names():
    assert len(set(ORACLES.values())) == len(ORACLES)


def test_no_query_reads_a_list_of_ids():
    assert not [name for name, sql in ORACLES.items() if any(x in sql for x in LISTS)]


def test_seed_metrics_of_all_wallets(spark, duck, sf_dir):
    same(QUERIES["agg13_seed_metrics_all"](spark, sf_dir).select("wallet", "median_hold", "n_entered"), duck.sql(HOLDS))


def test_report_of_all_wallets(spark, duck, sf_dir):
    same(QUERIES["fn17_seed_verdicts"](spark, sf_dir).select("wallet"), duck.sql(oracle("SELECT DISTINCT wallet FROM valid", "valid")))
