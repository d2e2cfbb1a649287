"""Seed metrics of every wallet over its trades, in full: those of agg13_seed_metrics are over flows."""

from __future__ import annotations

from tidewake.plans.network import seed_metrics
from tidewake.plans.registry import query


@query("agg13_seed_metrics_all")
def agg13(t):
    return seed_metrics(t.valid, t.parts("lineitem"))
