"""A sample of queries against their SQL on the smallest tables; python -m tests.oracle runs them all."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry

from .oracle import compare, connect

DIR = "/root/testdata/sf0.001"
SOME = "g15_instability g4_closure g8_cycles g21_score a1_edge_rollup b2_coupling b5_refactor d1_exact_clusters r1_violations r17_score_gate t2_spearman t10_nearest c1_naming_families stream_sessions".split()


@pytest.mark.parametrize("name", SOME)
def test_like_sql(spark, name):
    assert compare(spark, connect(DIR), name, DIR) == ""


def test_entry(spark):
    assert entry.entry(spark).columns == ["node", "ca", "ce", "instability"]


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
