"""Registered queries against their checking SQL on the smallest tables.

A spread of queries runs by default; ALL_QUERIES=1 runs every one (also: python tests/oracle.py).
"""

import os

import oracle
import pytest
from tickerloom.catalog import load

FOLDER = "/root/testdata/sf0.001"
SAMPLE = (
    "src_bars_valid", "src_local_time", "src_news_json", "src_quote_lines", "sink_bars_upsert", "sink_merge_cache", "t_bars_asof",
    "t_replay_split", "t_selection_gates", "j_asof_latest", "j_nth_after", "j_status_asof", "j_cooldown_anti", "j_fuzzy_keyword",
    "a_contributions", "a_event_noisy_or", "a_total_score", "a_cooccurrence_edges", "a_penalty_smooth", "a_profit_summary",
    "a_outcome_contract", "w_market_score", "w_walk_forward", "w_supersede", "w_session_age", "k_capped_topk", "k_surge_topk",
    "f_cosine", "f_lcs_length", "f_near_dup_groups", "k_diverse_topk", "f_rule_signals", "d_yield_records", "d_bootstrap_ci", "g_expand", "st_bucket_counts",
)
QUERIES, SQL = load()
NAMES = sorted(SQL) if os.environ.get("ALL_QUERIES") else SAMPLE


@pytest.fixture(scope="module")
def con():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, con, name):
    problem, _, _, _ = oracle.compare(spark, con, name, QUERIES[name], SQL[name], FOLDER)
    assert problem is None


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)
