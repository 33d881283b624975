"""Registered queries against their SQL on the smallest tables (all of them: tools/check.py)."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

from check import compare, connect  # noqa: E402

import __spark_entry__ as entry_points  # noqa: E402

SF = "/root/testdata/sf0.001"
# Queries over the scores of several classifiers share their parts with those kept here.
SLOW = {
    "auc_summary", "score_quantiles", "known_novel_counts", "consensus_vote", "consensus_sweep", "merged_scores",
    "score_correlations", "enrichment_curves", "mann_whitney_pairs", "simpson_area_above", "union_distinct", "set_sizes",
    "intersection_values", "pu_votes", "pu_scores_nb", "median_scores", "score_histogram", "predicted_entities",
    "iteration_correlations", "best_enrichment", "mean_roc", "enrichment_restricted", "rank_positions", "top_fraction",
}


def test_every_oracle_has_a_query():
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_entry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["entity_id", "label", "mean_score", "percentile", "positive_votes", "negative_votes"]
    assert df.count() == 200


@pytest.mark.parametrize("name", sorted(set(entry_points.oracle_sql()) - SLOW))
def test_query(spark, name):
    got = entry_points.queries()[name](spark, SF).toPandas()
    why = compare(got, connect(SF).execute(entry_points.oracle_sql()[name]).df())
    assert why is None, why
