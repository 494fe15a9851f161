"""The driver contract, and a cross-section of the registered queries against DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as contract
import check_queries

SAMPLED = (
    "cast_batch",
    "fill_forward_by_user",
    "fill_median",
    "one_hot",
    "type_recommendations",
    "export_csv",
    "recipe_log",
    "profile_of_days",
    "most_frequent_parts",
    "most_frequent_words",
    "default_algorithm",
    "training_guards",
    "one_hot_vectors",
    "tree_additivity",
    "column_hints",
    "transform_sqrt",
    "bin_column",
    "filled_profile",
    "histogram",
    "correlation_matrix",
    "scatter_sample",
    "box_outliers",
    "recipe_apply",
    "label_encode_names",
    "wide_category_codes",
    "hierarchical_clusters",
    "split_stratified",
    "roc_auc_by_user",
    "next_steps",
    "shared_importance",
    "dbscan_core_points",
    "cluster_profile",
    "top_contributions",
)


def test_contract(spark):
    queries, checks = contract.queries(), contract.oracle_sql()
    assert set(checks) <= set(queries) and len(queries) > 100
    assert len(contract.entry(spark).collect()) == 4


def near(a, b) -> bool:
    if isinstance(a, float) and isinstance(b, float):
        return a == pytest.approx(b, rel=1e-6, abs=2e-6)
    return a == b


@pytest.mark.parametrize("name", SAMPLED)
def test_query_equals_its_check(spark, folder, name):
    df = contract.queries()[name](spark, folder)
    got = check_queries.canonical(df.columns, [tuple(r) for r in df.collect()])
    cursor = check_queries.connect(folder).execute(contract.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    expected = check_queries.canonical(names, cursor.fetchall())
    assert len(got) == len(expected)
    assert all(near(x, y) for a, b in zip(got, expected) for x, y in zip(a, b))
