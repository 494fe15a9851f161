"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder and BENCH_CPUS the number of local cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gristmill.plans.registry import ALL_QUERIES  # noqa: E402
from gristmill.session import local_session  # noqa: E402

HEADLINES = (
    "filled_profile",
    "profile_all",
    "profile_lineitem",
    "cast_batch",
    "filter_equals",
    "sort_topn",
    "table_page_deep",
    "fill_mean",
    "fill_median",
    "fill_forward",
    "fill_mode",
    "one_hot",
    "type_recommendations",
    "column_hints",
    "combine_divide",
    "transform_standardize",
    "bin_column",
    "histogram_lineitem",
    "value_counts_top15",
    "correlation_lineitem",
    "scatter_sample",
    "box_plot",
    "box_outliers",
    "recipe_apply",
    "label_encode",
    "split_holdout",
    "split_stratified",
    "classification_metrics",
    "confusion_matrix",
    "regression_metrics",
    "regression_metrics_by_supplier",
    "roc_auc",
    "roc_curve",
    "residual_sample",
    "next_steps",
    "shared_importance",
    "kmeans_assign",
    "silhouette",
    "cluster_profile",
    "linear_attribution",
    "linreg_1d",
    "train_rf_reg",
    "train_logreg",
    "train_gbt_class",
    "dbscan_labels",
    "hierarchical_clusters",
    "quantiles_by_nullable_group",
    "load_csv_late_types",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    names = [n for n in (sys.argv[1:] or HEADLINES)]
    # One untimed query loads the classes and starts the code generator.
    _run(spark, folder, "filled_profile")
    times = {name: round(_run(spark, folder, name), 3) for name in names}
    print(
        json.dumps(
            {
                "metric": "headline queries, total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")),
            }
        ),
        flush=True,
    )
    spark.stop()


def _run(spark, folder: str, name: str) -> float:
    """Run a query to its last row without bringing rows to the driver."""
    started = time.perf_counter()
    ALL_QUERIES[name][0](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - started


if __name__ == "__main__":
    main()
