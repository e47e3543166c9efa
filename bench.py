"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local cores,
BENCH_REPEATS the timed runs after one warm-up (the median counts; a query whose warm-up
took longer than BENCH_LONG seconds is timed once).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)

HEADLINE = [
    "column_profile_lineitem", "column_profile_documents", "numeric_summary_lineitem", "distinct_counts",
    "duplicate_rows_lineitem", "top_texts", "health_issues_messy_lineitem", "outlier_issues", "pearson_pairs",
    "spearman_pairs", "group_spread", "ranked_findings", "welch_t_tests", "anova_tests", "chi_square_tests",
    "feature_suggestions_messy_lineitem", "standard_scale", "clip_outliers_percentiles", "bin_numeric_quartiles",
    "one_hot_encode", "ordinal_encode", "frequency_encode", "group_rare_labels", "active_sessions", "completed_analyses",
    "analyses_to_run", "stratified_fold_sizes", "class_scores", "ranking_scores", "shuffled_column",
]
# models are fitted here: timed after the headline is printed, where BENCH_MODELS is set, on standard error
MODELLING = ["cross_validated_regression", "permutation_importance", "shapley_adds_up"]


def main() -> None:
    from checks import REGISTRY
    from tablewright.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    long = float(os.environ.get("BENCH_LONG", "8"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
           # the tables are small files: let every core read a part
           "spark.sql.files.openCostInBytes": "524288"},
    )
    spark.sparkContext.setLogLevel("ERROR")

    def run(name: str) -> float:
        started = time.perf_counter()
        REGISTRY[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - started

    seconds = {}
    for name in HEADLINE:
        first = run(name)
        again = 1 if first > long else repeats
        seconds[name] = round(statistics.median(run(name) for _ in range(again)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        ),
        flush=True,
    )
    if os.environ.get("BENCH_MODELS"):
        for name in MODELLING:
            print(json.dumps({name: round(run(name), 3)}), file=sys.stderr, flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
