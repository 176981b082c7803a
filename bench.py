"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the tables (default /root/testdata/sf0.1), BENCH_CPUS the
cores. Every query is run once to the end on a warm session, without caches
between queries; the fits share one written train and test table.
"""

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tracerisk.catalog.queries import matrix_l, queries
from tracerisk.operators import metrics, models, split

HEADLINE = [
    "clean_trace",
    "task_labels",
    "scheduling_delay",
    "execution_duration",
    "machine_failure_rate",
    "concurrency_density",
    "resource_overcommit",
    "priority_gap",
    "feature_matrix",
    "delay_by_label",
    "describe_features_volume",
    "boxplot_duration",
    "feature_label_corr_volume",
    "stratified_split",
    "stratified_folds",
    "standard_scale",
    "roc_auc",
    "classification_metrics",
]

FITS = {
    "fit_logistic_regression": (models.train_logistic_regression, {}),
    "fit_random_forest_100x10": (models.train_random_forest, {}),
    "fit_boosted_trees_100x6": (models.train_boosted_trees, {}),
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tracerisk-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")

    seconds: dict[str, float] = {}

    def timed(name, job):
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)

    def drain(df):
        df.write.format("noop").mode("overwrite").save()

    named = queries()
    drain(named["label_distribution_events"](spark, folder))  # warm-up
    for name in HEADLINE:
        timed(name, lambda name=name: drain(named[name](spark, folder)))

    parts: list = []
    timed("prepare_data", lambda: parts.extend(split.prepare_data(matrix_l(spark, folder))))
    train, test = parts
    for name, (fit, settings) in FITS.items():

        def job(fit=fit, settings=settings, name=name):
            metrics.evaluate_model(name, models.predict(fit(train, **settings), test)).collect()

        timed(name, job)

    print(
        json.dumps(
            {
                "metric": "total time of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(folder).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
