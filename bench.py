"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tickerloom import catalog  # noqa: E402
from tickerloom.plans import views  # noqa: E402
from tickerloom.session import make_session  # noqa: E402

HEADLINE = [
    "ticker_feature_summary", "baseline_features", "rolling_features", "lag_features", "volatility_levels",
    "describe_bars", "correlation_matrix", "daily_sentiment", "bars_with_sentiment", "join_on_date", "offset_join",
    "asof_prev_news", "asof_prev_embedding", "daily_rollup", "dedupe_articles", "clean_html", "dedupe_sentences",
    "normalise_text", "word_frequency_no_stop", "mean_vector", "cosine", "row_index", "ts_folds", "stratified_split",
    "undersample", "scale_all", "confusion", "roc_auc", "event_auc", "fold_report", "histogram", "event_box_stats",
    "acf", "granger_tests", "adf_tests", "garch_fit", "smote_neighbours", "prompt_text", "parse_answer",
    "fold_volatility_by_year", "logistic_folds",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = make_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false",
        "spark.log.level": "ERROR", "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tickerloom-bench-"), "spark.ui.showConsoleProgress": "false"})
    queries, _ = catalog.load()
    # Read the input once, so that the first query does not pay for starting up.
    views.bars(spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "total seconds of headline queries", "value": total, "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
