"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.operators import recurrence, timeframe  # noqa: E402
from barloom.plans import panel  # noqa: E402
from barloom.session import local_session  # noqa: E402
from checks import catalog, market  # noqa: E402
from checks import features, tables  # noqa: E402, F401

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = local_session(CPUS)
    registered = [
        "flagship",
        "bars_from_ticks",
        "moving_averages_suppliers",
        "return_statistics_suppliers",
        "weekly_features_suppliers",
        "exponential_averages_suppliers",
        "candlesticks",
        "context_features",
        "chronological_split",
        "walk_forward_folds",
        "scaled_robust",
        "classification_metrics",
        "roc_auc_by_fold",
    ]
    jobs = {name: catalog.spark_rows(name) for name in registered}

    def group(*names):
        return lambda s, d: panel.with_features(market.supplier_bars(s, d), names)

    cat = panel.CATALOG
    jobs |= {
        "window_features": group(*cat.group("returns", "moving_average", "oscillator", "channel", "volume", "volatility", "statistics")),
        "recurrences": lambda s, d: recurrence.with_recurrences(market.supplier_bars(s, d), recurrence.SMOOTHED),
        "hurst": lambda s, d: recurrence.with_recurrences(market.supplier_bars(s, d), list(recurrence.HURST)),
        "timeframes": lambda s, d: timeframe.with_timeframes(market.supplier_bars(s, d)),
        "full_panel": lambda s, d: panel.feature_panel(market.supplier_bars(s, d), market.context_bars(s, d)),
    }
    seconds = {}
    run(market.supplier_bars(spark, SF_DIR))  # start workers and load classes before timing
    for name, job in jobs.items():
        start = time.time()
        run(job(spark, SF_DIR))
        seconds[name] = round(time.time() - start, 3)
    total = round(sum(seconds.values()), 3)
    print(
        json.dumps(
            {"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "sf": os.path.basename(SF_DIR.rstrip("/"))}
        )
    )


if __name__ == "__main__":
    main()

