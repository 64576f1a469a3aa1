"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

HEADLINE = ("scan_bars_from_ticks", "session_levels", "rolling_vwap", "rolling_poc", "value_area", "prev30m_vwap", "confluence_zones", "trigger_touch", "simulate_fixed_bracket", "grid_search", "walk_forward", "trade_summary", "bootstrap_ci", "mc_reshuffle", "pbo_cscv")


def main() -> None:
    root = os.path.dirname(os.path.abspath(__file__))
    sys.path.insert(0, root)
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from tapewright.session import get_session

    spark = get_session("bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    from tapewright import catalog

    queries = {}
    catalog.QUERIES["scan_bars_from_ticks"](spark, sf).write.format("noop").mode("overwrite").save()  # warm-up
    for name in HEADLINE:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        queries[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(queries.values()), 3), "unit": "sec", "queries": queries, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
