"""Times the headline queries; prints one JSON line.

Besides the registered queries it times each baseline at the published panel
size: the 100 most traded firms by day, lookback 1008, refit every 20 days, on
the days the given tables cover.
"""

from __future__ import annotations

import json
import os
import time

from firmament.operators import windows as Wn
from firmament.plans import comparison as C
from firmament.plans import derive as D
from firmament.plans import walkforward as WF
from firmament.plans.catalog import QUERIES
from firmament.session import get_session, materialize, ship_package

HEADLINE = [
    "panel_weekly", "wide_unpivot", "excess_returns", "ar_walkforward", "ar_all_firms", "baseline_table",
    "graph_snapshot_edges", "clustering_coefficient", "connected_components", "graph_structure", "corr_graph_topk",
    "layer_ttest", "graph_comparison", "graph_vs_ar_layer", "article_table", "classify", "edges_rules",
    "resolve_edges", "score_extraction",
]


def daily(spark, sf_dir):
    """The published configuration on a daily panel."""
    m = D.market(spark, sf_dir, grain="day", n=100)
    return m, materialize(Wn.firm_series(m.excess), "daily-series")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    QUERIES["sector_coalesce"](spark, sf_dir).count()  # start the JVM paths before the clock
    times: dict[str, float] = {}

    def clock(name, run):
        start = time.perf_counter()
        run().write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)

    for name in HEADLINE:
        clock(name, lambda: QUERIES[name](spark, sf_dir))
    m, series = daily(spark, sf_dir)
    clock("daily100_AR_sql", lambda: WF.ar_walk_forward(series, Wn.LOOKBACK, Wn.REFIT_EVERY))
    for spec in WF.BASELINES:
        clock(f"daily100_{spec.label}", lambda: C.run(series, [spec], m.calendar, m.universe))
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
