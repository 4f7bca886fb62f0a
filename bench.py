"""Seconds of the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is planned and run to a sink that reads every row; the figure is the median of three
warm runs. Planning alone (request to DataFrame, nothing run) is in `planning_ms`.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path
from statistics import median

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
MONTH = [{"dimension": "orders.ordered_at", "granularity": "month"}]
#: The eight shapes of the reference's workload over the test tables, then other operators.
HEADLINE = {
    "simple_count": {"measures": ["orders.count"]},
    "1dim_1measure": {"measures": ["orders.revenue"], "dimensions": ["orders.status"]},
    "3measures_2dims": {"measures": ["orders.count", "orders.revenue", "orders.average_total"], "dimensions": ["orders.status", "orders.order_priority"]},
    "filtered": {
        "measures": ["orders.revenue", "orders.customers"], "dimensions": ["orders.order_priority"],
        "filters": [{"member": "orders.status", "operator": "equals", "values": ["F"]}, {"member": "orders.total", "operator": "gte", "values": ["100000"]}],
    },
    "time_dimension": {"measures": ["orders.revenue"], "time_dimensions": MONTH},
    "2_table_join": {"measures": ["orders.revenue"], "dimensions": ["customer.segment", "customer.nation_id"]},
    "3_table_join": {"measures": ["lineitem.revenue", "lineitem.quantity"], "dimensions": ["orders.status", "part.brand"]},
}
NAMED = ("full_pipeline", "fanout_one_view", "fanout_two_measure_views", "join_through_hint", "subquery_dimension", "motif_trend", "rolling_trailing", "topk")


def main() -> None:
    from quillon import queries

    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    asked = HEADLINE | {n: queries.QUERIES[n][0] for n in NAMED}
    engine = queries.engine(spark, SF_DIR)
    seconds, planning = {}, {}
    for name, request in asked.items():
        runs, plans = [], []
        for _ in range(4):
            start = time.perf_counter()
            df = engine.query(request)
            plans.append(time.perf_counter() - start)
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name], planning[name] = round(median(runs[1:]), 4), round(1000 * median(plans[1:]), 1)
    sf = Path(SF_DIR).name.removeprefix("sf")
    total = round(sum(seconds.values()), 4)
    print(json.dumps({"metric": "headline queries, sum of warm medians", "value": total, "unit": "sec", "queries": seconds, "planning_ms": planning, "sf": sf, "cpus": int(CPUS)}))


if __name__ == "__main__":
    main()
