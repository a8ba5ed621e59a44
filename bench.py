"""Time the headline queries and print one JSON line.

Every query starts without staged tables, so its time holds all the work from the given
files to the last row. The first, untimed query only warms up the JVM.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from lapforge.plans import all_queries  # noqa: E402
from lapforge.session import build_session, forget_staged  # noqa: E402

HEADLINE = [
    "W09_race_feature_set",
    "W10_dedup_latest",
    "W02_lap_delta",
    "W08_lap_rank",
    "A02_driver_circuit_performance",
    "A03_driver_form_last5",
    "A04_tire_degradation",
    "A17_driver_statistics",
    "J01_longest_stint",
    "T04_race_replay",
    "M13_predict",
    "X01_html_cells_pages",
    "X13_extract_int",
]


def shuffle_bytes(spark) -> int:
    """Bytes written to shuffles so far in this application."""
    executors = spark.sparkContext._jsc.sc().statusStore().executorList(False)
    return sum(executors.apply(i).totalShuffleWrite() for i in range(executors.size()))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    seconds: dict[str, float] = {}
    moved: dict[str, int | None] = {}

    def run(name: str) -> float:
        forget_staged()
        begun = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - begun

    run("W09_race_feature_set")
    for name in HEADLINE:
        try:
            before = shuffle_bytes(spark)
        except Exception:  # noqa: BLE001
            before = None
        seconds[name] = round(run(name), 3)
        moved[name] = None if before is None else shuffle_bytes(spark) - before
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "shuffle_bytes": moved,
                "sf": Path(sf_dir).name.removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
