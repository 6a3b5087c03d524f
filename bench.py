"""Headline queries over $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line. Each query runs once to warm up and then counts its best of two."""

from __future__ import annotations

import json
import os
import sys
import time

HERE = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, HERE)
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH")]))

from cairnflow.catalog import QUERIES  # noqa: E402
from cairnflow.session import session  # noqa: E402

HEADLINE = (
    "V4_rrf_hybrid", "V2_vector_top_k", "V3_lexical_rank", "V12_filter_with_top_up", "V16_semantic_cache", "F1_retrieve_flow", "F2_ingest_flow",
    "C1_line_windows", "C13_content_diff", "N3_repeated_ngrams", "N7_readability", "H2_scrub", "E4_kb_quality", "G4_components", "K1_upsert",
    "J1_inner_join", "A1_group_aggregates", "W3_top_per_group", "W7_interval_union", "X5_alarm_cooldown",
)


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session("bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(3):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(min(times[1:]), 3)
    spark.stop()
    print(json.dumps({"metric": "total seconds of headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
