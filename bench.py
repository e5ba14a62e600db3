"""Times the headline queries and prints one JSON line.

`BENCH_SF_DIR` is the table directory, `BENCH_CPUS` the number of cores, `BENCH_QUERIES` a list of names.
Every query runs over whole tables; the time is that of computing all of its rows, the best of two runs.
"""

from __future__ import annotations

import json
import os
import time

from lodestone.queries import QUERIES
from lodestone.session import build_session

HEADLINE = (
    "knn_centroid_topk knn_cosine_topk knn_l2_topk knn_cells_exact vector_health_by_label search_hits "
    "column_profile_orders sql_filter_topk sql_group_max sql_self_join sql_semi_anti sql_window sql_grouping "
    "tagged_union_parts load_reconcile resume_remaining envelope_roundtrip attributes_by_feature mapping_features "
    "no_data_filter line_clean sentence_cut ensure_mention fence_clean feature_names prompt_table verdict_filter "
    "candidate_bindings coord_points coord_bbox attempt_history verdict_resolution usage_rollup usage_periods "
    "retrieved_block progress_latest progress_feed progress_stream usage_stream answer_questions catalog_build"
).split()


def run(spark, name: str, directory: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, directory).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {name: round(min(run(spark, name, directory) for _ in range(2)), 3) for name in names}
    sf = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
