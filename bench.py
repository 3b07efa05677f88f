"""Time the headline queries: one JSON line. `BENCH_SF_DIR` and `BENCH_CPUS` choose tables and cores."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

os.environ.setdefault("PYSPARK_SUBMIT_ARGS", "--driver-memory 16g pyspark-shell")

from tidemark.plans.catalog import QUERIES
from tidemark.session import build_session

HEADLINE = [
    "state_durations", "hysteresis", "classify_phase_window", "viterbi_smooth", "phase_timeline", "silence_cut_list", "keep_list", "overlap_join", "chapter_asof_join",
    "latest_cached_result", "upsert_rows", "tumbling_windows", "term_counts", "distinctive_terms", "hash_embedding", "semantic_windows", "topic_boundaries",
    "region_match_join", "track_linking", "diversify_topk", "stream_windows", "composition_plan", "topic_candidates_end_to_end",
]


#: Tables that are staged as several files, as a cluster has them; here each is one row group, which is one task.
SPLIT = {"documents": 16}


def staged(spark, folder: str) -> str:
    """The tables in a folder of their own, outside the timings."""
    out = tempfile.mkdtemp(prefix="tidemark-bench-")
    for name in os.listdir(folder):
        table = name.removesuffix(".parquet")
        if table in SPLIT:
            spark.read.parquet(f"{folder}/{name}").repartition(SPLIT[table]).write.parquet(f"{out}/{name}")
        else:
            os.symlink(f"{folder}/{name}", f"{out}/{name}")
    return out


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    spark.sparkContext.setLogLevel("ERROR")
    names, given = sys.argv[1:] or HEADLINE, folder
    folder = staged(spark, folder)
    spark.read.parquet(f"{folder}/events.parquet").count()  # start the engine outside the timings
    seconds = {}
    for name in names:
        begin = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - begin, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(given.rstrip("/"))}))


if __name__ == "__main__":
    main()
