"""Times the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line. $BENCH_RUNS: runs of each, the median counts."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

HEADLINE = ("characters_in_scene", "character_knowledge_at_time", "story_timeline_detailed", "temporal_knowledge_conflicts", "location_contradictions", "plot_holes", "validate_edges", "constraint_violations", "mood_lexical", "continuity_edges", "pagerank", "clustering", "betweenness", "current_owner", "evolution_delta", "episodes_last_n", "search_memory", "vector_topk", "token_bucket")


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "12g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    from narralake import catalog

    def timed(name: str) -> float:
        began = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    timed(HEADLINE[0])  # warm up
    times = {name: round(statistics.median(timed(name) for _ in range(runs)), 3) for name in HEADLINE}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0)}))


if __name__ == "__main__":
    main()
