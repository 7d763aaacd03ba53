"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

NAMES = ["node_merge", "edge_merge", "related_nodes", "core_edges", "threshold_sweep", "adjacent_sentences", "sense_stats", "dataset_stats", "wide_long_round_trip", "concept_edges", "partial_match", "token_stats", "vocabulary", "merged_words", "degree_filter"]


def main() -> None:
    at, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from evkg.plans import catalog

    try:  # the corpus operators may be taken away
        from evkg.llm.queries import QUERIES as corpus
    except ModuleNotFoundError:
        corpus = {}
    took, once = {}, {}
    for name, call in {**{n: catalog.QUERIES[n] for n in NAMES}, **corpus}.items():
        run = lambda: call(spark, at).write.format("noop").mode("overwrite").save()  # noqa: B023, E731
        if name not in corpus:
            run()  # the headline queries are timed warm, the corpus operators in their only run
        begun = time.perf_counter()
        run()
        (once if name in corpus else took)[name] = round(time.perf_counter() - begun, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "corpus_queries": once, "sf": os.path.basename(at.rstrip("/"))}))


if __name__ == "__main__":
    main()
