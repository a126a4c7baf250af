"""Times the headline queries: prints one line of JSON. Every query is run whole into a no-op sink, once to warm up and then once for the figure."""

import json
import os
import sys
import time


def main() -> None:
    from pyspark.sql import SparkSession

    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "16").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from rupaka.plans.catalogue import QUERIES

    names = sys.argv[1:] or ["tokenize_documents", "suffix_analysis", "suffix_class_counts", "lexicon_merge_conflicts", "bigram_smoothed", "context_prev_next", "compound_terms", "negation_scope", "eval_rollup", "ngram_features", "hindi_verb_analysis", "disambiguate_hindi"]
    times = {}
    for n in names:
        for _ in range(2):
            t = time.time()
            QUERIES[n](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[n] = round(time.time() - t, 3)
    print(json.dumps({"metric": "total warm seconds of the headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
