"""Prints one JSON line with the seconds of each headline query over $BENCH_SF_DIR on local[$BENCH_CPUS]."""

import json
import os
import time

from pyspark.sql import SparkSession

from veinstone.plans import registry

HEADLINE = ["dense_batch_topk", "quantize_int8", "identifier_tokens", "postings_build", "lexical_score", "hybrid_search", "source_spans", "eval_top1_mrr"]


def main() -> None:
    cpus, sf = os.environ.get("BENCH_CPUS", "8"), os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registry.Q["dense_batch_topk"](spark, sf).write.format("noop").mode("overwrite").save()  # compiles
    took = {}
    for name in HEADLINE:
        began = time.time()
        registry.Q[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()
