"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

ROOT = os.path.dirname(os.path.abspath(__file__))
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = ROOT + os.pathsep + os.environ.get("PYTHONPATH", "")

HEADLINE = (
    "d1_top_industries", "d2_top_technologies", "d3_keyword_months", "d4_compare", "d5_compare_points", "d6_monthly_visitors", "d12_neighbourhood", "d15_jaccard", "d16_tfidf",
    "c7_word_mentions", "c8_co_mentions", "c15_alias_rewrite", "b12_noise", "d22_threshold_sweep", "d25_places", "h8_sentiment", "i2_techs", "i11_extract",
    "a2_posts_after_repair", "a16_articles", "k1_vector_search", "e6_top_members", "k14_near_clusters", "k2_rerank", "k4_context", "j1_explore", "j6_degree", "j7_components", "l7_daily_keywords",
)


def main() -> None:
    from pyspark.sql import SparkSession

    from tidemark.plans import registry

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    conf = {"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.sql.session.timeZone": "UTC", "spark.log.level": "ERROR"}
    spark = SparkSession.builder.master(f"local[{cpus}]").config(map=conf).getOrCreate()
    queries, took = registry.queries(), {}
    queries["d4_compare"](spark, sf).collect()  # starts the workers and the compiler
    for name in HEADLINE:
        began = time.perf_counter()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - began, 3)
    documents = spark.read.parquet(f"{sf}/documents.parquet").count()
    rate = round(documents / took["i11_extract"] * 60)
    print(json.dumps({"metric": "headline_queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"), "articles_per_min": rate}), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
