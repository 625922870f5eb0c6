"""Times the headline queries of the text pipeline; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["html_normalize", "text_blocks", "tag_simplify", "chunk_anchor", "chunk_direct", "prompt_render", "translate_identity", "validate_format", "parse_response", "restore_line", "render_replace_identity", "render_bilingual", "paragraph_blocks", "render_direct", "keyword_search", "latest_result"]


def main() -> None:
    from pyspark.sql import SparkSession

    from tessera.queries import QUERIES

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.sql.files.maxPartitionBytes", "4m").config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "false").getOrCreate()  # a shuffle has a partition per core
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["text_blocks"](spark, sf).count()  # starts the executor threads and compiles what all queries share
    took = {}
    for name in HEADLINE:
        began = time.time()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
