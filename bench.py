"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose
the data and the cores. Every query is planned and run to the end once after a
warm-up query; its whole result is produced.
"""

from __future__ import annotations

import json
import os
import time

from leadlake.catalog import registered
from leadlake.session import get_session

HEADLINES = (
    "search_page", "search_keyword", "stats_summary", "facets", "chain_facet", "map_clusters_district",
    "nearby", "radius_batch_join", "qualified_filter", "task_pack", "contact_pivot", "export_wide",
    "registry_load", "registry_contacts", "fill_blank_enrich", "chain_tag_merge", "upsert_sequence",
    "keep_best_row", "refresh_flags", "street_match", "centre_geocode", "score_parts", "lead_score",
    "profile_columns", "reach_matrix", "postings", "token_all", "timing_percentiles", "stream_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(
        "leadlake-bench", f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, seconds = registered()[0], {}
    queries["top_province"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    for name in HEADLINES:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    total = round(sum(seconds.values()), 3)
    line = {
        "metric": "headline queries, total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(line))


if __name__ == "__main__":
    main()
