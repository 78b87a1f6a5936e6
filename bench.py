"""Headline queries, timed. Prints one JSON line. `BENCH_SF_DIR` names the data, `BENCH_CPUS` the local threads."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from foliograph.plans import registered  # noqa: E402
from foliograph.session import local_session  # noqa: E402

HEADLINE = ("an01_exact_candidates", "an04_find_quote", "an04_find_quote_changed", "an09_matched_lines", "an12_anchor_basis", "an18_find_in_papers", "jn02_text_under",
            "jn04_section_at", "jn05_reading_key", "jn17_term_occurrences", "ag09_build_sections", "ag10_build_figures", "gd01_paper_spans", "gd02_ground", "gr02_ancestors",
            "jn13_connected_notes", "gr06_new_connections", "wn02_history_within_budget", "st02_page_dwell", "ex13_describe_event")


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registered().queries
    spark.read.parquet(f"{root}/documents.parquet").count()
    times = {}
    for name in wanted:
        start = time.time()
        queries[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(root).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
