"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores, BENCH_QUERIES
(comma-separated) overrides the selection.
"""

from __future__ import annotations

import json
import os
import re
import time

from clipflow.session import build_session
from workload.queries import QUERIES

HEADLINE = [
    "clip_index_plan", "clip_timecodes", "frame_numbering", "clip_frame_gather", "clip_frame_gather_join",
    "clip_captions", "caption_batch", "zero_shot_scores", "zero_shot_last_clip", "caption_join", "word_chunks",
    "extractive_summary", "hierarchical_summary", "oneshot_summary", "head_summary", "srt_document",
    "active_video", "chat_replies", "stream_active_video", "stream_clips",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = build_session(master=f"local[{cpus}]")
    spark.sparkContext.setLogLevel("OFF")
    QUERIES["clip_timecodes"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # starts the session

    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(scale.group(1)) if scale else None,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
