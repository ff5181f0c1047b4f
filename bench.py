"""Benchmark: run the headline queries on $BENCH_SF_DIR (default sf0.1) with
local[$BENCH_CPUS] and print one JSON line.

Each query is executed completely through Spark's ``noop`` sink (no
collection to Python), so the time is the engine's work.
"""

from __future__ import annotations

import json
import os
import re
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "tokenize_docs",
    "vocab",
    "word_index",
    "encode_fixed",
    "encode_capped",
    "noise_exc",
    "complement_targets",
    "batches_shuffled",
    "lookup_table",
    "mean_pool_features",
    "attention_pool",
    "log_softmax_scores",
    "nl_gradient",
    "nl_loss",
    "lm_next_token",
    "cnn_scores",
    "train_nl_selnl_selpl",
]


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    only = sys.argv[1:]
    from sievetext.queries import QUERIES
    from sievetext.session import local_session

    shared = tempfile.TemporaryDirectory(prefix="sievetext-bench-")
    spark = local_session(cpus, shuffle_partitions=max(8, 2 * int(cpus)), app="sievetext-bench",
                          extra={"spark.checkpoint.dir": shared.name})
    # Untimed warm-up on the smallest data set next to the bench one: JIT
    # compilation and Python worker start-up are not part of a query's cost.
    warm = os.environ.get("BENCH_WARMUP_DIR",
                          os.path.join(os.path.dirname(sf_dir.rstrip("/")), "sf0.001"))
    if os.path.isdir(warm) and os.path.abspath(warm) != os.path.abspath(sf_dir):
        for name in only or HEADLINE:
            QUERIES[name](spark, warm).write.format("noop").mode("overwrite").save()
    times = {}
    for name in only or HEADLINE:
        t0 = time.time()
        df = QUERIES[name](spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"# {name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
           "queries": times, "sf": float(m.group(1)) if m else sf_dir, "cpus": int(cpus)}
    print(json.dumps(out))
    spark.stop()
    shared.cleanup()


if __name__ == "__main__":
    main()
