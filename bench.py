"""Time the headline queries; prints one JSON line.

A query's time is the median of its warm runs, written to a sink that drops the
rows. Slow queries get fewer runs. A query that exceeds ``BENCH_QUERY_SECONDS`` is cancelled
and listed under ``stopped``; figures are also written to stderr as they come, and the JSON
line is printed with what there is when the bench is ended early.
"""

from __future__ import annotations

import json
import os
import signal
import statistics
import sys
import threading
import time

from hearken.plans.registry import QUERIES
from hearken.session import local_session

HEADLINE = [
    "normalize_text",
    "corpus_profile",
    "mark_duplicates",
    "route_rows",
    "build_corpus_pairs",
    "cluster_representatives",
    "thin_groups",
    "class_report",
    "ngram_df",
    "char_tfidf",
    "topk_cosine",
    "topk_cells",
    "format_contexts",
    "embed_and_search",
    "history_as_of_turn",
    "turn_pairs",
    "first_vote",
    "parse_requests",
    "intent_rules_default",
    "translation_merge",
    "answer_messages",
    "language_predictions",
]
WARM_RUNS = 5
SLOW_SECONDS = 5.0
VERY_SLOW_SECONDS = 30.0


class Bench:
    """Times of the queries done so far."""

    def __init__(self, sf_dir: str, cores: str) -> None:
        self.sf_dir, self.cores = sf_dir, cores
        self.spark = local_session(cores, "bench")
        self.spark.sparkContext.setLogLevel("ERROR")
        self.limit = float(os.environ.get("BENCH_QUERY_SECONDS", "150"))
        self.times: dict[str, float] = {}
        self.stopped: list[str] = []

    def run(self, name: str) -> float:
        """Seconds of one run; jobs of a run over the limit are cancelled."""
        context = self.spark.sparkContext
        over = threading.Timer(self.limit, context.cancelAllJobs)
        over.start()
        start = time.perf_counter()
        try:
            QUERIES[name](self.spark, self.sf_dir).write.format("noop").mode("overwrite").save()
        finally:
            over.cancel()
        return time.perf_counter() - start

    def measure(self, name: str) -> None:
        try:
            first = self.run(name)
            runs = WARM_RUNS if first < SLOW_SECONDS else 1 if first < VERY_SLOW_SECONDS else 0
            warm = [self.run(name) for _ in range(runs)]
        except Exception as cause:  # the other figures still count
            self.stopped.append(name)
            print(f"{name} stopped: {str(cause)[:200]}", file=sys.stderr, flush=True)
            return
        self.times[name] = round(statistics.median(warm or [first]), 3)
        print(f"{name} {self.times[name]}", file=sys.stderr, flush=True)

    def report(self) -> str:
        return json.dumps(
            {
                "metric": "headline queries, sum of median warm times",
                "value": round(sum(self.times.values()), 3),
                "unit": "sec",
                "queries": self.times,
                "stopped": self.stopped,
                "sf": os.path.basename(self.sf_dir.rstrip("/")).removeprefix("sf"),
                "cores": int(self.cores),
            }
        )


def main() -> None:
    bench = Bench(
        os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    )

    def ended(*_) -> None:
        print(bench.report(), flush=True)
        os._exit(1)

    signal.signal(signal.SIGTERM, ended)
    for name in sys.argv[1:] or HEADLINE:
        bench.measure(name)
    print(bench.report(), flush=True)
    bench.spark.stop()


if __name__ == "__main__":
    main()
