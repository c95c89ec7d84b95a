"""Counters of statements and their times, in the Prometheus text format."""

from __future__ import annotations

import threading
import time
from contextlib import contextmanager

BUCKETS = (0.01, 0.05, 0.1, 0.5, 1, 5, 10, 60)


class Metrics:
    def __init__(self) -> None:
        self._lock = threading.Lock()
        self.total, self.failed, self.seconds = 0, 0, 0.0
        self.buckets = [0] * (len(BUCKETS) + 1)
        self.gauges: dict[str, int] = {}

    @contextmanager
    def timed(self):
        start = time.perf_counter()
        failed = 1
        try:
            yield
            failed = 0
        finally:
            took = time.perf_counter() - start
            with self._lock:
                self.total += 1
                self.failed += failed
                self.seconds += took
                self.buckets[next((i for i, b in enumerate(BUCKETS) if took <= b), len(BUCKETS))] += 1

    def measure(self, graph) -> None:
        """Take the numbers of nodes and edges: a count of every table."""
        self.gauges["nodes"], self.gauges["edges"] = graph.counts()

    def render(self) -> str:
        with self._lock:
            lines = ["# TYPE loomgraph_queries_total counter", f"loomgraph_queries_total {self.total}", "# TYPE loomgraph_query_errors_total counter", f"loomgraph_query_errors_total {self.failed}", "# TYPE loomgraph_query_seconds histogram"]
            sofar = 0
            for bound, n in zip([*BUCKETS, "+Inf"], self.buckets, strict=True):
                sofar += n
                lines.append(f'loomgraph_query_seconds_bucket{{le="{bound}"}} {sofar}')
            lines += [f"loomgraph_query_seconds_sum {self.seconds:.6f}", f"loomgraph_query_seconds_count {self.total}"]
            for name, n in sorted(self.gauges.items()):
                lines += [f"# TYPE loomgraph_{name} gauge", f"loomgraph_{name} {n}"]
        return "\n".join(lines) + "\n"
