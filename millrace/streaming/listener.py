"""Metric samples from query progress, by one table of what to read where."""

from __future__ import annotations

import datetime
import json
import threading
import time
from collections import Counter, deque
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQueryListener

from millrace.streaming.jobs import OBSERVED

SAMPLES = "name string, labels string, ts timestamp, value double"
# Names of metrics (fixed values), and the places of a progress report (as JSON) that they add up: a path whose * stands for
# each element. A counter adds the reports' values, a gauge is the report's value; scale multiplies it. What a report lacks
# gives no sample of a gauge and a step of 0 of a counter.
GAUGE, COUNTER = "gauge", "counter"
METRICS: list[tuple[str, str, tuple[str, ...], float]] = [
    ("batch_duration_seconds", GAUGE, ("batchDuration",), 0.001),
    ("input_rows_total", COUNTER, ("numInputRows",), 1),
    ("input_rows_per_second", GAUGE, ("inputRowsPerSecond",), 1),
    ("processed_rows_per_second", GAUGE, ("processedRowsPerSecond",), 1),
    ("state_rows", GAUGE, ("stateOperators", "*", "numRowsTotal"), 1),
    ("late_rows_dropped_total", COUNTER, ("stateOperators", "*", "numRowsDroppedByWatermark"), 1),
    ("offsets_behind_max", GAUGE, ("sources", "*", "metrics", "maxOffsetsBehindLatest"), 1),
    ("offsets_behind_avg", GAUGE, ("sources", "*", "metrics", "avgOffsetsBehindLatest"), 1),
    ("records_valid_total", COUNTER, ("observedMetrics", OBSERVED, "valid"), 1),
    ("records_rejected_total", COUNTER, ("observedMetrics", OBSERVED, "rejected"), 1),
    ("records_warned_total", COUNTER, ("observedMetrics", OBSERVED, "warned"), 1),
    ("max_lag_s", GAUGE, ("observedMetrics", OBSERVED, "max_lag_s"), 1),
    ("avg_lag_s", GAUGE, ("observedMetrics", OBSERVED, "avg_lag_s"), 1),
]
ALIVE, FAILED = "query_last_progress_seconds", "query_failures_total"


def found_at(report: Any, path: tuple[str, ...]) -> list[float]:
    """The numbers at a path of a report."""
    level = [report]
    for step in path:
        level = [y for x in level for y in ((x or []) if step == "*" else [x.get(step)] if isinstance(x, dict) else [])]
    return [float(x) for x in level if x is not None and x == x]


def samples_of(report: dict, query: str, totals: Counter) -> list[tuple[str, str, float]]:
    """(metric, query, value) of one progress report; totals keeps the counters."""
    out = []
    for metric, kind, path, scale in METRICS:
        there = found_at(report, path)
        if kind == COUNTER:
            totals[metric, query] += sum(there) * scale
            out.append((metric, query, float(totals[metric, query])))
        elif there:
            out.append((metric, query, sum(there) * scale))
    return out


class SampleListener(StreamingQueryListener):
    """Keeps the last `keep` samples; idle counts as alive, an error as a failure."""

    def __init__(self, keep: int = 100_000):
        self.rows: deque[tuple[str, str, float, float]] = deque(maxlen=keep)
        self._named: dict[str, str] = {}
        self._totals: Counter = Counter()
        self._lock = threading.Lock()

    def _keep(self, samples: list[tuple[str, str, float]]) -> None:
        with self._lock:
            self.rows.extend((metric, query, time.time(), value) for metric, query, value in samples)

    def _query(self, event: Any) -> str:
        return self._named.get(str(event.id), str(event.id))

    def onQueryStarted(self, event: Any) -> None:  # noqa: N802
        if event.name:
            self._named[str(event.id)] = event.name

    def onQueryProgress(self, event: Any) -> None:  # noqa: N802
        report = json.loads(event.progress.json)
        query = report.get("name") or str(report["id"])
        self._keep(samples_of(report, query, self._totals) + [(ALIVE, query, time.time())])

    def onQueryIdle(self, event: Any) -> None:  # noqa: N802
        self._keep([(ALIVE, self._query(event), time.time())])

    def onQueryTerminated(self, event: Any) -> None:  # noqa: N802
        query = self._query(event)
        self._totals[FAILED, query] += int(bool(event.exception))
        self._keep([(FAILED, query, float(self._totals[FAILED, query]))])

    def table(self, spark: SparkSession) -> DataFrame:
        """The samples as the table that operators.alerts reads."""
        with self._lock:
            held = list(self.rows)
        utc = lambda t: datetime.datetime.fromtimestamp(t, datetime.timezone.utc).replace(tzinfo=None)
        return spark.createDataFrame([(metric, query, utc(t), value) for metric, query, t, value in held], SAMPLES)
