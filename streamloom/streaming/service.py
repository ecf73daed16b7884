"""Running a streaming query as a service: counters written at intervals, and a clean end on a signal."""

from __future__ import annotations

import signal
import threading
import time
from collections.abc import Callable

from pyspark.sql.streaming import StreamingQuery

from streamloom.plans.health import write_stats


def serve(query: StreamingQuery, stats_path: str, counters: Callable[[], dict] = dict, every: float = 1.0, stop: threading.Event | None = None) -> dict:
    """Write the counters file every so many seconds until the query ends or stop is set, which SIGTERM and SIGINT do; then stop the
    query and write the file once more. Gives the last counters. Rows read are those of the query's own progress."""
    stop = stop or threading.Event()
    begun, seen, batch = time.time(), 0, -1
    handlers = {}
    if threading.current_thread() is threading.main_thread():
        handlers = {s: signal.signal(s, lambda *_: stop.set()) for s in (signal.SIGTERM, signal.SIGINT)}

    def snapshot() -> dict:
        nonlocal seen, batch
        for p in query.recentProgress:
            if p["batchId"] > batch:
                seen, batch = seen + p["numInputRows"], p["batchId"]
        stats = {"start_time_unix": begun, "now_unix": time.time(), "messages_received": seen} | counters()
        write_stats(stats_path, stats)
        return stats

    try:
        while query.isActive and not stop.wait(every):
            snapshot()
    finally:
        query.stop()
        for s, handler in handlers.items():
            signal.signal(s, handler)
    return snapshot()
