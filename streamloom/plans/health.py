"""The counters file of a running engine, and what it says about the engine's health."""

from __future__ import annotations

import json
import os
from datetime import datetime, timedelta

#: The counters of the file, with what each is without a file.
COUNTERS = {
    "start_time_unix": 0.0, "now_unix": 0.0, "messages_received": 0, "messages_processed": 0, "ticks_pushed": 0, "parse_failures": 0,
    "gaps": 0, "reconnects": 0, "alerts": 0, "last_message_unix_ms": 0, "last_message_ts_ns": 0, "streams": [],
}


class Stats(dict):
    """The counters, each as its default's type, and what follows from them. healthy: whether there were any."""

    def __init__(self, raw: dict | None = None):
        super().__init__({k: type(default)((raw or {}).get(k) or default) for k, default in COUNTERS.items()})
        self.healthy = raw is not None

    @property
    def per_second(self) -> float:
        """Over the engine's own clock, from its start."""
        seconds = self["now_unix"] - self["start_time_unix"]
        return self["messages_processed"] / seconds if self.healthy and seconds > 0 else 0.0

    @property
    def streams(self) -> list[int]:
        return [int(s) for s in self["streams"]]

    @property
    def last_message(self) -> float | None:
        ms = self["last_message_unix_ms"]
        return ms / 1000 if ms > 0 else None

    def up(self, now: float) -> float:
        return max(0.0, now - self["start_time_unix"])


def write_stats(path: str, stats: dict) -> None:
    """Readers see the old file or the new one, never a part."""
    part = f"{path}.{os.getpid()}.part"
    with open(part, "w", encoding="utf-8") as f:
        json.dump(stats, f)
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def read_stats(path: str) -> Stats:
    """Unhealthy and zero if there is no readable file."""
    try:
        with open(path, "rb") as f:
            return Stats(json.load(f))
    except (OSError, ValueError, TypeError, AttributeError):
        return Stats()


def _utc(ms: int) -> str | None:
    return f"{(datetime(1970, 1, 1) + timedelta(milliseconds=ms)).isoformat()}Z" if ms > 0 else None


def health(stats: Stats, now: float) -> tuple[int, dict]:
    """(200 or 503, body). A silent feed is healthy; only an engine without counters is not."""
    code, up = (200, stats.up(now)) if stats.healthy else (503, 0.0)
    return code, {"uptime_seconds": up, "total_messages_processed": stats["messages_processed"], "last_message_timestamp": _utc(stats["last_message_unix_ms"])}


def status(stats: Stats, now: float) -> dict:
    """The body of a status page."""
    return {"uptime_s": stats.up(now), "messages_processed": stats["messages_processed"], "msgs_per_sec": stats.per_second, "streams": stats.streams}
