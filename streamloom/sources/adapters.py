"""Feeds as adapters: each makes messages (pos, stream_id, ts_ns, value, seq) and gaps of raw frames (pos, raw). A feed of one's own is any
class with these two methods."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import DataFrame

from streamloom.operators import sequence
from streamloom.plans import feed
from streamloom.sources import frames

MESSAGE = ("pos", "stream_id", "ts_ns", "value", "seq")


class Adapter(Protocol):
    def messages(self, raw: DataFrame) -> DataFrame: ...

    def gaps(self, raw: DataFrame) -> DataFrame: ...


@dataclass
class Ticker:
    """Push frames of the products (product_id, stream_id). A column is_reset marks where the connection was made anew."""

    products: DataFrame

    def messages(self, raw: DataFrame) -> DataFrame:
        return feed.messages_of(feed.tracked(raw, self.products))

    def gaps(self, raw: DataFrame) -> DataFrame:
        return feed.gaps_of(feed.tracked(raw, self.products))


@dataclass
class Grid:
    """Poll responses of one stream; polls may overlap, and samples more than most_ns apart make a gap."""

    stream_id: int
    most_ns: int = 1_000_000_000

    def messages(self, raw: DataFrame) -> DataFrame:
        return sequence.number(frames.grid_polls(raw, self.stream_id), levels=2).select(*MESSAGE)

    def gaps(self, raw: DataFrame) -> DataFrame:
        return sequence.time_gaps(frames.grid_polls(raw, self.stream_id), self.most_ns, levels=2)


@dataclass
class Aircraft:
    """Snapshots of aircraft, of which the first `most` that are seen become the streams base, base + 1, and so on. They have no gaps."""

    base: int
    most: int
    metric: str = "alt_baro"

    def messages(self, raw: DataFrame) -> DataFrame:
        return sequence.track_registered(frames.adsb_snapshots(raw, self.metric), "hex", self.most, self.base).select(*MESSAGE)

    def gaps(self, raw: DataFrame) -> DataFrame:
        return self.messages(raw).limit(0)
