"""The feed's path to alerts as streaming state: duplicates and gaps, rules and the detectors of each stream, in one processor."""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamloom.operators.fold import Profile, new_state
from streamloom.plans.engine import LAYERS, score_detail
from streamloom.sources.frames import ticker_frames

ALERT = "stream_id long, pos long, rank int, ts_ns long, layer string, detail string"
ROW = ("pos", "stream_id", "epoch", "is_tick", "ts_ns", "value", "seq")


@dataclass
class Watch:
    """What is known of one stream: all of it is state."""

    profile: Profile
    rule: tuple[float, float, float] | None
    epoch: int = 0
    last: int | None = None
    before: tuple[float, int] | None = None
    machines: tuple = field(default=())

    def __post_init__(self):
        self.machines = self.machines or new_state(self.profile)

    def take(self, epoch: int, is_tick: bool, ts_ns: int, value: float, seq: int) -> Iterator[tuple[int, str, str]]:
        """(time, layer, detail) of the alerts of the next tick or heartbeat."""
        if epoch != self.epoch:
            self.epoch, self.last = epoch, None
        if self.last is not None:
            if seq <= self.last:
                return
            if seq > self.last + 1:
                yield 0, "feed", f"gap seq {self.last}->{seq}"
        self.last = seq
        if not is_tick:
            return
        yield from ((ts_ns, *found) for found in self.judge(ts_ns, value))

    def judge(self, ts_ns: int, value: float) -> Iterator[tuple[str, str]]:
        if self.rule is not None:
            low, high, most = self.rule
            before, self.before = self.before, (value, ts_ns)
            if value < low or value > high:
                yield "rules", "out_of_bounds"
            elif before is not None and ts_ns > before[1] and abs(value - before[0]) / ((ts_ns - before[1]) / 1e9) > most:
                yield "rules", "rate_violation"
        ewma, cusum, conformal = self.machines
        z = ewma.zscore(value)
        ewma.update(value)
        if cusum.check(value):
            yield "cusum", "changepoint"
        threshold = conformal.threshold(self.profile.conformal_alpha)
        if abs(z) > threshold:
            yield "conformal", score_detail(z, threshold)
        conformal.update(abs(z))


class Watcher(StatefulProcessor):
    """Keeps a pickled Watch per stream. Rows of a micro-batch are put in order of arrival first; order across batches is the
    source's."""

    def __init__(self, rules: dict[int, tuple[float, float, float]], profile: Profile):
        self.rules, self.profile = rules, profile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("watch", "data binary")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values("pos", kind="stable")
        watch = pickle.loads(self.state.get()[0]) if self.state.exists() else Watch(self.profile, self.rules.get(key[0]))
        out = []
        for pos, epoch, is_tick, ts_ns, value, seq in zip(*(frame[c].tolist() for c in ROW if c != "stream_id"), strict=True):
            for ts, layer, detail in watch.take(epoch, is_tick, int(ts_ns) if is_tick else 0, value, seq):
                out.append((key[0], pos, LAYERS[layer], ts, layer, detail))
        self.state.update((pickle.dumps(watch),))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in ALERT.split(", ")])

    def close(self) -> None:
        pass


def alert_stream(frames: DataFrame, products: DataFrame, rules: DataFrame, profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """Alerts (see ALERT; (pos, rank) orders and identifies them) of a stream of frames (pos, raw, optionally epoch: the number of
    times the connection was made anew). rules is collected: one row per configured stream. Needs the RocksDB state store."""
    held = {r.stream_id: (r["min"], r["max"], r.max_rate_of_change) for r in rules.collect()}
    epoch = F.coalesce(F.col("epoch"), F.lit(0)).cast("long") if "epoch" in frames.columns else F.lit(0).cast("long")
    parsed = ticker_frames(frames.select("pos", "raw", epoch.alias("epoch")), products, keep=("epoch",)).filter("parse_result IN ('ok', 'heartbeat')")
    rows = parsed.select("pos", "stream_id", "epoch", (F.col("parse_result") == "ok").alias("is_tick"), F.coalesce("ts_ns", F.lit(0).cast("long")).alias("ts_ns"), F.coalesce("value", F.lit(math.nan)).alias("value"), "seq")
    return rows.groupBy("stream_id").transformWithStateInPandas(Watcher(held, profile), ALERT, "Append", "None")
