"""The detectors as streaming state: the batch fold's own state machines, kept per stream."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from streamloom.operators.fold import COLUMNS, FOLDED, MESSAGE, Profile, new_state, run_detectors


class Detectors(StatefulProcessor):
    """State: the pickled machines of a stream. Rows of a micro-batch are put in order of arrival first; order across batches
    is the source's."""

    def __init__(self, profile: Profile):
        self.profile = profile

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("machines", "data binary")

    def handleInputRows(self, key, rows: Iterator, timerValues) -> Iterator:
        import pandas as pd

        frame = pd.concat(list(rows)).sort_values("pos", kind="stable", ignore_index=True)
        machines = pickle.loads(self.state.get()[0]) if self.state.exists() else new_state(self.profile)
        added = run_detectors(frame["value"].tolist(), self.profile, machines)
        self.state.update((pickle.dumps(machines),))
        yield frame[[c.split()[0] for c in MESSAGE.split(", ")]].assign(**dict(zip([c.split()[0] for c in COLUMNS.split(", ")], added, strict=True)))

    def close(self) -> None:
        pass


def detect_stream(messages: DataFrame, profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """The streaming twin of detect(): needs the RocksDB state store."""
    rows = messages.select("pos", "stream_id", "ts_ns", "value", "seq").groupBy("stream_id")
    return rows.transformWithStateInPandas(Detectors(profile), FOLDED, "Append", "None")
