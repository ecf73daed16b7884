"""The recursive detectors as one ordered fold per stream: no window has a closed form for them.

A stream's rows go to one task in order of arrival, and the state machines are carried from one Arrow batch to the next: Spark
sorts, and spills, outside of Python, and a worker holds one batch and one state, however long a stream is.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.functions.changepoint import Changepoints
from streamloom.functions.detectors import Conformal, Cusum, Ewma, FixedCusum, fnv1a

KINDS = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_(), "string": pa.string()}


@dataclass(frozen=True)
class Profile:
    ewma_alpha: float = 0.05
    cusum_alpha: float = 0.01
    cusum_k: float = 3.0
    cusum_h: float = 8.0
    warmup: int = 1
    window: int = 500
    conformal_alpha: float = 0.01


#: What each detector adds to a message. The conformal threshold judges the baseline's scores, so it brings the baseline along.
ADDED = {
    "ewma": "mean double, variance double, z double",
    "cusum": "cusum_high double, cusum_low double, cusum_fired boolean",
    "conformal": "threshold double, anomalous boolean",
}
ALL = ("ewma", "cusum", "conformal")
MESSAGE = "pos long, stream_id long, ts_ns long, value double, seq long"
COLUMNS = ", ".join(ADDED.values())
FOLDED = f"{MESSAGE}, {COLUMNS}"


def in_order(rows: DataFrame, new: Callable[[int], Callable], schema: str, added: list[str]) -> DataFrame:
    """Fold each stream of rows (stream_id, pos, ...): new(stream_id) makes a function that takes the next rows, as a dict of
    arrays, and gives the added columns as lists. All other columns of the schema pass through."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {c.split()[0]: KINDS[c.split()[1]] for c in schema.split(", ")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, step = None, None
        for batch in batches:
            ids = batch.column("stream_id").to_numpy(zero_copy_only=False)
            edges = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            for lo, hi in zip(edges.tolist(), [*edges[1:].tolist(), len(ids)], strict=True):
                part = batch.slice(lo, hi - lo)
                if step is None or ids[lo] != stream:
                    stream = ids[lo]
                    step = new(int(stream))
                found = step({n: part.column(n).to_numpy(zero_copy_only=False) for n in part.schema.names})
                yield pa.RecordBatch.from_arrays([pa.array(found[n], kinds[n]) if n in added else part.column(n) for n in names], names=names)

    known = rows.filter("stream_id IS NOT NULL")
    return known.repartition("stream_id").sortWithinPartitions("stream_id", "pos").mapInArrow(run, schema)


def detect(messages: DataFrame, profile: Profile = Profile(), wanted: tuple[str, ...] = ALL) -> DataFrame:  # noqa: B008
    """The wanted detectors in one pass: the state after each message, its z-score before, and what fired. Streams run side by
    side; within one, order is arrival and the fold is serial."""
    columns = [c.split()[0] for w in wanted for c in ADDED[w].split(", ")]

    def new(stream_id: int):
        state = new_state(profile)
        return lambda rows: dict(zip(columns, run_detectors(rows["value"].tolist(), profile, state, wanted), strict=True))

    schema = ", ".join([MESSAGE, *(ADDED[w] for w in wanted)])
    return in_order(messages.select("pos", "stream_id", "ts_ns", "value", "seq"), new, schema, columns)


def run_detectors(values: list[float], profile: Profile, state: tuple[Ewma, Cusum, Conformal], wanted: tuple[str, ...] = ALL) -> list[list]:
    """The added columns, one list each, of the next values of a stream; state goes on."""
    ewma, cusum, conformal = state
    out: list[list] = []
    z: list[float] = []
    if "ewma" in wanted or "conformal" in wanted:
        means, variances = [], []
        for x in values:
            z.append(ewma.zscore(x))
            ewma.update(x)
            means.append(ewma.mean)
            variances.append(ewma.variance)
        if "ewma" in wanted:
            out += [means, variances, z]
    if "cusum" in wanted:
        highs, lows, fired = [], [], []
        for x in values:
            fired.append(cusum.check(x))
            highs.append(cusum.high)
            lows.append(cusum.low)
        out += [highs, lows, fired]
    if "conformal" in wanted:
        limits, over = [], []
        for score in map(abs, z):
            limits.append(conformal.threshold(profile.conformal_alpha))
            over.append(score > limits[-1])
            conformal.update(score)
        out += [limits, over]
    return out


def new_state(profile: Profile) -> tuple[Ewma, Cusum, Conformal]:
    return Ewma(profile.ewma_alpha), Cusum(profile.cusum_alpha, profile.cusum_k, profile.cusum_h, profile.warmup), Conformal(profile.window)


def checksums(messages: DataFrame) -> DataFrame:
    """stream_id, digest: FNV-1a-64 over each stream's messages in order, as hex. The digest so far is known at every batch; the
    last one of a stream stays."""

    def new(stream_id: int):
        so_far: list[int] = []

        def step(rows: dict) -> dict:
            data = b"".join(struct.pack("<IqdQ", *r) for r in zip(rows["stream_id"].tolist(), rows["ts_ns"].tolist(), rows["value"].tolist(), rows["seq"].tolist(), strict=True))
            so_far[:] = [fnv1a(data, *so_far)]
            n = len(rows["pos"])
            return {"digest": [None] * (n - 1) + [f"{so_far[0]:016x}"]}

        return step

    folded = in_order(messages.select("pos", "stream_id", "ts_ns", "value", "seq"), new, f"{MESSAGE}, digest string", ["digest"])
    return folded.filter("digest IS NOT NULL").groupBy("stream_id").agg(F.max_by("digest", "pos").alias("digest"))


def fixed_cusum_fires(messages: DataFrame, **options) -> DataFrame:
    """stream_id, pos of the messages at which a CUSUM with known mean and deviation fires."""

    def new(stream_id: int):
        detector = FixedCusum(**options)
        return lambda rows: {"fired": [detector.check(x) for x in rows["value"].tolist()]}

    folded = in_order(messages.select("pos", "stream_id", "value"), new, "pos long, stream_id long, fired boolean", ["fired"])
    return folded.filter("fired").select("stream_id", "pos")


def baseline_asof(messages: DataFrame, stream_id: int, ts_ns: int, alpha: float = 0.3) -> DataFrame:
    """mean, variance of a stream at a time: a fresh fold over what had arrived with an earlier or equal time."""
    seen = messages.filter((F.col("stream_id") == stream_id) & (F.col("ts_ns") <= ts_ns))
    return detect(seen, Profile(ewma_alpha=alpha), ("ewma",)).groupBy("stream_id").agg(F.max_by("mean", "pos").alias("mean"), F.max_by("variance", "pos").alias("variance"))


def changepoints(messages: DataFrame, **options) -> DataFrame:
    """pos, stream_id, run_length (the likeliest), recent (probability of a change within the last values), fired."""

    def new(stream_id: int):
        detector = Changepoints(**options)
        return lambda rows: dict(zip(("run_length", "recent", "fired"), map(list, zip(*map(detector.check, rows["value"].tolist()), strict=True)), strict=True))

    return in_order(messages.select("pos", "stream_id", "value"), new, "pos long, stream_id long, run_length long, recent double, fired boolean", ["run_length", "recent", "fired"])
