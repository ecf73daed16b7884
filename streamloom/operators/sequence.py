"""Order within streams: duplicates, gaps, sequence numbers, registries, reconnects. `pos` is arrival order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators.order import numbered, running


def accept(messages: DataFrame, by: str = "seq", keys: tuple[str, ...] = ("stream_id",), levels: int = 1) -> DataFrame:
    """Add last (the largest accepted value so far) and accepted. Drops never move it, so it is a running maximum."""
    marked = running(messages, "last", F.col(by), "max", keys=keys, levels=levels)
    return marked.withColumn("accepted", F.col("last").isNull() | (F.col(by) > F.col("last")))


def sequence_gaps(messages: DataFrame, keys: tuple[str, ...] = ("stream_id",)) -> DataFrame:
    found = accept(messages, "seq", keys).filter("accepted AND seq > last + 1")
    return found.select("stream_id", F.col("last").alias("from_seq"), F.col("seq").alias("to_seq"), "pos")


def time_gaps(messages: DataFrame, most_ns: int = 1_000_000_000, levels: int = 1) -> DataFrame:
    found = accept(messages, "ts_ns", levels=levels).filter(F.col("accepted") & (F.col("ts_ns") - F.col("last") > most_ns))
    return found.select("stream_id", F.col("last").alias("from_ts"), F.col("ts_ns").alias("to_ts"), "pos")


def number(messages: DataFrame, key: str = "stream_id", levels: int = 1) -> DataFrame:
    """Sequence numbers from 1 over accepted rows. Sparse positions, such as those of samples within polls, want 2 levels."""
    kept = accept(messages, "ts_ns", (key,), levels).filter("accepted").drop("last", "accepted")
    return numbered(kept, "seq", keys=(key,), levels=levels)


def register(rows: DataFrame, key: str, most: int, base: int = 0) -> DataFrame:
    """stream_id = base + order of first sight, for the first `most` distinct keys only. The registry has `most` rows."""
    first = rows.groupBy(key).agg(F.min("pos").alias("first_pos")).orderBy("first_pos", key).limit(most)
    known = first.withColumn("stream_id", F.row_number().over(Window.orderBy("first_pos", key)).cast("long") - 1 + base)
    return rows.join(F.broadcast(known.drop("first_pos")), key)


def epochs(rows: DataFrame, is_reset: str = "is_reset") -> DataFrame:
    """Number of resets at or before each row."""
    own = F.col(is_reset).cast("long")
    return running(rows, "epoch", own, "sum").withColumn("epoch", F.coalesce("epoch", F.lit(0).cast("long")) + F.coalesce(own, F.lit(0).cast("long")))


def accept_between_resets(rows: DataFrame, by: str = "seq", is_reset: str = "is_reset") -> DataFrame:
    """Add epoch, last and accepted: as accept(), but a reset row makes all streams forget what they had seen."""
    return accept(epochs(rows, is_reset).filter(~F.coalesce(F.col(is_reset), F.lit(False))), by, ("epoch", "stream_id"))


def track_registered(rows: DataFrame, key: str, most: int, base: int = 0, levels: int = 2) -> DataFrame:
    """Messages of the first `most` keys, dropped unless their time advances and numbered from 1 within each key."""
    known = register(rows, key, most, base)
    return number(known, "stream_id", levels)
