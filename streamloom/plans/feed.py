"""From feed frames to alerts: parse, drop what isn't new, report gaps, detect; and the counters of all that."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamloom.operators.fold import Profile
from streamloom.operators.order import settle
from streamloom.operators.sequence import accept_between_resets
from streamloom.plans import engine
from streamloom.sources.frames import ticker_frames

RESET = "is_reset"


def tracked(frames: DataFrame, products: DataFrame) -> DataFrame:
    """Ticks and heartbeats of frames (pos, raw, optionally is_reset: the connection was made anew) with epoch, last and accepted.
    Heartbeats take part in gap detection, but are no messages."""
    resets = frames.filter(RESET) if RESET in frames.columns else frames.limit(0)
    parsed = ticker_frames(frames.select("pos", "raw"), products).filter("parse_result IN ('ok', 'heartbeat')").withColumn(RESET, F.lit(False))
    return accept_between_resets(parsed.unionByName(resets.select("pos", F.lit(True).alias(RESET)), allowMissingColumns=True))


def messages_of(seen: DataFrame) -> DataFrame:
    return seen.filter("accepted AND parse_result = 'ok'").select("pos", "stream_id", "ts_ns", "value", "seq")


def gaps_of(seen: DataFrame) -> DataFrame:
    return seen.filter("accepted AND seq > last + 1").select("pos", "stream_id", F.col("last").alias("from_seq"), F.col("seq").alias("to_seq"))


def gap_alerts(gaps: DataFrame) -> DataFrame:
    """Alerts of the feed itself carry no time: 0."""
    detail = F.concat(F.lit("gap seq "), "from_seq", F.lit("->"), "to_seq")
    return gaps.select("pos", "stream_id", F.lit(0).cast("long").alias("ts_ns"), F.lit("feed").alias("layer"), detail.alias("detail"))


def feed_alerts(frames: DataFrame, products: DataFrame, rules: DataFrame, profile: Profile = Profile()) -> DataFrame:  # noqa: B008
    """id, stream_id, ts_ns, layer, detail of all five layers."""
    seen = settle(tracked(frames, products))
    return engine.in_turn(gap_alerts(gaps_of(seen)).unionByName(engine.raised(messages_of(seen), rules, profile)))


def counters(frames: DataFrame, products: DataFrame, alerts: DataFrame) -> DataFrame:
    """One row: received, pushed, parse_failures, gaps, reconnects, alerts, last_ts_ns, streams."""
    resets = F.coalesce(F.col(RESET), F.lit(False)) if RESET in frames.columns else F.lit(False)
    marked = frames.withColumn(RESET, resets)
    parsed = ticker_frames(marked.filter(~F.col(RESET)).select("pos", "raw"), products)
    seen = tracked(frames, products)
    pushed = F.col("accepted") & (F.col("parse_result") == "ok")
    rows = [
        marked.agg(F.count_if(~F.col(RESET)).alias("received"), F.count_if(RESET).alias("reconnects")),
        parsed.agg(F.count_if(F.col("parse_result") == "malformed").alias("parse_failures")),
        seen.agg(F.count_if(pushed).alias("pushed"), F.count_if(F.col("accepted") & (F.col("seq") > F.col("last") + 1)).alias("gaps"), F.max_by("ts_ns", F.when(pushed, F.col("pos"))).alias("last_ts_ns"), F.array_sort(F.collect_set(F.when(pushed, F.col("stream_id")))).alias("streams")),
        alerts.agg(F.count(F.lit(1)).alias("alerts")),
    ]
    return engine.one_row(rows).select("received", "pushed", "parse_failures", "gaps", "reconnects", "alerts", "last_ts_ns", "streams")
