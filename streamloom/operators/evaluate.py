"""Alerts against labels, and detection scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from streamloom.operators.order import broadcast_if_small, numbered, settle


def match_labels(alerts: DataFrame, labels: DataFrame) -> DataFrame:
    """Add label: the type of the label of the stream whose closed interval holds the alert, the earliest start first, then
    the first in the list; false_alarm if none. Alerts differ by id."""
    a, b = alerts.alias("a"), broadcast_if_small(labels).alias("b")
    met = a.join(b, (F.col("a.stream_id") == F.col("b.stream_id")) & F.col("a.ts_ns").between(F.col("b.t_start_ns"), F.col("b.t_end_ns")), "left")
    first = F.min(F.when(F.col("b.type").isNotNull(), F.struct("b.t_start_ns", "b.label_idx", "b.type")))
    best = met.groupBy(*(F.col(f"a.{c}") for c in alerts.columns)).agg(first.alias("_first"))
    return best.select(*alerts.columns, F.coalesce("_first.type", F.lit("false_alarm")).alias("label"))


def detection_score(fires: DataFrame, onset: int) -> DataFrame:
    """stream_id, first_fire, delay (null if missed), false_alarms of fires (stream_id, j) against an onset position."""
    first = F.min(F.when(F.col("j") >= onset, F.col("j")))
    return fires.groupBy("stream_id").agg(first.alias("first_fire"), (first - onset).alias("delay"), F.count_if(F.col("j") < onset).alias("false_alarms"))


#: The type of fault that each hypothesis of a memo stands for.
FAULT_OF = {
    "bad_print": "spike", "sensor_glitch": "spike", "telemetry_glitch": "spike", "market_move": "drift", "generation_loss": "drift", "real_maneuver": "drift",
    "stuck_sensor": "stuck_at_value", "stuck_upstream": "stuck_at_value", "feed_gap_artifact": "dropout", "receiver_outage": "dropout", "coverage_dropout": "dropout",
}


def fault_of(hypothesis: Column) -> Column:
    """The fault type of a hypothesis; null for one that stands for none."""
    return F.element_at(F.create_map(*(F.lit(x) for pair in FAULT_OF.items() for x in pair)), hypothesis)


def judged(memos: DataFrame, labels: DataFrame) -> DataFrame:
    """Memos (case_idx, hypothesis, judge) beside the labels (case_idx, type) of the same cases, with correct."""
    right = F.coalesce(fault_of(F.col("hypothesis")) == F.col("type"), F.lit(False))
    return memos.join(labels, "case_idx").withColumn("correct", right)


def accuracy(cases: DataFrame) -> DataFrame:
    """accuracy and mean_judge of cases (correct, judge); 0 without cases."""
    return cases.agg(F.coalesce(F.avg(F.col("correct").cast("double")), F.lit(0.0)).alias("accuracy"), F.coalesce(F.avg("judge"), F.lit(0.0)).alias("mean_judge"), F.count(F.lit(1)).alias("n"))


def alarm_rate(folded: DataFrame, warmup: int) -> DataFrame:
    """stream_id, rate, n: the share of anomalous messages after the first `warmup` of each stream."""
    later = numbered(folded, "nth", keys=("stream_id",)).filter(F.col("nth") > warmup)
    return later.groupBy("stream_id").agg(F.avg(F.col("anomalous").cast("double")).alias("rate"), F.count(F.lit(1)).alias("n"))


def order_statistics(values: DataFrame, column: str, shares: dict[str, float]) -> DataFrame:
    """One row: for each named share q, the value at place floor(q * (n - 1)), from 0, of the sorted column; nulls don't count, and
    without values all are null. Values are sorted in ranges; a range is read again only if a wanted place is in it."""
    kept = values.select(F.col(column).alias("x")).filter("x IS NOT NULL")
    ranges = settle(kept.repartitionByRange("x").withColumn("range", F.spark_partition_id()))
    sizes = {r["range"]: r["count"] for r in ranges.groupBy("range").count().collect()}  # one row per partition
    n, begin, places = sum(sizes.values()), 0, []
    wanted = {name: int(q * (n - 1)) for name, q in shares.items()} if n else {}
    for k in sorted(sizes):
        places += [(name, k, at - begin + 1) for name, at in wanted.items() if begin <= at < begin + sizes[k]]
        begin += sizes[k]
    spark = values.sparkSession
    found = spark.createDataFrame(places, "name string, range int, nth int")
    ranked = ranges.join(F.broadcast(found.select("range").distinct()), "range", "left_semi").withColumn("nth", F.row_number().over(Window.partitionBy("range").orderBy("x")))
    hits = ranked.join(F.broadcast(found), ["range", "nth"])  # as many rows as shares
    return hits.agg(*(F.max(F.when(F.col("name") == name, F.col("x"))).alias(name) for name in shares))


def report(cases: list[dict], scores: dict) -> str:
    """A table of cases (ts_ns, layer, type, hypothesis, confidence, correct, judge, evidence), as text, and the scores below."""
    heads = ("alert", "fault", "hypothesis", "sure", "right", "judge")
    lines = [(f"{c['ts_ns']}/{c['layer']}", c["type"], c["hypothesis"], f"{float(c['confidence']):.2f}", str(c["correct"]), f"{float(c['judge']):.2f}") for c in cases]
    widths = [max(map(len, column)) for column in zip(heads, *lines, strict=True)]
    shown = lambda cells: "  ".join(c.ljust(w) for c, w in zip(cells, widths, strict=True)).rstrip()
    body = [x for c, cells in zip(cases, lines, strict=True) for x in (shown(cells), f"    evidence: {c['evidence']}")]
    return "\n".join([shown(heads), *body, f"accuracy {scores['accuracy']:.3f}, mean judge {scores['mean_judge']:.3f}"])
