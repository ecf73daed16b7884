"""Seeded fault injection: spikes, drifts, stuck values and dropouts over positions within streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from streamloom.functions.detectors import splitmix64
from streamloom.operators.order import broadcast_if_small, numbered, settle
from streamloom.sources.frames import read_labels
from streamloom.sources.sinks import label_lines
from streamloom.sources.trec import read_trec, write_trec

RESOLVED = "spec_idx int, type string, stream_id long, onset long, last long, duration long, magnitude double"


def resolve(messages: DataFrame, specs: list[tuple], seed: int) -> list[tuple]:
    """Specs (type, stream_id, onset or None, duration, magnitude) with onsets drawn and ends clamped; those of empty streams,
    without duration or past the end go. A draw is made only for specs that pass the first two tests."""
    wanted = {s[1] for s in specs}
    sizes = {r.stream_id: r["count"] for r in messages.filter(F.col("stream_id").isin(*wanted)).groupBy("stream_id").count().collect()} if wanted else {}
    draws, out = splitmix64(seed), []
    for i, (kind, stream, onset, duration, magnitude) in enumerate(specs):
        n = sizes.get(stream, 0)
        if not n or not duration:
            continue
        if onset is None:
            onset = next(draws) % (max(n - duration, 0) + 1)
        if onset < n:
            out.append((i, kind, stream, onset, min(onset + duration - 1, n - 1), duration, float(magnitude)))
    return out


def inject(messages: DataFrame, specs: list[tuple], seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(messages with faults, labels). Every value fault reads the original value, the last one of the list wins, and a
    dropout removes its rows whatever else hits them. Times and sequence numbers stay."""
    spark = messages.sparkSession
    resolved = resolve(messages, specs, seed)
    found, streams = spark.createDataFrame(resolved, RESOLVED), {r[2] for r in resolved}
    placed = numbered(messages.filter(F.col("stream_id").isin(*streams) if streams else F.lit(False)), "j", keys=("stream_id",)).withColumn("j", F.col("j") - 1)
    m, f = placed.alias("m"), broadcast_if_small(found).alias("f")
    met = m.join(f, (F.col("m.stream_id") == F.col("f.stream_id")) & F.col("m.j").between(F.col("f.onset"), F.col("f.last")))
    hit = settle(met.select("m.*", *(F.col(f"f.{c}") for c in ("spec_idx", "type", "onset", "last", "duration", "magnitude"))))  # the specs' durations bound it
    at_onset = hit.filter("j = onset").select("spec_idx", F.col("value").alias("held"), F.col("ts_ns").alias("t_start_ns"))
    drift = F.col("value") + F.col("magnitude") * ((F.col("j") - F.col("onset") + 1).cast("double") / F.col("duration").cast("double"))
    value = F.when(F.col("type") == "spike", F.col("value") + F.col("magnitude")).when(F.col("type") == "drift", drift).when(F.col("type") == "stuck_at_value", F.col("held"))
    changed = hit.join(broadcast_if_small(at_onset.select("spec_idx", "held")), "spec_idx").select("pos", "spec_idx", "type", value.alias("new"))
    per_row = changed.groupBy("pos").agg(F.max(F.when(F.col("type") != "dropout", F.struct("spec_idx", "new"))).alias("x"), F.max(F.col("type") == "dropout").alias("gone"))
    out = messages.join(per_row, "pos", "left").filter("gone IS NULL OR NOT gone").withColumn("value", F.coalesce("x.new", "value")).select(*messages.columns)
    ends = hit.filter("j = last").select("spec_idx", "stream_id", "type", F.col("ts_ns").alias("t_end_ns"))
    labels = ends.join(at_onset.select("spec_idx", "t_start_ns"), "spec_idx").select(F.col("spec_idx").alias("label_idx"), "stream_id", "type", "t_start_ns", "t_end_ns")
    return out, labels


def inject_file(spark: SparkSession, source: str, target: str, labels: str, specs: list[tuple], seed: int = 0) -> bool:
    """From record file to record file, and the labels to a text file, in order of the specs; False if any of it fails."""
    try:
        bad, found = inject(read_trec(spark, source), specs, seed)
        write_trec(bad, target)
        lines = [r.value for r in label_lines(found).orderBy("label_idx").collect()]  # one at most for each spec of a list
        with open(labels, "w", encoding="utf-8") as f:
            f.writelines(f"{line}\n" for line in lines)
    except Exception:  # noqa: BLE001 - the caller asked for a status
        return False
    return True


def read_label_file(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a file that inject_file() wrote; a missing file has none, bad lines are left out."""
    try:
        with open(path, encoding="utf-8") as f:
            lines = f.read().splitlines()
    except FileNotFoundError:
        lines = []
    return read_labels(spark.createDataFrame(list(enumerate(lines)), "label_idx long, value string"))
