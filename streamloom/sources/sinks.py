"""Where results go: label lines, and alerts as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from streamloom.operators.order import settle


def _now():
    """The time of the query, in UTC whatever the session's time zone."""
    return F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def label_lines(labels: DataFrame) -> DataFrame:
    """label_idx, value: the lines `id|type|start|end` that read_labels() reads."""
    return labels.select("label_idx", F.concat_ws("|", "stream_id", "type", "t_start_ns", "t_end_ns").alias("value"))


def write_labels(labels: DataFrame, folder: str) -> None:
    """One text file in order of the labels, of which there is at most one per fault of the list."""
    label_lines(labels).coalesce(1).sortWithinPartitions("label_idx").select("value").write.mode("overwrite").text(folder)


def write_alerts(alerts: DataFrame, folder: str) -> None:
    """JSON lines in files whose names follow the order of ids; created_at is the time of writing."""
    alerts.withColumn("created_at", _now()).repartitionByRange("id").sortWithinPartitions("id").write.mode("append").json(folder)


def append_alerts(alerts: DataFrame, folder: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Append a stream of alerts as JSON lines, each exactly once; `once` stops after what there is now."""
    made = alerts.withColumn("created_at", _now())
    to = made.writeStream.format("json").option("path", folder).option("checkpointLocation", checkpoint).outputMode("append")
    return (to.trigger(availableNow=True) if once else to).start()


def insert_alerts(alerts: DataFrame, folder: str) -> int:
    """Add alerts to a Parquet table of them, their ids going on from the largest that it has; the largest id afterwards. One writer at
    a time."""
    spark = alerts.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    known = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    top = (spark.read.parquet(folder).agg(F.max("id")).first()[0] or 0) if known else 0
    added = settle(alerts.withColumn("id", F.col("id") + F.lit(top)).withColumn("created_at", _now()))
    added.write.mode("append").parquet(folder)
    return added.agg(F.max("id")).first()[0] or top
