import json

from pyspark.sql import functions as F

from streamloom.sources import frames, sinks

LABELS = "label_idx long, stream_id long, type string, t_start_ns long, t_end_ns long"
ALERTS = "id long, stream_id long, ts_ns long, layer string, detail string"


def test_labels_round_trip(spark, tmp_path):
    rows = [(1, 4, "drift", 5, 9), (0, 2, "spike", 10, 10), (2, 4, "dropout", 0, 2**62)]
    sinks.write_labels(spark.createDataFrame(rows, LABELS), str(tmp_path / "l"))
    lines = [line for p in sorted((tmp_path / "l").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["2|spike|10|10", "4|drift|5|9", f"4|dropout|0|{2**62}"]
    back = frames.read_labels(spark.createDataFrame(list(enumerate(lines)), "label_idx long, value string")).select("label_idx", "stream_id", "type", "t_start_ns", "t_end_ns")
    assert sorted(map(tuple, back.collect())) == sorted(rows)


def test_alerts_as_json(spark, tmp_path):
    a = spark.createDataFrame([(2, 1, 20, "cusum", "changepoint"), (1, 1, 10, "rules", 'a "b"')], ALERTS)
    sinks.write_alerts(a, str(tmp_path / "batch"))
    lines = [json.loads(x) for p in sorted((tmp_path / "batch").glob("part-*")) for x in p.read_text().splitlines()]
    assert [(x["id"], x["detail"]) for x in lines] == [(1, 'a "b"'), (2, "changepoint")] and all(x["created_at"].endswith("Z") for x in lines)


def test_alert_stream_appends_once(spark, tmp_path):
    source, out, check = (str(tmp_path / x) for x in ("in", "out", "check"))
    for k in range(2):
        spark.range(3).select((F.col("id") + 3 * k).alias("id"), F.lit(1).cast("long").alias("stream_id"), F.col("id").alias("ts_ns"), F.lit("rules").alias("layer"), F.lit("x").alias("detail")).write.mode("append").parquet(source)
        for _ in range(2):
            sinks.append_alerts(spark.readStream.schema(ALERTS).parquet(source), out, check, once=True).awaitTermination()
        assert sorted(r.id for r in spark.read.json(out).collect()) == list(range(3 * k + 3))
