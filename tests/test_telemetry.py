import math
import struct

import pytest
from pyspark.sql import functions as F

from streamloom.functions.detectors import Conformal, Cusum, Ewma, fnv1a, splitmix64
from streamloom.operators import evaluate, faults, fold, sequence
from streamloom.operators.fold import Profile
from streamloom.operators.rules import RULES, check_rules, load_rule_config
from streamloom.plans import engine
from streamloom.sources import frames, trec

M = "pos long, stream_id long, ts_ns long, value double, seq long"


def test_ewma_known_answers():
    e, means, variances = Ewma(0.5), [], []
    for x in (4.0, 6.0, 5.0):
        e.update(x)
        means.append(e.mean)
        variances.append(e.variance)
    assert means == [2, 4, 4.5] and variances == [8, 12, 6.5] and e.zscore(7.0) == pytest.approx(0.980580675690920)


def test_cusum_fires_once():
    c = Cusum(0.5, 0.5, 3.0)
    assert [i for i, x in enumerate([10, 10.5, 9.5, 10.5, 9.5, 10.5, 9.5, *[20] * 5]) if c.check(x)] == [7]


def test_conformal_quantiles():
    c = Conformal(10)
    assert c.threshold(0.1) == math.inf
    for x in range(1, 11):
        c.update(float(x))
    assert [c.threshold(a) for a in (0.2, 0.0, 0.99, 1.0)] == [8, 10, 1, 1]


def test_checksum_and_random_numbers():
    one = struct.pack("<IqdQ", 1, 1000, 2.5, 42)
    assert f"{fnv1a(one):016x}" == "d3d19d036981dbd3"
    assert f"{fnv1a(struct.pack('<IqdQ', 7, 2000, -3.25, 100), fnv1a(one)):016x}" == "835b3c96476fd867"
    draws = splitmix64(42)
    assert [next(draws), next(draws)] == [0xBDD732262FEB6E95, 0x28EFE333B266F103]


def test_gaps_duplicates_and_epochs(spark):
    m = spark.createDataFrame([(i, 1, i, 0.0, s) for i, s in enumerate([100, 105, 103, 106])], M)
    assert [tuple(r) for r in sequence.sequence_gaps(m).collect()] == [(1, 100, 105, 1)]
    assert [r.accepted for r in sequence.accept(m).orderBy("pos").collect()] == [True, True, False, True]
    e = sequence.epochs(m.withColumn("is_reset", F.col("pos") == 2)).orderBy("pos")
    assert [r.epoch for r in e.collect()] == [0, 0, 1, 1]


def test_rules(spark):
    s = 10**9
    m = spark.createDataFrame([(0, 1, 0, 50.0, 0), (1, 1, s, 50.5, 1), (2, 1, 2 * s, 51.1, 2), (3, 1, 2 * s, 60.0, 3), (4, 2, 0, 999.0, 0)], M)
    out = check_rules(m, spark.createDataFrame([(1, 45.0, 55.0, 0.5)], RULES)).orderBy("pos")
    assert [r.rule_result for r in out.collect()] == ["ok", "ok", "rate_of_change", "out_of_bounds", "ok"]


def test_golden_case(spark):
    m = spark.createDataFrame([(i, 1, (i + 1) * 10**9, 50.0, i) for i in range(200)], M)
    bad, labels = faults.inject(m, [("spike", 1, 30, 2, 100.0), ("drift", 1, 70, 20, 10.0), ("stuck_at_value", 1, 120, 20, 0.0), ("dropout", 1, 160, 20, 0.0)], 42)
    rules = spark.createDataFrame([(1, 45.0, 55.0, 0.5)], RULES)
    found = engine.alerts(bad, rules, Profile(0.05, 0.5, 0.5, 3.0, 1, 50, 0.01))
    rows = evaluate.match_labels(found, labels).orderBy("id").collect()
    assert len(rows) == 29
    assert [(r.ts_ns // 10**9, r.layer, r.label) for r in rows[:6]] == [(2, "conformal", "false_alarm"), (31, "rules", "spike"), (31, "conformal", "spike"), (32, "rules", "spike"), (33, "rules", "false_alarm"), (71, "cusum", "drift")]
    assert rows[0].detail == "score=4.2485>thr=0.0000"


def test_trec_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.trec")
    m = spark.createDataFrame([(i, i % 3, 1000 + i, 1.25 * i, i) for i in range(50)], M)
    assert trec.write_trec(m, path) == 50 and trec.trec_status(path) == ("ok", 50, False)
    assert sorted(map(tuple, trec.read_trec(spark, path, 7).collect())) == sorted(map(tuple, m.collect()))
    with open(path, "r+b") as f:
        f.truncate(8 + 2 * 64 + 30)
    assert trec.trec_status(path) == ("ok", 2, True) and trec.read_trec(spark, path).count() == 2
    assert trec.trec_status(str(tmp_path / "none"))[0] == "file_not_found"


def test_frames(spark):
    raw = [
        '{"type":"ticker","product_id":"BTC-USD","price":"62975.91","time":"2026-07-08T01:56:01.617651Z","trade_id":1052192039}',
        '{"type":"heartbeat","product_id":"BTC-USD","last_trade_id":1052192040}', '{"type":"subscriptions"}', "{oops",
        '{"type":"ticker","product_id":"X","price":1}', '{"type":"ticker","product_id":"BTC-USD","price":5,"time":"2026-07-08T01:56:01Z","trade_id":1}',
    ]
    f = spark.createDataFrame(list(enumerate(raw)), "pos long, raw string")
    rows = frames.ticker_frames(f, spark.createDataFrame([("BTC-USD", 1)], "product_id string, stream_id long")).orderBy("pos").collect()
    assert [r.parse_result for r in rows] == ["ok", "heartbeat", "skipped", "malformed", "skipped", "malformed"]
    assert rows[0].ts_ns == 1783475761617651000 and rows[0].value == 62975.91
    snap = spark.createDataFrame([(0, '{"now":1700000000000,"ac":[{"hex":"a","lat":1,"lon":2.5,"seen":2.5,"alt_baro":"ground"},{"hex":"b","lat":1,"lon":2,"seen":"x","alt_baro":1}]}')], "pos long, raw string")
    assert [(r.hex, r.ts_ns, r.value) for r in frames.adsb_snapshots(snap).collect()] == [("a", 1699999997500000000, 0.0)]


def test_rule_file(tmp_path):
    p = tmp_path / "r.yaml"
    p.write_text("stream_id: 1 # x\nmin: 45\nmax: 55.0\nmax_rate_of_change: 0.5\nname: grid\n")
    assert load_rule_config(str(p))["max"] == 55.0
    p.write_text("stream_id: 1\nmin: 5\nmax: 5\nmax_rate_of_change: 1\n")
    with pytest.raises(ValueError):
        load_rule_config(str(p))


def test_streaming_equals_batch(spark, tmp_path):
    from streamloom.streaming.processor import detect_stream

    m = spark.range(300).select(F.col("id").alias("pos"), (F.col("id") % 3).alias("stream_id"), (F.col("id") * 10).alias("ts_ns"), F.sin(F.col("id").cast("double")).alias("value"), F.col("id").alias("seq"))
    for k in range(3):
        m.filter((F.col("pos") >= 100 * k) & (F.col("pos") < 100 * (k + 1))).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(m.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = detect_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pos").select("pos", "z", "cusum_fired", "threshold").collect()
    assert got == fold.detect(m).orderBy("pos").select("pos", "z", "cusum_fired", "threshold").collect()
