"""From frames to alerts, in batch and streamed; numbers, rules, files and the evaluation set."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.functions.numbers import strtod, u32
from streamloom.operators import evaluate, faults, fold, sequence
from streamloom.operators.fold import Profile
from streamloom.operators.rules import RULES, check_rules, load_rule_config, rule_table
from streamloom.plans import engine, evaluation, feed, health
from streamloom.sources import frames, synthetic, trec
from streamloom.streaming.alerts import alert_stream

M = "pos long, stream_id long, ts_ns long, value double, seq long"
# Strings, and what strtod makes of the whole of them (None: nothing).
NUMBERS = {
    "5": 5.0, " 5.0": 5.0, "\t-5e2": -500.0, "+.5": 0.5, "5.": 5.0, "0x10": 16.0, "-0x1.8p3": -12.0, "0X.8": 0.5, "0xffffffffffffffff": 2.0**64, "inf": math.inf, "-Infinity": -math.inf,
    "nan": math.nan, "NAN(x_1)": math.nan, "1e999": math.inf, "": None, " ": None, "5 ": None, "5d": None, "1_000": None, "0x": None, "infi": None, "e5": None, "--5": None, "٣": None,
}


def test_decimal_strings(spark):
    texts = [*NUMBERS, "1" * 63, "1" * 64]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", frames.decimal(F.col("t")).alias("v")).collect()
    want = NUMBERS | {"1" * 63: float("1" * 63), "1" * 64: None}
    assert {r.t: repr(r.v) for r in got} == {t: repr(v) for t, v in want.items()}
    for t, v in NUMBERS.items():
        if v is None:
            with pytest.raises(ValueError):
                strtod(t)
        else:
            assert repr(strtod(t)) == repr(v)
    assert u32("4294967295") == 2**32 - 1
    for bad in ("-1", "4294967296", "1_0", "", "+1"):
        with pytest.raises(ValueError):
            u32(bad)


def test_rules_with_nan_and_repeats(spark):
    s = 10**9
    m = spark.createDataFrame([(0, 1, 0, 50.0, 0), (1, 1, s, math.nan, 1), (2, 1, 2 * s, 50.1, 2), (3, 1, 3 * s, 99.0, 3), (4, 1, 4 * s, math.inf, 4)], M)
    for rules in (rule_table(spark, [{"stream_id": 1, "min": 0, "max": 1, "max_rate_of_change": 1}, {"stream_id": 1, "min": 45, "max": 55, "max_rate_of_change": 0.5}]),
                  spark.createDataFrame([(1, 45.0, 55.0, 0.5, 1), (1, 0.0, 1.0, 1.0, 0)], RULES + ", rule_idx int")):
        assert [r.rule_result for r in check_rules(m, rules).orderBy("pos").collect()] == ["ok", "ok", "ok", "out_of_bounds", "out_of_bounds"]


def test_rule_files(tmp_path):
    p = tmp_path / "r.yaml"
    good = "stream_id: 7\nmin: -1.5e1\nmax: 0x10\nmax_rate_of_change: .5\n"
    p.write_text(good + "max:\nstream_id: # none\nother: x\n")
    assert load_rule_config(str(p)) == {"stream_id": 7, "min": -15.0, "max": 16.0, "max_rate_of_change": 0.5}
    p.write_text(good + "min: 3\n")
    assert load_rule_config(str(p))["min"] == 3.0
    for bad in ("min: 1_0\n", "stream_id: -7\n", "max: 5x\n", "min: 16\n", "stream_id: 7.0\n"):
        p.write_text(good + bad)
        with pytest.raises(ValueError):
            load_rule_config(str(p))
    p.write_text("stream_id: 7\nmin: 1\nmax: 2\n")
    with pytest.raises(ValueError, match="max_rate_of_change"):
        load_rule_config(str(p))


def test_resets_restart_deduplication(spark):
    seqs = [(0, 1, 100, False), (1, 1, 101, False), (2, 2, 7, False), (3, None, None, True), (4, 1, 50, False), (5, 1, 55, False), (6, 2, 7, False), (7, 1, 55, False)]
    rows = sequence.accept_between_resets(spark.createDataFrame(seqs, "pos long, stream_id long, seq long, is_reset boolean")).orderBy("pos").collect()
    assert [(r.pos, r.epoch, r.last, r.accepted) for r in rows] == [(0, 0, None, True), (1, 0, 100, True), (2, 0, None, True), (4, 1, None, True), (5, 1, 50, True), (6, 1, None, True), (7, 1, 55, False)]


def test_aircraft(spark):
    def craft(hex_, seen, **more):
        return {"hex": hex_, "lat": 1, "lon": 2.5, "seen": seen, "alt_baro": 10} | more

    polls = [
        {"now": 10_000, "ac": [craft("a", 1), craft("bad", "x"), craft("b", 2.5, alt_baro="ground"), craft("c", 0)]},
        {"now": 10_500, "ac": [craft("a", 1.5), craft("b", 0, alt_baro="other"), craft("c", 0), craft("d", 0)]},
        {"now": 12_000, "ac": [craft("a", 0.5, alt_baro=11.5), {"hex": "e"}, craft("b", 0)]},
    ]
    raw = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(polls)] + [(3, "{oops"), (4, '{"now": 1}')], "pos long, raw string")
    got = sequence.track_registered(frames.adsb_snapshots(raw), "hex", 3, 100).orderBy("pos").collect()
    assert [(r.stream_id, r.ts_ns // 10**6, r.value, r.seq) for r in got] == [(100, 9000, 10.0, 1), (101, 7500, 0.0, 1), (102, 10_000, 10.0, 1), (102, 10_500, 10.0, 2), (100, 11_500, 11.5, 2), (101, 12_000, 10.0, 2)]


def push(pos, seq, price, kind="ticker", product="P1"):
    return json.dumps({"type": kind, "product_id": product, "price": str(price), "time": f"2026-07-08T01:{pos // 60:02}:{pos % 60:02}Z", "trade_id": seq, "last_trade_id": seq})


@pytest.fixture(scope="module")
def log(spark):
    rng, rows, seq = np.random.default_rng(3), [], {"P1": 100, "P2": 500}
    for pos in range(240):
        product = "P1" if rng.random() < 0.6 else "P2"
        seq[product] += int(rng.choice([1, 1, 1, 1, 2, 0, -3]))
        price = 50 + rng.normal() * 0.2 + (30 if pos % 50 == 33 else 0)
        raw = push(pos, seq[product], price, "heartbeat" if pos % 9 == 4 else "ticker", product)
        rows.append((pos, None, True) if pos == 120 else (pos, "{x" if pos % 31 == 5 else raw, False))
    return rows


def test_feed_streams_as_it_batches(spark, tmp_path, log):
    products = spark.createDataFrame([("P1", 1), ("P2", 2)], "product_id string, stream_id long")
    rules = rule_table(spark, [{"stream_id": 1, "min": 45, "max": 55, "max_rate_of_change": 0.3}])
    profile = Profile(0.05, 0.1, 0.5, 3.0, 1, 50, 0.05)
    batch = feed.feed_alerts(spark.createDataFrame(log, "pos long, raw string, is_reset boolean"), products, rules, profile).orderBy("id").collect()
    assert {r.layer for r in batch} == {"feed", "rules", "cusum", "conformal"}
    for k in range(4):
        part = [(p, raw, int(p > 120)) for p, raw, reset in log if p // 60 == k and not reset]
        spark.createDataFrame(part, "pos long, raw string, epoch long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("pos long, raw string, epoch long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second start finds nothing new
        made = alert_stream(source, products, rules, profile).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck"))
        made.trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("pos", "rank").collect()
    assert [(r.stream_id, r.ts_ns, r.layer, r.detail) for r in got] == [(r.stream_id, r.ts_ns, r.layer, r.detail) for r in batch]


def test_feed_counters_and_status(spark, log):
    products = spark.createDataFrame([("P1", 1), ("P2", 2)], "product_id string, stream_id long")
    f = spark.createDataFrame(log, "pos long, raw string, is_reset boolean")
    found = feed.feed_alerts(f, products, rule_table(spark, [{"stream_id": 9, "min": 0, "max": 1, "max_rate_of_change": 1}]))
    c = feed.counters(f, products, found).first()
    last, pushed, gaps, bad = {}, 0, 0, 0
    for _, raw, reset in log:
        if reset:
            last = {}
            continue
        if raw == "{x":
            bad += 1
            continue
        a = json.loads(raw)
        n, before = a["trade_id"], last.get(a["product_id"])
        if before is None or n > before:
            gaps += before is not None and n > before + 1
            last[a["product_id"]] = n
            pushed += a["type"] == "ticker"
    assert (c.received, c.pushed, c.parse_failures, c.gaps, c.reconnects, c.streams) == (239, pushed, bad, gaps, 1, [1, 2])
    m = feed.messages_of(feed.tracked(f, products))
    assert engine.status(m, found, rule_table(spark, [{"stream_id": 9, "min": 0, "max": 1, "max_rate_of_change": 1}])).first().streams == [1, 2, 9]
    stats = health.Stats({"start_time_unix": 10.0, "now_unix": 20.0, "messages_processed": 30, "streams": [1, 2]})
    assert health.status(stats, 25.0) == {"uptime_s": 15.0, "messages_processed": 30, "msgs_per_sec": 3.0, "streams": [1, 2]}


def test_details_round_as_printf(spark):
    assert engine.score_detail(-0.00005, 2.00015) == "score=%.4f>thr=%.4f" % (0.00005, 2.00015) and engine.score_detail(0.12345, math.inf) == "score=0.1235>thr=inf"
    rng = np.random.default_rng(1)
    for x in np.round(rng.random(500), 5):
        assert engine.score_detail(x, x) == f"score={'%.4f' % x}>thr={'%.4f' % x}"


def test_long_streams_are_folded_batch_by_batch(spark):
    """The state is carried over many batches, several streams in one task, and only wanted detectors run."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        m = spark.range(400).select(F.col("id").alias("pos"), (F.col("id") * 7 % 3).alias("stream_id"), F.col("id").alias("ts_ns"), F.sin(F.col("id").cast("double")).alias("value"), F.col("id").alias("seq")).repartition(5)
        got = {r.pos: r for r in fold.detect(m, Profile(window=20)).collect()}
        sums = {r.stream_id: r.digest for r in fold.checksums(m).collect()}
        one = fold.detect(m, Profile(window=20), ("cusum",))
        assert one.columns == ["pos", "stream_id", "ts_ns", "value", "seq", "cusum_high", "cusum_low", "cusum_fired"] and one.count() == 400
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    for s in range(3):
        rows = [r for r in sorted(got.values(), key=lambda r: r.pos) if r.stream_id == s]
        columns = fold.run_detectors([r.value for r in rows], Profile(window=20), fold.new_state(Profile(window=20)))
        assert [tuple(r[5:]) for r in rows] == list(zip(*columns, strict=True))
        import struct

        from streamloom.functions.detectors import fnv1a

        assert sums[s] == f"{fnv1a(b''.join(struct.pack('<IqdQ', s, r.ts_ns, r.value, r.seq) for r in rows)):016x}"


def test_record_files(spark, tmp_path):
    path, bad = str(tmp_path / "a.trec"), str(tmp_path / "b.trec")
    m = spark.createDataFrame([(10 * i, i % 3, 1000 - i, 1.25 * i, i) for i in range(500)], M).repartition(7)
    assert trec.write_trec(m, path) == 500
    assert [tuple(r)[1:] for r in trec.read_trec(spark, path, 64).orderBy("pos").collect()] == [tuple(r)[1:] for r in m.orderBy("pos").collect()]
    assert trec.write_trec(m.limit(0), bad) == 0 and trec.read_trec(spark, bad).count() == 0
    for content, status in ((b"XXXX" + b"\1\0\0\0", "bad_magic"), (b"TREC" + b"\x0f\x27\0\0", "unsupported_version"), (b"TR", "bad_magic")):
        with open(bad, "wb") as f:
            f.write(content)
        assert trec.trec_status(bad)[0] == status and trec.read_trec(spark, bad, bad="empty").count() == 0
        with pytest.raises(Exception, match=status):
            trec.read_trec(spark, bad).count()


def test_faults_from_file_to_file(spark, tmp_path):
    paths = [str(tmp_path / x) for x in ("in.trec", "out.trec", "labels.txt")]
    base = [(i, 1 + i % 2, (1000 if i % 2 == 0 else 5000) + 10 * (i // 2), 10.0 + i // 2 if i % 2 == 0 else 100.0 + 2 * (i // 2), i // 2) for i in range(20)]
    trec.write_trec(spark.createDataFrame(base, M), paths[0])
    specs = [("spike", 1, 3, 1, 1000.0), ("dropout", 1, 5, 2, 0.0), ("spike", 2, None, 1, 7.0), ("drift", 2, None, 4, 8.0)]
    assert faults.inject_file(spark, *paths, specs, 0xABCDEF1234)
    again = tmp_path / "again.trec"
    assert faults.inject_file(spark, paths[0], str(again), str(tmp_path / "l2.txt"), specs, 0xABCDEF1234)
    assert again.read_bytes() == (tmp_path / "out.trec").read_bytes() and (tmp_path / "l2.txt").read_text() == (tmp_path / "labels.txt").read_text()
    rows = trec.read_trec(spark, paths[1]).collect()
    assert len(rows) == 18 and {r.value for r in rows if r.stream_id == 1 and r.seq == 3} == {1013.0}
    found = faults.read_label_file(spark, paths[2]).orderBy("label_idx").collect()
    assert [r.type for r in found] == ["spike", "dropout", "spike", "drift"] and (found[0].t_start_ns, found[1].t_end_ns) == (1030, 1060)
    from streamloom.functions.detectors import splitmix64

    draws = splitmix64(0xABCDEF1234)
    onsets = [next(draws) % 10, next(draws) % 7]  # 10 samples less the duration, and 1 more
    assert [found[2].t_start_ns, found[3].t_start_ns] == [5000 + 10 * k for k in onsets]
    assert not faults.inject_file(spark, str(tmp_path / "none"), *paths[1:], specs) and faults.read_label_file(spark, str(tmp_path / "none")).count() == 0


def test_run_of_a_file(spark, tmp_path):
    path, rule = str(tmp_path / "s.trec"), tmp_path / "r.yaml"
    trec.write_trec(spark.createDataFrame([(i, 1, (i + 1) * 10**9, 1000.0 if i == 25 else 50.0, i) for i in range(50)], M), path)
    rule.write_text("stream_id: 1\nmin: 45\nmax: 55\nmax_rate_of_change: 0.5\n")
    found, status = engine.run_file(spark, path, [str(rule)], Profile(0.05, 0.5, 0.5, 3.0, 1, 50, 0.01))
    rows = found.orderBy("id").collect()
    assert [(r.layer, r.detail) for r in rows if r.ts_ns == 26 * 10**9][0] == ("rules", "out_of_bounds") and [r.detail for r in rows if r.ts_ns == 27 * 10**9][0] == "rate_violation"
    assert tuple(status.first()) == (50, [1], 50 * 10**9, len(rows))


def test_evaluation_set(spark, tmp_path):
    rows = evaluation.cases(spark, str(tmp_path)).orderBy("case_idx").collect()
    assert len(rows) == 29 and (rows[0].ts_ns, rows[0].detail, rows[0].type) == (2 * 10**9, "score=4.2485>thr=0.0000", "false_alarm")
    counts = {}
    for r in rows:
        counts[r.layer, r.type] = counts.get((r.layer, r.type), 0) + 1
    assert counts == {("rules", "drift"): 10, ("conformal", "drift"): 8, ("cusum", "drift"): 4, ("rules", "spike"): 2, ("rules", "false_alarm"): 2, ("conformal", "false_alarm"): 1, ("conformal", "spike"): 1, ("cusum", "false_alarm"): 1}


def test_evaluating_a_model(spark, tmp_path):
    (tmp_path / "grid.md").write_text("# Grid")
    model = lambda brief, turns: json.dumps({"memo": {"hypothesis": "telemetry_glitch", "confidence": 0.5, "evidence": ["e"]}})
    scores = iter(['{"score": 1, "reason": "fine"}', "oops", '{"score": 0.5, "reason": "so"}'])
    got, text = evaluation.evaluate_model(spark, model, lambda brief, turns: next(scores), str(tmp_path), str(tmp_path), "grid", most_cases=4)
    assert got == {"accuracy": 0.75, "mean_judge": 0.375, "n": 4}  # a false alarm, then three alerts of the spike
    assert text.splitlines()[-1] == "accuracy 0.750, mean judge 0.375" and "2000000000/conformal" in text and len(text.splitlines()) == 10
    none = spark.createDataFrame([], "case_idx long, hypothesis string, judge double")
    assert evaluate.accuracy(evaluate.judged(none, spark.createDataFrame([], "case_idx long, type string"))).first().asDict() == {"accuracy": 0.0, "mean_judge": 0.0, "n": 0}


@pytest.mark.parametrize("n", [0, 1, 2, 999, 1001])
def test_order_statistics(spark, n):
    xs = np.random.default_rng(n).integers(0, 50, n).astype(float)
    shares = {"p50": 0.5, "p99": 0.99, "p999": 0.999, "all": 1.0}
    got = evaluate.order_statistics(spark.createDataFrame([(float(x),) for x in xs] + [(None,)], "x double").repartition(3), "x", shares).first().asDict()
    assert got == {k: sorted(xs)[int(q * (n - 1))] if n else None for k, q in shares.items()}


def test_shifted_streams(spark):
    rng = np.random.default_rng(12345)
    step, drift = rng.normal(0, 1, 1000), rng.normal(0, 1, 1000)
    step[400:] += 3.0
    drift[400:] += 0.05 * np.arange(600)
    assert [r.value for r in synthetic.shifted(spark, 1000, 12345, 400, step=3.0).orderBy("pos").collect()] == step.tolist()
    assert [r.value for r in synthetic.shifted(spark, 1000, 12345, 400, slope=0.05, skip=1000).orderBy("pos").collect()] == drift.tolist()


def test_adapters(spark, log):
    from streamloom.sources.adapters import Aircraft, Grid, Ticker

    raw = spark.createDataFrame(log, "pos long, raw string, is_reset boolean")
    ticker = Ticker(spark.createDataFrame([("P1", 1), ("P2", 2)], "product_id string, stream_id long"))
    polls = [[0, 1, 2], [1, 2, 3], [3], [9, "x", 10]]
    poll = lambda ts: json.dumps({"data": [{"ts": f"2026-01-01T00:00:{t:02}Z", "value": 50 + t} if isinstance(t, int) else {"ts": "?", "value": 1} for t in ts]})
    grid = spark.createDataFrame([(i, poll(ts)) for i, ts in enumerate(polls)], "pos long, raw string")
    snaps = spark.createDataFrame([(0, json.dumps({"now": 1000, "ac": [{"hex": "a", "lat": 1, "lon": 1, "seen": 0, "gs": 400}]}))], "pos long, raw string")
    for adapter, frames_ in ((ticker, raw), (Grid(7), grid), (Aircraft(100, 5, "gs"), snaps)):
        assert adapter.messages(frames_).columns == ["pos", "stream_id", "ts_ns", "value", "seq"] and adapter.messages(frames_).count() > 0
    assert ticker.gaps(raw).count() > 0 and Aircraft(100, 5).gaps(snaps).count() == 0
    assert [(r.value, r.seq) for r in Grid(7).messages(grid).orderBy("seq").collect()] == [(50.0, 1), (51.0, 2), (52.0, 3), (53.0, 4), (59.0, 5), (60.0, 6)]
    assert [(r.to_ts - r.from_ts) // 10**9 for r in Grid(7).gaps(grid).collect()] == [6]


def test_alert_table(spark, tmp_path):
    from streamloom.sources import sinks

    a = spark.createDataFrame([(i, 1, i, "rules", "x") for i in (1, 2, 3)], "id long, stream_id long, ts_ns long, layer string, detail string")
    path = str(tmp_path / "alerts")
    assert [sinks.insert_alerts(x, path) for x in (a, a, a.limit(0), a)] == [3, 6, 6, 9]
    rows = spark.read.parquet(path).orderBy("id").collect()
    assert [r.id for r in rows] == list(range(1, 10)) and all(len(r.created_at) == 24 and r.created_at[-5] == "." for r in rows)


def test_service_writes_counters_and_stops(spark, tmp_path):
    import threading

    from streamloom.streaming.service import serve

    spark.range(5).write.parquet(str(tmp_path / "in"))
    q = spark.readStream.schema("id long").parquet(str(tmp_path / "in")).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    stop = threading.Event()
    threading.Timer(1.0, stop.set).start()
    last = serve(q, str(tmp_path / "stats.json"), lambda: {"alerts": 2}, 0.2, stop)
    assert not q.isActive and (last["messages_received"], last["alerts"]) == (5, 2)
    assert health.read_stats(str(tmp_path / "stats.json"))["messages_received"] == 5


def test_evaluation_from_the_command_line(spark, tmp_path, capsys):
    (tmp_path / "grid.md").write_text("# Grid")
    memo = json.dumps({"memo": {"hypothesis": "generation_loss", "confidence": 1, "evidence": []}})
    (tmp_path / "replies").write_text(f"oops\n{memo}\n" + f"{memo}\n" * 28)
    (tmp_path / "judge").write_text('{"score": 0.5, "reason": "r"}\n' * 29)
    assert evaluation.main(["--replies", str(tmp_path / "replies"), "--judge", str(tmp_path / "judge"), "--cards", str(tmp_path), "--folder", str(tmp_path), "--domain", "grid"]) == 0
    said = capsys.readouterr().out
    assert said.startswith("seed 1234, 29 cases") and said.endswith("accuracy 0.759, mean judge 0.500\n")  # 22 of 29 alerts are the drift's


def test_polls_keep_every_event_in_order_of_arrival(spark, tmp_path):
    from datetime import datetime, timedelta

    from streamloom.plans import queries

    start = datetime(2024, 1, 1)  # times that repeat, stand still and go back, within a poll and across polls
    events = [(i, start + timedelta(microseconds=1000 * (i % 12 // 2)), 0, "view", 50.0 - i) for i in range(36)]
    spark.createDataFrame(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double").write.parquet(str(tmp_path / "events.parquet"))
    rows = queries.QUERIES["json_polls"](spark, str(tmp_path)).orderBy("seq").collect()
    assert [tuple(r) for r in rows] == [(7, 1_704_067_200_000_000_000 + 1_000_000 * (i % 12 // 2), 50.0 - i, i + 1) for i in range(36)]
