"""The alert tail, the counters file and triage."""

import json

import pytest

from streamloom.plans import health, triage
from streamloom.sources import alert_tail, synthetic


def line(i, **more):
    return json.dumps({"stream_id": 1, "ts_ns": i, "layer": "rules", "detail": "é" * (i % 5), "created_at": "now"} | more) + "\n"


def test_ranges_meet_every_line_once(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    assert alert_tail.read_alerts(spark, str(path)).count() == 0
    path.write_text("".join(line(i) for i in range(40)) + "{oops\n\n[]\n" + line(40, ts_ns="x") + line(41, ts_ns=2**70) + line(42) + line(43)[:-1])
    want = [*range(40), 42]
    for size in (1, 7, 64, 97, 10**6):
        parts = alert_tail.ranges(0, alert_tail.whole_lines(str(path)), size)
        assert [r[2] for p in parts for r in alert_tail.read_range(str(path), p)] == want
    rows = alert_tail.read_alerts(spark, str(path), 100).orderBy("pos").collect()
    assert [r.ts_ns for r in rows] == want and rows[4].detail == "éééé"


def test_last_line_end_is_found_over_blocks(tmp_path):
    path = tmp_path / "a"
    path.write_bytes(b"ab\n" + b"x" * (3 * alert_tail.BLOCK))
    assert alert_tail.whole_lines(str(path)) == 3
    path.write_bytes(b"x" * 10)
    assert alert_tail.whole_lines(str(path)) == 0


def test_tail_resumes_without_repeats(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    path.write_text(line(0) + line(1) + line(2)[:9])

    def drain():
        q = alert_tail.tail_alerts(spark, str(path), 50).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).start()
        try:
            q.processAllAvailable()
        finally:
            q.stop()
        return [r.ts_ns for r in spark.read.parquet(str(tmp_path / "out")).orderBy("pos").collect()]

    assert drain() == [0, 1]
    with path.open("a") as f:
        f.write(line(2)[9:] + line(3))
    assert drain() == [0, 1, 2, 3]
    assert drain() == [0, 1, 2, 3]


def test_counters_and_health(tmp_path):
    path = str(tmp_path / "stats.json")
    assert health.health(health.read_stats(path), 100.0) == (503, {"uptime_seconds": 0.0, "total_messages_processed": 0, "last_message_timestamp": None})
    health.write_stats(path, {"start_time_unix": 100.0, "now_unix": 110.0, "messages_processed": 50, "streams": [1, 2], "last_message_unix_ms": 105_500})
    s = health.read_stats(path)
    assert (s.per_second, s.streams, s.last_message) == (5.0, [1, 2], 105.5)
    assert health.health(s, 130.0) == (200, {"uptime_seconds": 30.0, "total_messages_processed": 50, "last_message_timestamp": "1970-01-01T00:01:45.500000Z"})
    health.write_stats(path, {"start_time_unix": 100.0})
    assert health.read_stats(path).last_message is None and [p.name for p in tmp_path.iterdir()] == ["stats.json"]


MEMO = {"hypothesis": "spike", "confidence": 0.9, "evidence": ["a"]}
TOOLS = {"get_domain_card": lambda domain: "card of " + domain, "add": lambda a, b: a + b}


def run(*replies, turns=3, seen=None):
    model = triage.scripted(replies)

    def watched(brief, said):
        if seen is not None:
            seen[:] = [brief, *(t["content"] for t in said)]
        return model(brief, said)

    return triage.investigate(watched, TOOLS, {"stream_id": 4}, "grid", {"spike", "drift"}, turns)


def test_triage_calls_tools_then_concludes():
    seen = []
    assert run('{"tool":"add","args":{"a":1,"b":2}}', '{"tool":"add","args":{"c":1}}', json.dumps({"memo": MEMO}), seen=seen) == {"stream_id": 4, **MEMO}
    assert "card of grid" in seen[0] and '"result": 3' in seen[3] and "TypeError" in seen[5]


def test_triage_ends_without_a_conclusion():
    assert run("x", "[1]")["evidence"] == ["malformed_llm_response"]
    assert run("x", json.dumps({"memo": MEMO}), turns=1)["hypothesis"] == "spike"
    call = '{"tool":"add","args":{"a":1,"b":2}}'
    assert run(call, call, turns=2) == {"stream_id": 4, "hypothesis": "no_conclusion", "confidence": 0.0, "evidence": ["max_turns_exceeded"]}
    assert run('{"tool":"none"}', '{"tool":["add"]}')["evidence"] == ["malformed_llm_response"]


def test_triage_keeps_unlisted_hypotheses_as_evidence():
    got = run(json.dumps({"memo": MEMO | {"hypothesis": "ghosts"}}))
    assert (got["hypothesis"], got["evidence"]) == ("unknown", ["a", "original_hypothesis:ghosts"])
    assert run('{"memo":{}}') == {"stream_id": 4, "hypothesis": "unknown", "confidence": 0.0, "evidence": []}


def test_code_fences():
    assert triage.unfenced('```json\n{"a":1}\n```') == '{"a":1}' and triage.unfenced(" x ") == "x" and triage.unfenced("```\nx") == "x" and triage.unfenced("```") == ""


def test_evidence_tools(spark, tmp_path):
    m = synthetic.constant(spark, 10)
    alerts = spark.createDataFrame([(1, 1, 2 * 10**9, "rules", "x"), (2, 1, 9 * 10**9, "rules", "y")], "id long, stream_id long, ts_ns long, layer string, detail string")
    e = triage.Evidence(m, alerts, str(tmp_path), "grid", 10**9, 0.5)
    assert [w["ts_ns"] for w in e.get_window(1, 10**9, 3 * 10**9)] == [10**9, 2 * 10**9, 3 * 10**9]
    assert e.get_baseline(1) == {"mean": 37.5, "variance": 0.5 * 1250 + 0.5 * 625}
    assert e.get_baseline(2) == {"mean": 0.0, "variance": 0.0}
    assert [a["id"] for a in e.get_concurrent_alerts(10**9, 10**9)] == [1]
    with pytest.raises(triage.DomainCardNotFoundError, match="grid"):
        e.get_domain_card()
    (tmp_path / "grid.md").write_text("# Grid")
    assert e.tools()["get_domain_card"]() == "# Grid"
