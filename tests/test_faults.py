from streamloom.operators import faults

M = "pos long, stream_id long, ts_ns long, value double, seq long"


def test_no_faults_and_faults_that_miss(spark):
    m = spark.createDataFrame([(i, 1, i, float(i), i) for i in range(6)], M)
    for specs in ([], [("spike", 2, 0, 3, 1.0), ("drift", 1, 6, 2, 1.0), ("spike", 1, 0, 0, 1.0)]):
        out, labels = faults.inject(m, specs)
        assert sorted(map(tuple, out.collect())) == sorted(map(tuple, m.collect())) and labels.count() == 0


def test_faults_that_overlap_over_the_end(spark):
    m = spark.createDataFrame([(i, 1, 10 * i, float(i), i) for i in range(6)], M)
    out, labels = faults.inject(m, [("spike", 1, 1, 3, 100.0), ("stuck_at_value", 1, 2, 1, 0.0), ("drift", 1, 4, 4, 8.0), ("dropout", 1, 0, 1, 0.0)])
    assert [(r.pos, r.value, r.seq) for r in out.orderBy("pos").collect()] == [(1, 101.0, 1), (2, 2.0, 2), (3, 103.0, 3), (4, 6.0, 4), (5, 9.0, 5)]
    assert [tuple(r) for r in labels.orderBy("label_idx").collect()] == [(0, 1, "spike", 10, 30), (1, 1, "stuck_at_value", 20, 20), (2, 1, "drift", 40, 50), (3, 1, "dropout", 0, 0)]
