"""Detection quality on seeded streams, and the changepoint posterior against its closed form."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from streamloom.functions.changepoint import Changepoints, RunLengths
from streamloom.functions.detectors import fixed_cusum, splitmix64
from streamloom.operators import evaluate, faults, fold
from streamloom.operators.fold import Profile
from streamloom.sources import synthetic


def numpy_streams():
    rng = np.random.default_rng(12345)
    step, drift = rng.normal(0, 1, 1000), rng.normal(0, 1, 1000)
    step[400:] += 3.0
    drift[400:] += 0.05 * np.arange(600)
    return step.tolist(), drift.tolist()


def fires(xs, **options):
    d = Changepoints(**options)
    return [t for t, x in enumerate(xs) if d.check(x)[2]]


def test_draws_by_place_are_the_sequence():
    draws = splitmix64(42)
    assert synthetic.unit_draws(42, np.arange(5)).tolist() == [(next(draws) >> 11) / 2**53 for _ in range(5)]


def test_delays_of_both_changepoint_detectors():
    step, drift = numpy_streams()
    assert fires(step)[0] == 400 and fires(drift)[0] == 434
    assert fixed_cusum(step)[:2] == [318, 400] and [t for t in fixed_cusum(drift) if t >= 400][0] == 428
    assert fires(np.random.default_rng(12346).normal(0, 1, 800).tolist()) == []


def test_posterior_is_the_closed_form():
    xs, h = [0.1, -0.4, 3.0, 2.8, 3.1, -5.0, 0.0, 0.2, 0.1], 1 / 20
    mu0, k0, a0, b0 = 0.5, 2.0, 1.5, 0.7

    def evidence(part):
        n, mean = len(part), sum(part) / len(part)
        b = b0 + 0.5 * sum((x - mean) ** 2 for x in part) + k0 * n * (mean - mu0) ** 2 / (2 * (k0 + n))
        return math.exp(math.lgamma(a0 + n / 2) - math.lgamma(a0) + a0 * math.log(b0) - (a0 + n / 2) * math.log(b) + 0.5 * math.log(k0 / (k0 + n)) - n / 2 * math.log(2 * math.pi))

    runs, fresh = RunLengths(20, mu0, k0, a0, b0, least=0.0), [1.0]
    for t, x in enumerate(xs, 1):
        runs.update(x)
        fresh.append(sum(h * fresh[s] * evidence(xs[s:t]) * (1 - h) ** (t - s - 1) for s in range(t)))
        want = [fresh[t]] + [fresh[t - r] * evidence(xs[t - r : t]) * (1 - h) ** r for r in range(1, t + 1)]
        assert runs.probs == pytest.approx(np.array(want) / sum(want), rel=1e-9)
        assert runs.recent(2) == pytest.approx(sum(want[:3]) / sum(want))


def test_posterior_survives_what_it_cannot_weigh():
    runs = RunLengths()
    for x in (1.0, math.nan, math.inf, 2.0):
        runs.update(x)
        assert runs.probs.sum() == pytest.approx(1)
    assert runs.lengths.tolist() == [0, 1]
    with pytest.raises(ValueError):
        RunLengths(1.0)


def test_changepoints_of_streams(spark):
    step, drift = numpy_streams()
    rows = [(t, k, t, x, t) for k, xs in enumerate((step, drift)) for t, x in enumerate(xs)]
    m = spark.createDataFrame(rows, "pos long, stream_id long, ts_ns long, value double, seq long").repartition(3)
    first = fold.changepoints(m).filter("fired").groupBy("stream_id").agg(F.min("pos")).orderBy("stream_id").collect()
    assert [tuple(r) for r in first] == [(0, 400), (1, 434)]
    assert fold.changepoints(m.limit(0)).count() == 0


def test_drift_delay(spark):
    bad, labels = faults.inject(synthetic.uniform_noise(spark, 2000, 12345), [("drift", 1, 1000, 300, 5.0)], 999)
    assert labels.first().t_start_ns == 10**9
    found = fold.detect(bad, Profile(cusum_alpha=0.01, cusum_k=3.0, cusum_h=8.0, warmup=50)).filter("cusum_fired").select("stream_id", F.col("pos").alias("j"))
    assert tuple(evaluate.detection_score(found, 1000).first()) == (1, 1012, 12, 0)
    assert [r.j for r in found.orderBy("j").take(2)] == [1012, 1019]


@pytest.mark.parametrize(("alpha", "rate"), [(0.01, 0.01158), (0.05, 0.05184)])
def test_false_alarm_rate(spark, alpha, rate):
    m = synthetic.near_gaussian(spark, 52_000, 0xC0FFEE1234, stream_id=7)
    seen = fold.detect(m, Profile(ewma_alpha=0.02, window=500, conformal_alpha=alpha)).filter("pos >= 2000")
    assert seen.agg(F.avg(F.col("anomalous").cast("double"))).first()[0] == pytest.approx(rate, abs=1e-12)
