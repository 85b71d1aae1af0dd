import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from citegrain.operators import logs
from citegrain.plans.percentiles import value_bin, value_profile

FEW = settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
VALUES = st.floats(-1e6, 1e6, allow_nan=False).map(lambda x: round(x, 3))


@FEW
@given(st.lists(st.tuples(st.sampled_from("ab"), VALUES), min_size=1, max_size=60))
def test_equals_linear_interpolation(spark, rows):
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in value_profile(df, "v", (0, 50, 95, 100), ["g"]).collect()}
    for g in {r[0] for r in rows}:
        values = [v for k, v in rows if k == g]
        want = np.percentile(values, [0, 50, 95, 100])
        assert got[g].total == len(values)
        assert [got[g][c] for c in ("p0", "p50", "p95", "p100")] == pytest.approx(list(want), rel=1e-9, abs=1e-9)
        assert got[g].value_sum == pytest.approx(sum(values), rel=1e-9, abs=1e-6)


def test_hot_group_and_weights(spark):
    rng = np.random.default_rng(3)
    values = np.round(rng.lognormal(5, 2, 20000), 3)
    rows = [("hot" if i % 3 else f"g{i % 50}", float(v), int(v) % 4 + 1) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "g string, v double, w int").repartition(8)
    got = value_profile(df, "v", (50, 95), ["g"], weight="w")
    for r in got.collect():
        copies = np.repeat([v for g, v, _ in rows if g == r.g], [w for g, _, w in rows if g == r.g])
        assert r.total == len(copies)
        assert [r.p50, r.p95] == pytest.approx(list(np.percentile(copies, [50, 95])))


def test_one_crowded_bin(spark):
    """All values within a thousandth of each other, and within a billionth."""
    rng = np.random.default_rng(5)
    for width in (1e-4, 1e-11):
        values = 1000.0 * (1 + rng.random(5000) * width)
        df = spark.createDataFrame([(float(v), i) for i, v in enumerate(values)], "v double, t int")
        row = value_profile(df, "v", (0, 50, 95, 100), spread="t").first()
        assert [row.p0, row.p50, row.p95, row.p100] == pytest.approx(list(np.percentile(values, [0, 50, 95, 100])), rel=1e-15)
        assert (row.spread_min, row.spread_max) == (0, 4999)


def test_empty_log_gives_zeros(spark):
    log = spark.createDataFrame(
        [], "event_id long, ts timestamp, endpoint string, status_code long, latency_ms double, cache_hit boolean"
    )
    assert tuple(value_profile(log, "latency_ms", (50,)).first()) == (0, 0, 0.0, 0.0)
    assert all(v == 0 for v in logs.log_summary(log).first())
    assert logs.latency_stats(log).first().p95_latency_ms == 0.0
    assert logs.latency_stats(log, ["endpoint"]).count() == 0
    with pytest.raises(Exception, match="no log rows"):
        logs.slo_check(log).collect()
    assert logs.slo_check(log, ["endpoint"]).count() == 0


def test_bins_never_fall(spark):
    values = sorted([0.0, -0.0, 1e-320, -1e300, 1e300, 0.999999, 1.0, 1.0000001, 2.0, float("inf"), -5.5, 1023.9999, 1024.0])
    df = spark.createDataFrame([(v,) for v in values], "v double")
    bins = [r[0] for r in df.select(value_bin(df.v)).collect()]
    assert bins == sorted(bins) and None not in bins


def test_small_log_by_hand(spark):
    log = spark.createDataFrame([(1.0, 200), (2.0, 200), (3.0, 500), (10.0, 200)], "latency_ms double, status_code long")
    row = logs.slo_check(log, max_error_rate=0.25, max_p95_ms=8.95).first()
    assert row.p95_ms == pytest.approx(8.95) and row.error_rate == 0.25 and row.pass_error
    near = logs.approximate_latency_stats(log).first()
    assert near.requests == 4 and near.avg_latency_ms == 4.0 and near.p50_latency_ms in (2.0, 3.0)
