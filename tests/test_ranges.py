"""Order statistics over ranges against sorting, and frames of a busy hour."""

import math
import statistics
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spanquarry.operators import ranges, windows


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 0.5, 0.25, -3.0, 7.5, 1e9]) | st.floats(-5, 5), min_size=1, max_size=40), st.data())
def test_ranges_against_sorting(values, data):
    x = np.array(values)
    low = data.draw(st.integers(0, len(x) - 1))
    high = data.draw(st.integers(low + 1, len(x)))
    part, m = np.sort(x[low:high]), data.draw(st.sampled_from(values))
    found, one = ranges.Ranges(x), lambda v: np.array([v])
    off = np.sort(np.abs(part - m))
    for k in range(high - low):
        assert found.kth(one(low), one(high), one(k))[0] == part[k]
        assert found.kth_off(one(low), one(high), one(m), one(k))[0] == off[k]
    assert found.below(one(low), one(high), one(m))[0] == (part < m).sum() and found.below(one(low), one(high), one(1e12))[0] == len(part)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0]), min_size=1, max_size=30) | st.lists(st.floats(0, 1), min_size=1, max_size=30))
def test_spreads_against_statistics(values):
    x, n = np.array(values), len(values)
    low, high = np.maximum(np.arange(n + 1) - 7, 0), np.arange(n + 1)
    got = ranges.frame_spreads(x, low, high)
    for i in range(n + 1):
        v = values[low[i] : high[i]]
        upper = sorted(v)[len(v) // 2] if v else 0
        sigma = max(statistics.stdev(v), 1.4826 * sorted(abs(a - upper) for a in v)[len(v) // 2]) if len(v) > 1 else 0
        robust = max(1e-6, statistics.pstdev(v), 1.4826 * statistics.median([abs(a - statistics.median(v)) for a in v])) if v else 1e-6
        assert got["mean"][i] == pytest.approx(statistics.fmean(v) if v else 0, abs=1e-12)
        assert got["sigma"][i] == pytest.approx(sigma, abs=1e-7) and got["robust"][i] == pytest.approx(robust, abs=1e-7)


def busy(spark, n):
    return spark.range(n).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 7, "0")).alias("trace_id"), (F.col("id") * 3600 / n).cast("long").alias("sec"), (F.col("id") * 3_600_000_000_000 / n).cast("long").alias("start_ns"), (F.col("id") % 7 == 0).alias("has_error"), F.rand(3).alias("latency"))


def test_a_busy_hour_takes_no_square_of_its_traces(spark):
    began = time.time()
    got = windows.lookback_sigmas(busy(spark, 40_000), 3600, {"error": F.col("has_error").cast("int"), "lat": F.col("latency")})
    assert got.agg(F.max("n")).first()[0] == 39_999 and time.time() - began < 60


def test_frames_against_loops(spark):
    rows = spark.createDataFrame([(f"t{k:03d}", s, s * 10**9 + k % 3, k % 4 == 0, float(k % 5)) for k, s in enumerate(sorted((k * k * 37) % 9000 for k in range(300)))], "trace_id string, sec long, start_ns long, has_error boolean, latency double")
    plain = rows.collect()
    before = {a.trace_id: [b for b in plain if b.sec > a.sec - 3600 and (b.start_ns, b.trace_id) < (a.start_ns, a.trace_id)] for a in plain}
    for r in windows.lookback_stats(rows, 3600, {"lat": F.col("latency")}).collect():
        v = [b.latency for b in before[r.trace_id]]
        assert r.n == len(v) and r.lat_mean == pytest.approx(statistics.fmean(v) if v else 0, abs=1e-9) and r.lat_std == pytest.approx(statistics.pstdev(v) if len(v) > 1 else 0, abs=1e-6)
    for r in windows.lookback_sigmas(rows, 3600, {"lat": F.col("latency")}).collect():
        v = [b.latency for b in before[r.trace_id]]
        assert r.n == len(v) and r.lat_mean == pytest.approx(statistics.fmean(v) if v else 0, abs=1e-9)
    density = {r.trace_id: r.density for r in windows.local_density(rows, 1800).collect()}
    for a in plain:
        near = [b.has_error for b in plain if abs(b.sec - a.sec) <= 1800]
        assert density[a.trace_id] == pytest.approx(sum(near) / len(near))
    assert windows.lookback_sigmas(rows.limit(0), 3600, {"lat": F.col("latency")}).count() == 0 and windows.local_density(rows.limit(0), 5).count() == 0


def test_flags_are_ranges_of_zeros_and_ones():
    x = (np.arange(60) * 7 % 5 < 2).astype(float)
    low, high = (v.ravel() for v in np.meshgrid(np.arange(60), np.arange(1, 61)))
    low, high = low[low < high], high[low < high]
    flags, found = ranges.Flags(x), ranges.Ranges(x)
    for k in ((high - low - 1) // 2, (high - low) // 2):
        assert (flags.kth(low, high, k) == found.kth(low, high, k)).all()
        for centre in (0.0, 0.5, 1.0):
            for a, b in zip(flags.two_off(low, high, np.full(len(low), centre), k), found.two_off(low, high, np.full(len(low), centre), k), strict=True):
                assert (a == b).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from([0.0, 1.0, 0.5, 0.25]) | st.floats(-5, 5), min_size=2, max_size=30), st.integers(0, 28), st.sampled_from([0.0, 0.4, 3.0]))
def test_the_distance_after_the_kth(values, k, centre):
    one = lambda v: np.array([v])
    k, off = min(k, len(values) - 1), sorted(abs(v - centre) for v in values) + [math.inf]
    assert [float(v[0]) for v in ranges.Ranges(np.array(values)).two_off(one(0), one(len(values)), one(centre), one(k))] == off[k : k + 2]
