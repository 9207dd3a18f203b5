"""Cleaning and gap filling against plain Python restatements, for several slice lengths."""

import datetime as dt
import math
import statistics

import pytest
from helpers import DAY, HOUR, SCHEMA, START, at, close, frame, masked, runs, same, values
from pyspark.sql import functions as F

from tidewell.operators import clean, impute, resample

SPANS = [6 * HOUR, DAY, None]
SERIES = {("a", "x"): masked(120, 3), ("a", "y"): masked(75, 4, 0.6, 9), ("b", "x"): masked(30, 5), ("c", "x"): [None, None, 3.0, None]}


def linear(vs, i):
    before = [j for j in range(i) if vs[j] is not None]
    after = [j for j in range(i + 1, len(vs)) if vs[j] is not None]
    if not before:
        return None
    if not after:
        return vs[before[-1]]
    p, n = before[-1], after[0]
    return vs[p] + (vs[n] - vs[p]) * (i - p) / (n - p)


def filled(vs, fn, max_thr=-1):
    out = list(vs)
    thr = len(vs) if max_thr == -1 else max_thr
    for a, z in runs(vs, True):
        if z - a + 1 >= 2 * (thr // 2) - 1:
            continue
        for i in range(a, z + 1):
            out[i] = fn(vs, i)
    return out


def pad(vs, i):
    return next((vs[j] for j in range(i, -1, -1) if vs[j] is not None), None)


def nearest(vs, i):
    before = [j for j in range(i) if vs[j] is not None]
    after = [j for j in range(i + 1, len(vs)) if vs[j] is not None]
    if not after or (before and i - before[-1] <= after[0] - i):
        return vs[before[-1]] if before and after else None
    return vs[after[0]] if before else None


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("method,fn", [("linear", linear), ("time", linear), ("pad", pad)])
@pytest.mark.parametrize("max_thr", [-1, 2, 5, 8])
def test_impute(spark, span, method, fn, max_thr):
    got = values(impute.impute(frame(spark, SERIES), "1h", method, max_thr, span))
    same(got, {k: filled(vs, fn, max_thr) for k, vs in SERIES.items()})


@pytest.mark.parametrize("span", SPANS)
def test_nearest(spark, span):
    got = values(impute.impute(frame(spark, SERIES), "1h", "nearest", -1, span))
    for k, vs in SERIES.items():
        want = filled(vs, nearest)
        known = [i for i, v in enumerate(vs) if v is not None]
        for i in range(known[0], known[-1] + 1):
            assert close(got[k][i], want[i]), (k, i)
        assert all(v is None for v in got[k][: known[0]] + got[k][known[-1] + 1 :])


def test_none_is_identity(spark):
    d = frame(spark, SERIES)
    same(values(impute.impute(d, "1h", "none")), SERIES)
    with pytest.raises(ValueError):
        impute.impute(d, "1h", "magic")


@pytest.mark.parametrize("span", SPANS)
def test_gap_profile_and_ranges(spark, span):
    d = frame(spark, SERIES)
    got = {(r["ts_id"], r["id"], r["ts"]): (r["run_start"], r["run_len"], r["distance"]) for r in impute.gap_profile(d, "1h", span).collect()}
    want, ranges = {}, set()
    for k, vs in SERIES.items():
        for a, z in runs(vs, True):
            ranges.add((*k, at(a), at(z), z - a + 1))
            for i in range(a, z + 1):
                want[(*k, at(i))] = (at(a), z - a + 1, min(i - a, z - i) + 1)
    assert got == want
    assert {tuple(r) for r in impute.null_ranges(d, "1h", span).collect()} == ranges


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("m", [1, 3, 24])
def test_short_islands(spark, span, m):
    want = {}
    for k, vs in SERIES.items():
        want[k] = list(vs)
        for a, z in runs(vs, False):
            if z - a + 1 <= m:
                want[k][a : z + 1] = [None] * (z - a + 1)
    d = frame(spark, SERIES)
    same(values(clean.remove_short_islands(d, "1h", m, span)), want)
    lost = sum(a is not None and b is None for k in want for a, b in zip(SERIES[k], want[k]))
    assert clean.short_island_report(d, "1h", m, span).count() == lost


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("keep", [True, False])
def test_grid(spark, span, keep):
    rows, want = [], {}
    for k, vs in SERIES.items():
        known = [i for i, v in enumerate(vs) if v is not None]
        rows += [(*k, at(i), vs[i]) for i in known]
        rows += [(*k, at(known[0]) + dt.timedelta(minutes=90), -1.0)] if len(known) > 3 else []
        want[k] = {at(i): vs[i] for i in range(known[0], known[-1] + 1)}
    out = clean.to_grid(spark.createDataFrame(rows, SCHEMA), "1h", span, keep)
    assert ("slice" in out.columns) == keep
    got: dict = {}
    for r in out.collect():
        assert r["ts"] not in got.setdefault((r["ts_id"], r["id"]), {})
        got[(r["ts_id"], r["id"])][r["ts"]] = r["value"]
    assert got == want


def test_grid_keeps_fractions_of_a_second_apart(spark):
    half = dt.timedelta(milliseconds=500)
    rows = [("a", "x", START + half, 1.0), ("a", "x", at(1), 2.0), ("a", "x", at(2) + half, 3.0), ("a", "x", at(3) + half, 4.0)]
    got = clean.to_grid(spark.createDataFrame(rows, SCHEMA), "1h").orderBy("ts").collect()
    assert [(r["ts"], r["value"]) for r in got] == [(START + half, 1.0), (at(1) + half, None), (at(2) + half, 3.0), (at(3) + half, 4.0)]


def test_grid_over_a_gap_longer_than_slices(spark):
    rows = [("a", "x", at(0), 1.0), ("a", "x", at(5000), 2.0)]
    out = clean.to_grid(spark.createDataFrame(rows, SCHEMA), "1h", 100 * HOUR)
    assert out.count() == 5001
    assert sorted(r["ts"] for r in out.filter("value is not null").collect()) == [at(0), at(5000)]


def test_outliers_by_month(spark):
    vs = [10.0 + (i % 5) for i in range(24 * 40)]
    vs[100], vs[500] = 1000.0, -900.0
    d = frame(spark, {("a", "x"): vs})
    report = {r["ts"]: r["value"] for r in clean.outlier_report(d, 4.5).collect()}
    assert report == {at(100): 1000.0, at(500): -900.0}
    got = values(clean.remove_outliers(d, "1h", 4.5))[("a", "x")]
    assert got == [None if i in (100, 500) else v for i, v in enumerate(vs)]


def test_outer_outliers_are_trimmed(spark):
    vs = [500.0] + [10.0 + (i % 3) for i in range(200)] + [-500.0]
    out = clean.remove_outliers(frame(spark, {("a", "x"): vs}), "1h", 4.5).agg(F.min("ts"), F.max("ts")).first()
    assert tuple(out) == (at(1), at(200))


@pytest.mark.parametrize("span", SPANS)
def test_post_gap_spikes(spark, span):
    vs = [1.0, 2.0, None, 0.0, 3.0, None, None, 50.0, 4.0, None, 5.0] * 5
    got = values(clean.remove_post_gap_spikes(frame(spark, {("a", "x"): vs}), "1h", 0.9, span))[("a", "x")]
    want = [None if v in (0.0, 50.0) else v for v in vs]
    assert got == want


def test_dedup_and_common_span(spark):
    rows = [("a", "x", at(0), 1.0, 2), ("a", "x", at(0), 9.0, 1), ("a", "x", at(1), None, 3), ("a", "x", at(1), 5.0, 4)]
    d = spark.createDataFrame(rows, SCHEMA + ", row_id bigint")
    assert values(clean.dedup_first(d)) == {("a", "x"): [9.0, None]}
    d = frame(spark, {("a", "x"): [1.0] * 9}).union(frame(spark, {("a", "y"): [2.0] * 5}))
    got = clean.cut_common_span(d).groupBy("id").agg(F.max("ts"), F.count("*")).collect()
    assert {tuple(r) for r in got} == {("x", at(4), 5), ("y", at(4), 5)}


def test_local_time_repeats_the_autumn_hour(spark):
    rows = [("GR", "GR", dt.datetime(2023, 10, 29, h), float(h)) for h in range(4)]
    d = spark.createDataFrame(rows, SCHEMA)
    zones = spark.createDataFrame([("GR", "Europe/Athens"), ("PT", "Europe/Lisbon")], "country string, tz string")
    local = clean.to_local(d, zones)
    assert [r["ts"].hour for r in local.orderBy("utc_ts").collect()] == [3, 3, 4, 5]
    kept = clean.dedup_first(local, "utc_ts").orderBy("ts").collect()
    assert [(r["ts"].hour, r["value"]) for r in kept] == [(3, 0.0), (4, 2.0), (5, 3.0)]
    other = d.withColumn("id", F.lit("nowhere"))
    assert [r["ts"].hour for r in clean.to_local(other, zones, "PT").orderBy("ts").collect()] == [1, 1, 2, 3]
    assert [r["ts"].hour for r in clean.to_local(other, zones).orderBy("ts").collect()] == [0, 1, 2, 3]


def test_resample_anchors_at_midnight(spark):
    vs = [float(i) if i % 4 else None for i in range(40)]
    d = frame(spark, {("a", "x"): vs})  # starts at 05:00
    for method, fn in {
        "averaging": lambda b: statistics.mean([v for v in b if v is not None]) if any(v is not None for v in b) else None,
        "summation": lambda b: None if None in b else sum(b),
        "downsampling": lambda b: next((v for v in b if v is not None), None),
    }.items():
        for res in ("6h", "7h"):
            n = int(res[0])
            bins: dict = {}
            for i, v in enumerate(vs):
                midnight = START.replace(hour=0)
                bins.setdefault(midnight + dt.timedelta(hours=(5 + i) // n * n), []).append(v)
            got = {r["ts"]: r["value"] for r in resample.resample(d, res, method).collect()}
            assert got.keys() == bins.keys()
            assert all(close(got[t], fn(b)) for t, b in bins.items()), (method, res)


def hermite(x, h, y0, y1, d0, d1):
    t = x / h
    return (
        (2 * t**3 - 3 * t**2 + 1) * y0 + (t**3 - 2 * t**2 + t) * h * d0 + (3 * t**2 - 2 * t**3) * y1 + (t**3 - t**2) * h * d1
    )


def pchip_slopes(x, y):
    h = [b - a for a, b in zip(x, x[1:])]
    m = [(b - a) / w for a, b, w in zip(y, y[1:], h)]
    sign = lambda v: (v > 0) - (v < 0)
    if len(m) == 1:
        return [m[0], m[0]]

    def end(h0, h1, d0, d1):
        s = ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)
        if sign(s) != sign(d0):
            return 0.0
        return 3 * d0 if sign(d0) != sign(d1) and abs(s) > 3 * abs(d0) else s

    inner = []
    for i in range(1, len(m)):
        a, b, w1, w2 = m[i - 1], m[i], 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
        inner.append((w1 + w2) / (w1 / a + w2 / b) if a * b > 0 else 0.0)
    return [end(h[0], h[1], m[0], m[1]), *inner, end(h[-1], h[-2], m[-1], m[-2])]


def akima_slopes(x, y):
    m = [(b - a) / (q - p) for a, b, p, q in zip(y, y[1:], x, x[1:])]
    if len(m) == 1:
        return [m[0], m[0]]
    e = [3 * m[0] - 2 * m[1], 2 * m[0] - m[1], *m, 2 * m[-1] - m[-2], 3 * m[-1] - 2 * m[-2]]
    out = []
    for i in range(len(x)):
        a, b, c, d = e[i : i + 4]
        w1, w2 = abs(d - c), abs(b - a)
        out.append((b + c) / 2 if w1 + w2 <= 1e-9 * max(abs(b), abs(c)) else (w1 * b + w2 * c) / (w1 + w2))
    return out


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("method,slopes", [("pchip", pchip_slopes), ("akima", akima_slopes)])
def test_cubic(spark, span, method, slopes):
    series = {**SERIES, ("d", "x"): [1.0, None, 4.0, None, None, 2.0, None], ("e", "x"): [1.0, None, 4.0, None]}
    del series[("c", "x")]
    got = values(impute.impute(frame(spark, series), "1h", method, 1000, span))
    for k, vs in series.items():
        x = [i for i, v in enumerate(vs) if v is not None]
        y = [vs[i] for i in x]
        d = slopes(x, y)
        for i, v in enumerate(vs):
            if v is not None:
                assert got[k][i] == v
            elif i < x[0] or (i > x[-1] and method == "akima"):
                assert got[k][i] is None
            else:
                j = max(q for q in range(len(x) - 1) if x[q] < i)
                want = hermite(i - x[j], x[j + 1] - x[j], y[j], y[j + 1], d[j], d[j + 1])
                assert close(got[k][i], want, 1e-7), (k, i, got[k][i], want)


def historical(vs, res, holidays, cut, same_clock=None, a=0.3):
    """Restatement of the historical blend by looking at every pair of values."""
    ts = [at(i, res) for i in range(len(vs))]

    def wn(t):
        day = t.weekday()
        if t.date() in holidays:
            day = 5 if day == 4 else 6
        return day + t.hour / 24 + t.minute / 1440

    leap = lambda y: y % 4 == 0 and (y % 100 != 0 or y % 400 == 0)
    yd = lambda t: t.timetuple().tm_yday - 1
    out = list(vs)
    for s, e in runs(vs, True):
        if e - s + 1 >= 2 * (len(vs) // 2) - 1:
            continue
        for i in range(s, e + 1):
            found = []
            for j, v in enumerate(vs):
                if v is None or (ts[i] < cut and ts[j] >= cut):
                    continue
                n = 365 + leap(ts[j].year)
                apart = min((yd(ts[j]) - yd(ts[i])) % n, (yd(ts[i]) - yd(ts[j])) % n)
                week = abs(wn(ts[j]) - wn(ts[i])) < 0.000694 and abs(ts[j].year - ts[i].year) < 3 and apart < 30
                clock = same_clock is not None and apart < same_clock and ts[j].time() == ts[i].time()
                if week or clock:
                    found.append(v)
            lin = linear(vs, i)
            if lin is None:
                continue
            w = math.exp(-a * (min(i - s, e - i) + 1))
            out[i] = w * lin + (1 - w) * (sum(found) / len(found) if found else lin)
    return out


@pytest.mark.parametrize("same_clock", [None, 2])
@pytest.mark.parametrize("span", [40 * DAY, None])
def test_historical(spark, span, same_clock):
    res = 12 * HOUR
    series = {("a", "x"): masked(1600, 6), ("b", "x"): masked(300, 7)}
    holidays = {dt.date(y, m, d) for y in (2023, 2024, 2025) for m, d in ((1, 1), (4, 14), (5, 5), (12, 26))}
    table = spark.createDataFrame([(d,) for d in holidays], "date date")
    cut = dt.datetime(2024, 9, 1)
    got = values(
        impute.impute_historical(frame(spark, series, res), res, table, cut="2024-09-01", same_time_window=same_clock, span=span), res
    )
    same(got, {k: historical(vs, res, holidays, cut, same_clock) for k, vs in series.items()}, 1e-7)


def test_recent(spark):
    res = 12 * HOUR
    vs = masked(1000, 8, 0.5, 14)
    ts = [at(i, res) for i in range(len(vs))]
    cut = dt.datetime(2024, 5, 1)
    want = list(vs)
    for s, e in runs(vs, True):
        for i in range(s, e + 1):
            reach = 5
            found = []
            while not found and reach <= 19:
                found = [
                    v
                    for j, v in enumerate(vs)
                    if v is not None
                    and not (ts[i] < cut <= ts[j])
                    and ts[j].time() == ts[i].time()
                    and 1 <= ts[i].timetuple().tm_yday - ts[j].timetuple().tm_yday <= reach
                ]
                reach += 1
            lin = linear(vs, i)
            if found and lin is not None:
                w = math.exp(-0.3 * (min(i - s, e - i) + 1))
                want[i] = w * lin + (1 - w) * sum(found) / len(found)
    got = values(impute.impute_recent(frame(spark, {("a", "x"): vs}, res), res, cut="2024-05-01"), res)
    same(got, {("a", "x"): want}, 1e-7)


def test_filter_years(spark):
    rows = [("a", "x", dt.datetime(y, 6, 1), float(y)) for y in range(2000, 2010)] + [("b", "x", dt.datetime(1990, 1, 1), 1.0)]
    d = spark.createDataFrame(rows, SCHEMA)
    assert clean.filter_years(d, 2003, 2005).count() == 3
    assert clean.filter_years(d, 2003).count() == 1
    assert clean.filter_years(d).count() == 10
