"""The sliced windows must not depend on where the slices are cut."""

import pytest
from helpers import DAY, HOUR, at, frame, masked, values
from pyspark.sql import functions as F

from tidewell.slices import nearest, neighbours, running_sum, span_of, step_rows, with_halo, halo_window

SPANS = [5 * HOUR, 7 * HOUR, DAY, 400 * DAY]
SERIES = {("a", "x"): masked(90, 1), ("a", "y"): masked(40, 2, burst=25), ("b", "x"): [None] * 30, ("c", "x"): [1.0]}


@pytest.mark.parametrize("span", SPANS)
def test_nearest(spark, span):
    got = nearest(frame(spark, SERIES), F.col("value").isNotNull(), ["value"], span).collect()
    assert len(got) == sum(map(len, SERIES.values()))
    for r in got:
        vs = SERIES[(r["ts_id"], r["id"])]
        i = int((r["ts"] - at(0)).total_seconds()) // HOUR
        before = [j for j in range(i) if vs[j] is not None]
        after = [j for j in range(i + 1, len(vs)) if vs[j] is not None]
        assert (r["prev"] and (r["prev"]["ts"], r["prev"]["value"])) == ((at(before[-1]), vs[before[-1]]) if before else None)
        assert (r["next"] and (r["next"]["ts"], r["next"]["value"])) == ((at(after[0]), vs[after[0]]) if after else None)
        assert (r["k_start"], r["k_end"]) == (at(0), at(len(vs) - 1))


@pytest.mark.parametrize("span", SPANS)
@pytest.mark.parametrize("k", [1, 2, 3])
def test_neighbours(spark, span, k):
    d = frame(spark, SERIES).filter("value is not null")
    for r in neighbours(d, k, ["value"], span).collect():
        known = [(at(i), v) for i, v in enumerate(SERIES[(r["ts_id"], r["id"])]) if v is not None]
        i = known.index((r["ts"], r["value"]))
        for j in range(1, k + 1):
            p, n = r[f"p{j}"], r[f"n{j}"]
            assert (p and tuple(p)) == (known[i - j] if i >= j else None)
            assert (n and tuple(n)) == (known[i + j] if i + j < len(known) else None)


@pytest.mark.parametrize("span", SPANS)
def test_running_sum(spark, span):
    series = {k: [1.0 if v is None else v for v in vs] for k, vs in SERIES.items()}
    got = values(running_sum(frame(spark, series), F.col("value"), "total", span), column="total")
    for k, vs in series.items():
        for i in range(len(vs)):
            assert abs(got[k][i] - sum(vs[: i + 1])) < 1e-6


@pytest.mark.parametrize("span", SPANS)
def test_halo(spark, span):
    d = with_halo(frame(spark, SERIES), HOUR, 6, 3, span)
    d = d.withColumn("back", F.lag("value", 6).over(halo_window())).withColumn("ahead", F.lead("value", 3).over(halo_window()))
    d = d.filter("home")
    back, ahead = values(d, column="back"), values(d, column="ahead")
    for k, vs in SERIES.items():
        assert back[k] == [vs[i - 6] if i >= 6 else None for i in range(len(vs))]
        assert ahead[k] == [vs[i + 3] if i + 3 < len(vs) else None for i in range(len(vs))]


@pytest.mark.parametrize("spread", [None, ["ts_id", "id"]])
@pytest.mark.parametrize("span", SPANS)
def test_step_rows(spark, span, spread):
    d = spark.createDataFrame(
        [("a", "x", at(0), at(77)), ("b", "x", at(3), at(3)), ("c", "x", at(5), at(4))], "ts_id string, id string, lo timestamp_ntz, hi timestamp_ntz"
    )
    rows = step_rows(d, F.col("lo"), F.col("hi"), 2 * HOUR, span, "ts", spread).collect()
    assert sorted(r["ts"] for r in rows if r["ts_id"] == "a") == [at(i) for i in range(0, 78, 2)]
    assert [r["ts"] for r in rows if r["ts_id"] == "b"] == [at(3)]
    assert not [r for r in rows if r["ts_id"] == "c"]


def test_span_is_whole_days():
    assert span_of(1) == DAY
    assert span_of(HOUR) == 171 * DAY
    assert span_of(DAY) == 4096 * DAY


def test_one_component_spreads_over_many_groups(spark):
    """A third of all rows in one component still gives groups of at most one slice."""
    d = spark.range(50000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("k"), (F.col("id") % 1000).cast("string"))).alias("ts_id"),
        (F.expr("timestamp_ntz'2020-01-01'") + F.expr("interval '1' minute") * F.col("id")).alias("ts"),
        F.when(F.col("id") % 7 > 0, F.col("id").cast("double")).alias("value"),
    ).withColumn("id", F.col("ts_id"))
    out = nearest(d, F.col("value").isNotNull(), ["value"], span_of(60))
    assert out.count() == 50000
    assert out.groupBy("ts_id", "slice").count().agg(F.max("count")).first()[0] <= 4096 * 2
    assert out.filter("ts_id = 'hot'").select("slice").distinct().count() > 1
