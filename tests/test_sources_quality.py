"""Files of all three layouts, right ones and ones that break one rule each."""

import datetime as dt
import itertools

import pytest
from helpers import at, frame, values
from pyspark.sql import functions as F

from catalog import QUERIES
from tidewell.operators import profile, quality
from tidewell.sources import layouts, readers

LONG, SHORT = ["", "Datetime", "ID", "Timeseries ID", "Value"], ["", "Date", "ID", "Timeseries ID", "00:00:00", "12:00:00"]
_no = itertools.count()


def hour(h: int) -> str:
    return f"2023-02-03 {h:02d}:00:00"


def single_rows():
    return [[hour(h), str(h + 0.5)] for h in range(5)]


def long_rows():
    return [[str(i), hour(i % 3), str(i // 3), "AB"[i // 3], str(i + 0.5)] for i in range(6)]


def short_rows():
    return [[str(i), f"2023-02-0{1 + i % 2}", str(i // 2), "AB"[i // 2], str(i + 0.5), str(i + 0.7)] for i in range(4)]


def put(rows, r, c, text):
    rows = [list(x) for x in rows]
    rows[r][c] = text
    return rows


def swap(rows, a, b, c):
    rows = [list(x) for x in rows]
    rows[a][c], rows[b][c] = rows[b][c], rows[a][c]
    return rows


def dashed(rows, c):
    """Dates written day first."""
    return [[*x[:c], "-".join(reversed(x[c][:10].split("-"))) + x[c][10:], *x[c + 1 :]] for x in rows]


def renumber(rows):
    return [[str(i), *x[1:]] for i, x in enumerate(rows)]


HEAD1 = ["Datetime", "Value"]
CASES = {
    # layout, header, rows, expected rule or resolution
    "single": ("single", HEAD1, single_rows(), "1h"),
    "long": ("long", LONG, long_rows(), "1h"),
    "short": ("short", SHORT, short_rows(), "12h"),
    "single empty": ("single", HEAD1, [], "V-01"),
    "single one row": ("single", HEAD1, single_rows()[:1], "V-01"),
    "single time name": ("single", ["When", "Value"], single_rows(), "V-02"),
    "single value name": ("single", ["Datetime", "Load"], single_rows(), "V-02"),
    "single day first": ("single", HEAD1, dashed(single_rows(), 0), "V-03"),
    "single mixed dates": ("single", HEAD1, put(single_rows(), 3, 0, "2023-02-04"), "V-03"),
    "single text value": ("single", HEAD1, put(single_rows(), 2, 1, "n/a"), "V-04"),
    "single repeated": ("single", HEAD1, put(single_rows(), 2, 0, hour(1)), "V-07"),
    "single order": ("single", HEAD1, swap(single_rows(), 2, 3, 0), "V-08"),
    "single missing row": ("single", HEAD1, single_rows()[:1] + single_rows()[2:], "1h"),
    "single missing value": ("single", HEAD1, put(single_rows(), 1, 1, ""), "1h"),
    "long empty": ("long", LONG, [], "V-01"),
    "short empty": ("short", SHORT, [], "V-01"),
    "long time name": ("long", ["", "When", *LONG[2:]], long_rows(), "V-02"),
    "long series name": ("long", ["", "Datetime", "ID", "Series", "Value"], long_rows(), "V-02"),
    "short id name": ("short", ["", "Date", "Name", *SHORT[3:]], short_rows(), "V-02"),
    "short series name": ("short", ["", "Date", "ID", "Series", *SHORT[4:]], short_rows(), "V-02"),
    "short not a time": ("short", [*SHORT[:5], "noon"], short_rows(), "V-02"),
    "long no index": ("long", LONG[1:], [x[1:] for x in long_rows()], "V-09"),
    "short no index": ("short", SHORT[1:], [x[1:] for x in short_rows()], "V-09"),
    "long unnamed index with hole": ("long", LONG[1:], put(put(long_rows(), 5, 0, "7"), 4, 0, "6"), "V-09"),
    "short unnamed index from 2": ("short", SHORT[1:], [[str(i + 2), *x[1:]] for i, x in enumerate(short_rows())], "V-09"),
    "long unnamed index": ("long", LONG[1:], long_rows(), "1h"),
    "long day first": ("long", LONG, dashed(long_rows(), 1), "V-03"),
    "short day first": ("short", SHORT, dashed(short_rows(), 1), "V-03"),
    "long text value": ("long", LONG, put(long_rows(), 1, 4, "n/a"), "V-04"),
    "short text value": ("short", SHORT, put(short_rows(), 1, 5, "n/a"), "V-04"),
    "long float id": ("long", LONG, put(long_rows(), 1, 2, "0.0"), "V-05"),
    "short float id": ("short", SHORT, put(short_rows(), 2, 2, "1.0"), "V-05"),
    "long repeated": ("long", LONG, put(long_rows(), 4, 1, hour(0)), "V-07"),
    "short repeated": ("short", SHORT, put(short_rows(), 3, 1, "2023-02-01"), "V-07"),
    "long order": ("long", LONG, swap(long_rows(), 1, 2, 1), "V-08"),
    "short order": ("short", SHORT, swap(short_rows(), 2, 3, 1), "V-08"),
    "long components": ("long", LONG, renumber([*long_rows(), ["", hour(0), "9", "B", "1"], ["", hour(1), "9", "B", "1"]]), "V-10"),
    "short components": ("short", SHORT, renumber([*short_rows(), ["", "2023-02-01", "9", "B", "1", "2"]]), "V-10"),
    "long too short": ("long", LONG, put(put(long_rows(), 1, 4, ""), 2, 4, ""), "V-11"),
    "short too short": ("short", SHORT, put(put(put(short_rows(), 0, 4, ""), 0, 5, ""), 1, 5, ""), "V-11"),
    "long resolutions": ("long", LONG, renumber(long_rows()[:3] + [long_rows()[3], long_rows()[5]]), "V-12"),
    "long gap": ("long", LONG, renumber(long_rows() + [["", hour(6), "0", "A", "1"]]), "1h"),
    "short gap": ("short", SHORT, renumber([*short_rows()[:2], ["", "2023-02-07", "0", "A", "1", "2"]]), "12h"),
}


def write(tmp_path, header, rows):
    path = tmp_path / f"case{next(_no)}.csv"
    path.write_text("\n".join(",".join(x) for x in [header, *rows]) + "\n")
    return str(path)


@pytest.mark.parametrize("name", CASES)
def test_rules(spark, tmp_path, name):
    layout, header, rows, expected = CASES[name]
    path = write(tmp_path, header, rows)
    names = readers.header_of(spark, path)
    if layout != "single" and names[0] not in readers.DATA_COLUMNS:
        names = names[1:]
    if expected == "V-02":
        assert quality.v_columns(names, layout)
        return
    assert quality.v_columns(names, layout) == []
    if layout == "single":
        raw = readers.raw_single(spark, path)
    else:
        text = readers.raw_indexed(spark, path)
        raw = readers.raw_long(text) if layout == "long" else readers.raw_short(text)
    series = readers.typed(raw)
    violations = quality.check(raw, series, layout)
    if expected.startswith("V-"):
        with pytest.raises(quality.ValidationError, match=expected):
            quality.assert_valid(violations)
    else:
        quality.assert_valid(violations)
        assert {r["resolution"] for r in profile.infer_resolution(series.filter("value is not null")).collect()} == {expected}


def test_single_keeps_the_order_of_the_file(spark, tmp_path):
    rows = [[hour(h % 24).replace("02-03", f"02-{1 + h // 24:02d}"), str(h)] for h in range(24 * 20)]
    d = readers.read_single(spark, write(tmp_path, HEAD1, rows))
    assert [r["value"] for r in d.orderBy("row_id").collect()] == [float(h) for h in range(480)]


def test_missing_series_id_defaults_to_component(spark, tmp_path):
    rows = [[str(i), hour(i), "q/1", str(i)] for i in range(3)]
    d = readers.read_long(spark, write(tmp_path, ["", "Datetime", "ID", "Value"], rows))
    assert {(r["ts_id"], r["id"]) for r in d.collect()} == {("q_1", "q_1")}


def test_nan_is_missing(spark, tmp_path):
    d = readers.read_single(spark, write(tmp_path, HEAD1, put(single_rows(), 1, 1, "NaN")))
    assert d.filter("value is null").count() == 1


def test_short_and_long_are_inverse(spark):
    d = frame(spark, {("a", "x"): list(range(19, 40)), ("b", "y"): list(range(10))})
    wide = layouts.long_to_short(d, layouts.times_of_day(3600))
    back = layouts.short_to_long(wide).filter("value is not null")
    assert values(back) == values(d)


def test_inline_rows(spark):
    d = readers.from_rows(spark, [{"Datetime": hour(0), "Value": 1}, {"Datetime": hour(1), "Value": None}])
    assert [(r["ts"], r["value"]) for r in d.orderBy("row_id").collect()] == [(dt.datetime(2023, 2, 3, 0), 1.0), (dt.datetime(2023, 2, 3, 1), None)]


def test_unfold_keeps_the_first_of_consecutive_documents(spark):
    docs = [("m", n, d, {"00:00:00": float(n), "01:00:00": n + 0.5}) for n, d in enumerate(["2023-01-01", "2023-01-01", "2023-01-02", "2023-01-01"])]
    d = spark.createDataFrame(docs, "source string, no bigint, date string, doc map<string,double>")
    got = layouts.unfold_daily(d, "source", "no").collect()
    assert sorted(r["value"] for r in got) == [0.0, 0.5, 2.0, 2.5, 3.0, 3.5]


def test_meter_documents(spark):
    d = spark.createDataFrame([("d1", "m", "P", 2, 1.0), ("d1", "m", "P", 1, 2.0), ("d1", "m", "Q", 1, 3.0)], "date string, id string, power_type string, no int, `00:00:00` double")
    got = layouts.normalise_meter(d, "no").orderBy("ID").collect()
    assert [(r["ID"], r["00:00:00"]) for r in got] == [("m P", 2.0), ("m Q", 3.0)]


def test_written_files_read_back(spark, tmp_path):
    d = frame(spark, {("a", "x"): [1.0, None, 3.0]})
    readers.write_long(d, str(tmp_path / "long"))
    assert spark.read.parquet(str(tmp_path / "long")).columns == ["Datetime", "ID", "Timeseries ID", "Value"]
    readers.write_long(d, str(tmp_path / "csv"), "csv")
    paths = readers.write_tables({"one": d, "two": d}, str(tmp_path / "reports"), by="ts_id")
    assert {k: spark.read.parquet(p).count() for k, p in paths.items()} == {"one": 3, "two": 3}


def test_written_tables_without_rows_read_back(spark, tmp_path):
    d = frame(spark, {("a", "x"): [1.0, None], ("b", "x"): [2.0]})
    paths = readers.write_tables({"some": d, "none": d.filter("value > 5")}, str(tmp_path / "reports"), by="ts_id")
    assert {k: spark.read.parquet(p).count() for k, p in paths.items()} == {"some": 3, "none": 0}
    assert dict(spark.read.parquet(paths["none"]).dtypes) == dict(d.dtypes)


@pytest.mark.parametrize("names", ["AB", ("1", "01")])
@pytest.mark.parametrize("gap, far", [(False, True), (True, False), (True, True), (False, False)])
def test_cleaning_reports_without_rows(spark, tmp_path, names, gap, far):
    """Daily orders of two priorities; the first one may miss a day or hold a value far from the others."""
    days = [dt.datetime(2023, 3, 1) + dt.timedelta(days=i) for i in range(20)]
    rows = [(p, t, 900.0 if far and (p, i) == (names[0], 4) else 100.0 + i % 2) for p in names for i, t in enumerate(days) if not gap or (p, i) != (names[0], 9)]
    spark.createDataFrame(rows, "o_orderpriority string, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    got = QUERIES["s_10_cleaning_reports"](spark, str(tmp_path))
    assert got.dtypes == [("report", "string"), ("ts_id", "string"), ("n", "bigint")]
    assert {tuple(r) for r in got.collect()} == {(k, names[0], 1) for k, there in (("imputed", gap), ("removed", far)) if there}


def test_other_rules(spark):
    d = frame(spark, {("a", "x"): [1.0] * 5 + [None], ("b", "x"): [2.0] * 30, ("c", "x"): [None] * 3})
    assert {r["ts_id"] for r in quality.v_ends_before_val(d, at(20).isoformat()).collect()} == {"a", "c"}
    got = {(r["ts_id"], r["detail"]) for r in quality.v_nulls_after_val(d, at(1).isoformat()).collect()}
    assert got == {("a", str(at(5))), ("c", str(at(1)))}
    assert [r["ts_id"] for r in quality.v_series_exists(d, ["a", "zz"]).collect()] == ["zz"]
    assert {r["ts_id"] for r in quality.drop_empty(d).collect()} == {"a", "b"}
    with pytest.raises(quality.ValidationError, match="V-19"):
        quality.drop_empty(d, allow=False)
    assert {r["ts_id"] for r in quality.v_too_short(d).collect()} == {"c"}


def test_allowed_resolutions(spark):
    d = frame(spark, {("a", "x"): [1.0] * 3})
    got = profile.allowed_resolutions(d).orderBy("seconds").collect()
    assert [r["resolution"] for r in got] == ["1h", "2h", "6h", "1d", "2d", "5d", "10d"]
    assert [r["is_default"] for r in got] == [True] + [False] * 6


def test_labels(spark):
    d = spark.createDataFrame([(30,), (900,), (7200,), (86400,)], "s bigint")
    assert [r[0] for r in d.select(profile.label(F.col("s"))).collect()] == ["30s", "15min", "2h", "1d"]
