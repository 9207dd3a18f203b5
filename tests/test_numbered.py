"""Row numbers along several files and blocks equal those along one file."""

import pytest
from pyspark.sql import functions as F

from tidewell.operators import quality
from tidewell.sources import readers


@pytest.fixture
def parts(tmp_path):
    """One file, the same rows in a folder of uneven parts (one of them empty), and the texts."""
    rows = [f"2024-01-{1 + i // 24:02d} {i % 24:02d}:00:00,{i * 0.5}" for i in range(240)]
    one = tmp_path / "one.csv"
    one.write_text("\n".join(["Datetime,Value", *rows]) + "\n")
    folder = tmp_path / "parts"
    folder.mkdir()
    cuts = [0, 1, 1, 90, 97, 240]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
        (folder / f"part-{k:02d}.csv").write_text("\n".join(["Datetime,Value", *rows[a:b]]) + "\n")
    return str(one), str(folder), rows


def ordered(df):
    return [(r["row_id"], f"{r['raw_ts']},{r['raw_value']}") for r in df.orderBy("row_id").collect()]


@pytest.mark.parametrize("block", ["128m", "700"])
def test_folder_and_file_give_the_same_numbers(spark, parts, block):
    one, folder, rows = parts
    spark.conf.set("spark.sql.files.maxPartitionBytes", block)  # small blocks cut the files
    try:
        want = list(enumerate(rows))
        assert ordered(readers.raw_single(spark, one, exact=True)) == want
        assert ordered(readers.raw_single(spark, folder, exact=True)) == want
        loose = [t for _, t in ordered(readers.raw_single(spark, one))]
        assert loose == rows  # without exact numbers the order is the same
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_order_rule_over_files(spark, parts):
    _, folder, _ = parts
    series = readers.typed(readers.raw_single(spark, folder, exact=True))
    assert quality.v_order(series).count() == 0
    late = series.withColumn("row_id", F.when(F.col("row_id") == 239, 1000).otherwise(F.col("row_id") + 1))
    last = series.filter("row_id = 239").withColumn("row_id", F.lit(0))
    assert [r["row_id"] for r in quality.v_order(late.filter("row_id < 1000").unionByName(last)).collect()] == [1]
