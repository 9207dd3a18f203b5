"""CSV readers for single, long and short files, and writers for results.

Files are read as text first (``raw_*``), so that the data-quality rules can point at the offending text, and are
typed afterwards (``typed``). Reading never infers a schema from the data.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .layouts import default_ts_id, parse_ts, parse_value, time_columns

RAW_COLUMNS = ["row_id", "ts_id", "id", "raw_ts", "raw_value"]
DATA_COLUMNS = ("Datetime", "Date", "ID", "Timeseries ID", "Value")
SINGLE_NAME = "Timeseries"


def _csv(spark: SparkSession, path: str, sep: str):
    return spark.read.option("header", True).option("sep", sep).option("ignoreLeadingWhiteSpace", True).option(
        "ignoreTrailingWhiteSpace", True
    )


def header_of(spark: SparkSession, path: str, sep: str = ",") -> list[str]:
    """Column names of the file; a blank name (an unnamed index column) is returned as ``''``."""
    names = _csv(spark, path, sep).csv(path).columns
    return ["" if n == f"_c{i}" else n for i, n in enumerate(names)]


def placed(df: DataFrame) -> DataFrame:
    """A file scan with ``_file``, ``_block`` (offset of the block) and ``_at``, which counts up along the rows of a block."""
    at = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return df.withColumns({"_file": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_at": at})


def numbered(df: DataFrame, name: str = "row_id") -> DataFrame:
    """A file scan with its rows numbered 0, 1, ... along the files in the order of their paths.

    Rows are counted by block and the counts of the blocks before are added, so what one task sees is a row for each block of
    the input, never the rows. The files are read twice.
    """
    d = placed(df)
    blocks = d.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    in_file = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    files = blocks.groupBy("_file").agg(F.sum("_n").alias("_all"))
    earlier = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)  # a row a file
    files = files.select("_file", F.coalesce(F.sum("_all").over(earlier), F.lit(0)).alias("_before"))
    blocks = blocks.withColumn("_inside", F.coalesce(F.sum("_n").over(in_file), F.lit(0))).drop("_n").join(files, "_file")
    row = F.col("_before") + F.col("_inside") + F.col("_at") - F.col("_first")
    return d.join(blocks, ["_file", "_block"]).withColumn(name, row).drop("_file", "_block", "_at", "_before", "_inside", "_first")


def raw_single(spark: SparkSession, path: str, sep: str = ",", exact: bool = False) -> DataFrame:
    """Text of a single series: the first column is the time, the second one the value.

    ``row_id`` follows the file: rows of a block count up from the offset of the block, and no row is shorter
    than one byte. With ``exact`` rows are numbered 0, 1, ... without gaps, also along a folder of several files
    (see :func:`numbered`).
    """
    df = _csv(spark, path, sep).schema("raw_ts string, raw_value string").csv(path)
    df = numbered(df) if exact else placed(df).withColumn("row_id", F.col("_block") + F.col("_at"))
    return df.select("row_id", F.lit(SINGLE_NAME).alias("ts_id"), F.lit(SINGLE_NAME).alias("id"), "raw_ts", "raw_value")


def raw_indexed(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Text of a long or short file, whose first column is a row index.

    When the header starts with a data column, rows may still start with an index; it is read as ``index`` either way.
    """
    names = header_of(spark, path, sep)
    names = names if names[0] in DATA_COLUMNS else names[1:]
    schema = ", ".join(["`index` string", *[f"`{n}` string" for n in names]])
    return _csv(spark, path, sep).schema(schema).csv(path)


def raw_long(df: DataFrame) -> DataFrame:
    """Long text columns -> the raw table the quality rules read."""
    d = default_ts_id(df)
    return d.select(
        F.col("index").alias("row_id"),
        F.col("Timeseries ID").alias("ts_id"),
        F.col("ID").alias("id"),
        F.col("Datetime").alias("raw_ts"),
        F.col("Value").alias("raw_value"),
    )


def raw_short(df: DataFrame) -> DataFrame:
    """Short text columns -> the raw table; one row per time of day, dates stay as written."""
    d = default_ts_id(df)
    long = d.unpivot(["index", "Date", "ID", "Timeseries ID"], time_columns(d), "time", "raw_value")
    return long.select(
        F.col("index").alias("row_id"),
        F.col("Timeseries ID").alias("ts_id"),
        F.col("ID").alias("id"),
        F.concat_ws(" ", "Date", "time").alias("raw_ts"),
        "raw_value",
    )


def typed(raw: DataFrame) -> DataFrame:
    """Canonical columns plus ``row_id``; text that cannot be read becomes NULL (see the quality rules)."""
    return raw.select(
        F.translate("ts_id", "/", "_").alias("ts_id"),
        F.translate("id", "/", "_").alias("id"),
        parse_ts("raw_ts").alias("ts"),
        parse_value("raw_value").alias("value"),
        F.col("row_id").try_cast("bigint").alias("row_id"),
    )


def read_single(spark: SparkSession, path: str, sep: str = ",", exact: bool = False) -> DataFrame:
    return typed(raw_single(spark, path, sep, exact))


def read_long(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return typed(raw_long(raw_indexed(spark, path, sep)))


def read_short(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    return typed(raw_short(raw_indexed(spark, path, sep)))


def from_rows(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Inline rows of a request (``Datetime``, ``Value``, optionally ``ID`` and ``Timeseries ID``)."""
    schema = "index string, Datetime string, ID string, `Timeseries ID` string, Value string"
    text = lambda v: None if v is None else str(v)
    data = [
        (
            str(i),
            text(r.get("Datetime")),
            text(r.get("ID", SINGLE_NAME)),
            text(r.get("Timeseries ID", r.get("ID", SINGLE_NAME))),
            text(r.get("Value")),
        )
        for i, r in enumerate(rows)
    ]
    return typed(raw_long(spark.createDataFrame(data, schema)))


def long_columns(df: DataFrame) -> DataFrame:
    """Canonical table -> the column names of a long file."""
    return df.select(
        F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("Datetime"),
        F.col("id").alias("ID"),
        F.col("ts_id").alias("Timeseries ID"),
        F.col("value").alias("Value"),
    )


def write_long(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a long file, globally ordered by series, component and time."""
    out = long_columns(df).orderBy("Timeseries ID", "ID", "Datetime")
    writer = out.write.mode("errorifexists")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_tables(tables: dict[str, DataFrame], path: str, by: str | None = None) -> dict[str, str]:
    """Write named report tables (removed values, imputed values, forecasts, metrics, ...) below ``path``.

    ``by`` splits the output into folders; use it for columns of few values only, never for millions of series. Spark writes
    no file for a table without rows then; one file that holds only its columns is added, so that it can be read back.
    """
    out = {}
    for name, df in tables.items():
        target = f"{path.rstrip('/')}/{name}"
        writer = df.write.mode("errorifexists")
        (writer.partitionBy(by) if by else writer).parquet(target)
        if by and df.sparkSession.read.schema(df.schema).parquet(target).isEmpty():
            df.limit(0).write.mode("append").parquet(target)
        out[name] = target
    return out


