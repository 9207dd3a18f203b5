"""Profiling: resolution, span and the resolutions a series can be resampled to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import DAY, KEYS, epoch
from ..slices import neighbours

# The offered resolutions, in seconds, with their printed names.
LADDER = [
    (1, "1 second"),
    (2, "2 seconds"),
    (5, "5 seconds"),
    (15, "15 seconds"),
    (30, "30 seconds"),
    (60, "1 minute"),
    (120, "2 minutes"),
    (300, "5 minutes"),
    (900, "15 minutes"),
    (1800, "30 minutes"),
    (3600, "1 hour"),
    (7200, "2 hours"),
    (21600, "6 hours"),
    (86400, "1 day"),
    (172800, "2 days"),
    (432000, "5 days"),
    (864000, "10 days"),
]


def label(secs: Column) -> Column:
    """Canonical label of a resolution: ``1d``, ``2h``, ``15min`` or ``30s``."""
    out = F.concat(secs.cast("string"), F.lit("s"))
    for size, unit in ((60, "min"), (3600, "h"), (DAY, "d")):
        out = F.when(secs % size == 0, F.concat((secs / size).cast("bigint").cast("string"), F.lit(unit))).otherwise(out)
    return out


def infer_resolution(df: DataFrame, span: int = DAY) -> DataFrame:
    """Smallest step between consecutive timestamps of every component, in whole seconds; repeated ones are ignored."""
    stamps = df.select(*KEYS, F.date_trunc("second", "ts").cast("timestamp_ntz").alias("ts")).distinct()
    steps = neighbours(stamps, 1, [], span).select(*KEYS, (epoch("ts") - epoch("p1.ts")).alias("_d"))
    per = steps.groupBy(*KEYS).agg(F.min("_d").alias("seconds"))
    return per.withColumn("resolution", label(F.col("seconds")))


def allowed_resolutions(df: DataFrame, span: int = DAY) -> DataFrame:
    """Own resolution (default) and the coarser ones of the fixed ladder, per component."""
    ladder = F.array(*[F.struct(F.lit(s).cast("bigint").alias("s"), F.lit(n).alias("n")) for s, n in LADDER])
    per = infer_resolution(df, span)
    own = per.select(*KEYS, "seconds", F.lit(True).alias("is_default"))
    coarser = (
        per.select(*KEYS, "seconds", F.explode(ladder).alias("l"))
        .filter("l.s > seconds")
        .select(*KEYS, F.col("l.s").alias("seconds"), F.lit(False).alias("is_default"))
    )
    return own.unionByName(coarser).withColumn("resolution", label(F.col("seconds")))


def dataset_span(df: DataFrame) -> DataFrame:
    """First and last timestamp per series and the earliest validation date, ten days after the start."""
    return (
        df.groupBy("ts_id")
        .agg(F.min("ts").alias("start"), F.max("ts").alias("end"))
        .withColumn("first_val", F.col("start") + F.expr("interval '10' day"))
    )
