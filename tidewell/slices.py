"""Windows over very long components, cut into time slices.

``Window.partitionBy('ts_id', 'id')`` puts a whole component into one task, which fails once a single component
holds a large share of the table. All order-dependent operators here therefore work on ``(keys, slice)``, where a
slice is a fixed span of time, and pass what must cross a slice border in one of two ways:

* a *halo*: rows near a border are also sent to the neighbouring slices (look-back of a known length);
* a *carry*: one summary row per slice is windowed per component and joined back on ``(keys, slice)``
  (look-back of unknown length, such as "the last known value").

``span`` is at least one day, so a component has at most as many slices as it has calendar days, and a slice has
at most ``max(86400 / resolution, 4096)`` rows once timestamps are unique. Both bounds hold however many rows the
component has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .model import DAY, KEYS, epoch, floor_div, shift

SLICE = "slice"
STEPS = 4096


def span_of(res: int) -> int:
    """Seconds of one slice for a resolution in seconds; always a whole number of days."""
    return -(-max(DAY, STEPS * res) // DAY) * DAY


def sure(c: Column) -> Column:
    """The same column, known to the optimizer as never NULL.

    Otherwise a join on it adds a not-null filter to one of two branches that read the same exchange, and the exchange
    would be computed twice.
    """
    return F.coalesce(c, F.lit(0).cast("bigint"))


def sliced(df: DataFrame, span: int, keys=KEYS, order: Column | None = None) -> DataFrame:
    """Add ``slice`` and cluster by ``(keys, slice)``; a table that already has the column is left as it is.

    The explicit exchange is shared by the row branch and the summary branch of a carry, so that everything
    before it runs once.
    """
    if SLICE in df.columns:
        return df
    pos = epoch("ts") if order is None else order
    return df.withColumn(SLICE, sure(floor_div(pos, span))).repartition(*keys, SLICE)


def _over(fn: str, keys, order: str = "ts") -> Column:
    return F.expr(f"{fn} over (partition by {', '.join(keys)}, {SLICE} order by {order})")


def nearest(df: DataFrame, mark: Column, payload: list[str], span: int, keys=KEYS) -> DataFrame:
    """Attach the closest marked row strictly before and after every row of a component.

    Adds ``prev`` and ``next`` (structs of ``ts`` and the payload, NULL at the ends) and ``k_start`` / ``k_end``,
    the first and last timestamp of the component. Timestamps must be unique per component.
    """
    d = sliced(df, span, keys)
    fields = ["ts", *payload]
    marked = d.withColumn("_m", F.when(mark, F.struct(*fields)))
    aggs = [F.min("ts").alias("_lo"), F.max("ts").alias("_hi")]
    for f in fields:
        # min_by / max_by keep fixed-width buffers, so this stays a hash aggregate
        aggs.append(F.min_by(f, F.when(mark, F.col("ts"))).alias(f"_f_{f}"))
        aggs.append(F.max_by(f, F.when(mark, F.col("ts"))).alias(f"_l_{f}"))
    summary = d.groupBy(*keys, SLICE).agg(*aggs)
    struct = lambda p: F.when(
        F.col(f"{p}_ts").isNotNull(), F.struct(*[F.col(f"{p}_{f}").alias(f) for f in fields])
    )
    whole = Window.partitionBy(*keys)
    along = f"over (partition by {', '.join(keys)} order by {SLICE})"
    carry = summary.select(*keys, SLICE, "_lo", "_hi", struct("_f").alias("_f"), struct("_l").alias("_l")).select(
        *keys,
        SLICE,
        F.expr(f"lag(_l) ignore nulls {along}").alias("_before"),
        F.expr(f"lead(_f) ignore nulls {along}").alias("_after"),
        F.min("_lo").over(whole).alias("k_start"),
        F.max("_hi").over(whole).alias("k_end"),
    )
    return (
        marked.join(carry, [*keys, SLICE])
        .withColumns({"_p": _over("lag(_m) ignore nulls", keys), "_n": _over("lead(_m) ignore nulls", keys)})
        .withColumns({"prev": F.coalesce("_p", "_before"), "next": F.coalesce("_n", "_after")})
        .drop("_m", "_p", "_n", "_before", "_after")
    )


def neighbours(
    df: DataFrame, k: int, payload: list[str], span: int, keys=KEYS, order: str = "ts", position: Column | None = None
) -> DataFrame:
    """Attach the ``k`` rows before and after every row as structs ``p1..pk`` and ``n1..nk``.

    ``order`` must be unique within a component. ``position`` is the number that is cut into slices of length
    ``span`` (seconds of ``ts`` by default, or a row number).
    """
    d = sliced(df, span, keys, position).withColumn("_r", F.struct(order, *[p for p in payload if p != order]))
    here = Window.partitionBy(*keys, SLICE).orderBy(order)
    both = lambda w, p, n: {
        **{f"{p}{j}": F.lag("_r", j).over(w) for j in range(1, k + 1)},
        **{f"{n}{j}": F.lead("_r", j).over(w) for j in range(1, k + 1)},
    }
    d = d.withColumns({"_i": F.row_number().over(here), **both(here, "_p", "_n")})
    # the k outermost rows of each slice are enough to find what precedes and follows it
    edge = d.filter((F.col("_i") <= k) | F.col(f"_n{k}").isNull()).select(*keys, SLICE, "_i", "_r", order, "_n1")
    edge = edge.withColumns(both(Window.partitionBy(*keys).orderBy(order), "_b", "_a"))
    first, last = F.col("_i") == 1, F.col("_n1").isNull()
    carry = edge.filter(first | last).groupBy(*keys, SLICE)
    carry = carry.agg(
        *[F.max(F.when(first, F.col(f"_b{j}"))).alias(f"_b{j}") for j in range(1, k + 1)],
        *[F.max(F.when(last, F.col(f"_a{j}"))).alias(f"_a{j}") for j in range(1, k + 1)],
        F.max(F.when(last, F.col("_i"))).alias("_len"),
    )
    out = d.join(carry, [*keys, SLICE])
    left = F.col("_i")  # rows 1..left-1 of the slice lie before this one
    right = F.col("_len") - F.col("_i") + 1
    found = {}
    for j in range(1, k + 1):
        p, n = F.col(f"_p{j}"), F.col(f"_n{j}")
        for i in range(1, j + 1):  # the i-th row outside the slice is the j-th neighbour when left == j - i + 1
            p = F.when(left == j - i + 1, F.col(f"_b{i}")).otherwise(p)
            n = F.when(right == j - i + 1, F.col(f"_a{i}")).otherwise(n)
        found.update({f"p{j}": p, f"n{j}": n})
    out = out.withColumns(found)
    extra = [f"_{c}{j}" for c in "pnba" for j in range(1, k + 1)]
    return out.drop("_r", "_i", "_len", *extra)


def running_sum(df: DataFrame, amount: Column, name: str, span: int, keys=KEYS) -> DataFrame:
    """Running total along ``ts`` up to and including the row."""
    d = sliced(df, span, keys)
    here = Window.partitionBy(*keys, SLICE).orderBy("ts").rowsBetween(Window.unboundedPreceding, 0)
    along = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        d.groupBy(*keys, SLICE)
        .agg(F.sum(amount).alias("_t"))
        .select(*keys, SLICE, F.coalesce(F.sum("_t").over(along), F.lit(0)).alias("_before"))
    )
    return (
        d.join(carry, [*keys, SLICE])
        .withColumn(name, F.sum(amount).over(here) + F.col("_before"))
        .drop("_before")
    )


def with_halo(df: DataFrame, res: int, back: int, ahead: int, span: int | None = None) -> DataFrame:
    """Send every row also to the slices that need it to look ``back`` / ``ahead`` steps on a regular grid.

    Adds ``slice`` and ``home`` (true for the one copy that is a result row). Windows over ``(keys, slice)`` then
    see all rows they need; keep ``home`` rows afterwards.
    """
    span = span or span_of(res)
    d = df.drop(SLICE)
    at = epoch("ts")
    own = floor_div(at, span)
    lo, hi = floor_div(at - ahead * res, span), floor_div(at + back * res, span)
    return d.withColumn("_own", own).withColumn(SLICE, F.explode(F.sequence(lo, hi))).withColumn(
        "home", F.col(SLICE) == F.col("_own")
    ).drop("_own")


def halo_window(keys=KEYS):
    return Window.partitionBy(*keys, SLICE).orderBy("ts")


def step_rows(df: DataFrame, first: Column, last: Column, res: int, span: int, name: str = "ts", spread=None) -> DataFrame:
    """One row per step from ``first`` to ``last`` (timestamps); rows with ``first > last`` give none.

    Long ranges are cut into slices before the steps are generated, so no array is longer than one slice. With
    ``spread`` (key columns) the cut ranges are redistributed first, so one long range is generated by many tasks.
    """
    lo, hi = epoch(first), epoch(last)
    parts = (
        df.withColumn("_lo", lo)
        .withColumn("_hi", hi)
        .filter("_lo <= _hi")
        .withColumn("_c", F.explode(F.sequence(floor_div(F.col("_lo"), span), floor_div(F.col("_hi"), span))))
    )
    if spread:
        parts = parts.repartition(*spread, "_c")
    skipped = F.greatest(F.col("_c") * span - F.col("_lo"), F.lit(0))
    start = F.col("_lo") + floor_div(skipped + res - 1, res) * res
    stop = F.least(F.col("_hi"), (F.col("_c") + 1) * span - 1)
    return (
        parts.withColumn("_a", start)
        .withColumn("_z", stop)
        .filter("_a <= _z")
        .withColumn("_s", F.explode(F.sequence("_a", "_z", F.lit(res).cast("bigint"))))
        .withColumn(name, shift(F.expr("timestamp_ntz'1970-01-01 00:00:00'"), "_s"))
        .drop("_lo", "_hi", "_c", "_a", "_z", "_s")
    )
