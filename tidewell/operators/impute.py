"""Gap geometry and gap filling on regular grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import week_position, with_holidays
from ..model import KEYS, epoch, floor_div, instant, seconds
from ..slices import SLICE, nearest, neighbours, span_of

LINEAR = ("linear", "time", "piecewise_polynomial")
METHODS = ("none", *LINEAR, "pad", "nearest", "pchip", "akima")


def _geometry(df: DataFrame, res: int, span: int | None, payload=("value",)) -> DataFrame:
    """Nearest known values plus ``fwd`` / ``bwd`` (position in the gap from both sides), ``run_len`` and ``n``."""
    keep = [*KEYS, "ts", *[p for p in payload], *([SLICE] if SLICE in df.columns else [])]
    d = nearest(df.select(*keep), F.col("value").isNotNull(), list(payload), span or span_of(res))
    lo = F.coalesce(epoch("prev.ts") + res, epoch("k_start"))
    hi = F.coalesce(epoch("next.ts") - res, epoch("k_end"))
    return (
        d.withColumns({"_at": epoch("ts"), "_lo": lo, "_hi": hi})
        .withColumns(
            {
                "run_start": F.coalesce(F.col("prev.ts") + _step(res), F.col("k_start")),
                "fwd": F.expr(f"(_at - _lo) div {res} + 1"),
                "bwd": F.expr(f"(_hi - _at) div {res} + 1"),
                "run_len": F.expr(f"(_hi - _lo) div {res} + 1"),
                "n": floor_div(epoch("k_end") - epoch("k_start"), res) + 1,
            }
        )
        .drop("_at", "_lo", "_hi")
    )


def _step(res: int) -> Column:
    return F.expr(f"interval '{res}' second")


def _is_gap() -> Column:
    return F.col("value").isNull()


def gap_profile(df: DataFrame, res: int | str, span: int | None = None) -> DataFrame:
    """One row per missing value: start and length of its run and the distance to the nearest end of the run."""
    d = _geometry(df, seconds(res), span).filter(_is_gap())
    return d.select(*KEYS, "ts", "run_start", "run_len", F.least("fwd", "bwd").alias("distance"))


def _too_long(max_thr: int) -> Column:
    """Runs that stay missing: ``run_len >= 2 * floor(max_thr / 2) - 1``; -1 stands for the length of the component."""
    thr = F.col("n") if max_thr == -1 else F.lit(max_thr)
    return F.col("run_len") >= 2 * F.floor(thr / 2) - 1


def _linear() -> Column:
    """Straight line between the neighbours; leading gaps stay missing, trailing ones repeat the last value."""
    x0, x1 = epoch("prev.ts"), epoch("next.ts")
    y0, y1 = F.col("prev.value"), F.col("next.value")
    return F.when(F.col("next").isNull(), y0).otherwise(y0 + (y1 - y0) * (epoch("ts") - x0) / (x1 - x0))


def _nearest() -> Column:
    """Closest known value, the earlier one on a tie; NULL outside the known range."""
    back, ahead = epoch("ts") - epoch("prev.ts"), epoch("next.ts") - epoch("ts")
    return F.when(ahead < back, F.col("next.value")).when(F.col("next").isNotNull(), F.col("prev.value"))


def impute(
    df: DataFrame, res: int | str, method: str = "linear", max_thr: int = -1, span: int | None = None, flag: bool = False
) -> DataFrame:
    """Fill the gaps of a regular grid; runs longer than the ``max_thr`` rule allows stay missing.

    With ``flag`` a column ``imputed`` marks the filled rows. On a grid ``time`` equals ``linear``.
    """
    if method not in METHODS:
        raise ValueError(f"unknown imputation method {method!r}")
    if method == "none":
        return df.withColumn("imputed", F.lit(False)) if flag else df
    res = seconds(res)
    if method in ("pchip", "akima"):
        d, filled = _cubic(df, res, method, span)
    else:
        d = _geometry(df, res, span)
        filled = {"pad": F.col("prev.value"), "nearest": _nearest()}.get(method, _linear())
    filled = F.when(~_too_long(max_thr), filled)
    out = d.select(
        *KEYS,
        "ts",
        F.when(_is_gap(), filled).otherwise(F.col("value")).alias("value"),
        (_is_gap() & filled.isNotNull()).alias("imputed"),
    )
    return out if flag else out.drop("imputed")


def _pchip_raw(h0, h1, d0, d1) -> Column:
    """Unlimited three-point slope at an end; ``0`` is the outer interval."""
    return ((2 * h0 + h1) * d0 - h0 * d1) / (h0 + h1)


def _pchip_end(raw, d0, d1) -> Column:
    """End slope, limited so that the curve keeps its shape."""
    return (
        F.when(d1.isNull(), d0)
        .when(F.signum(raw) != F.signum(d0), F.lit(0.0))
        .when((F.signum(d0) != F.signum(d1)) & (F.abs(raw) > 3 * F.abs(d0)), 3 * d0)
        .otherwise(raw)
    )


def _pchip_slope(m: dict, h: dict, i: int) -> Column:
    """Slope at point ``i`` from the secants ``m[j]`` and widths ``h[j]`` of the intervals ``j -> j+1``.

    Inside: weighted harmonic mean of both secants, 0 where they disagree in sign. The unlimited end slopes are
    expected as columns ``_first<i>`` and ``_last<i>``.
    """
    w0, w1 = 2 * h[i] + h[i - 1], h[i] + 2 * h[i - 1]
    return (
        F.when(m[i - 1].isNull(), _pchip_end(F.col(f"_first{i + 1}"), m[i], m[i + 1]))
        .when(m[i].isNull(), _pchip_end(F.col(f"_last{i + 1}"), m[i - 1], m[i - 2]))
        .when(m[i - 1] * m[i] > 0, (w0 + w1) / (w0 / m[i - 1] + w1 / m[i]))
        .otherwise(F.lit(0.0))
    )


def _akima_slope(m: dict, i: int) -> Column:
    """Akima's weighted slope; secants beyond the ends continue the last two linearly."""
    b1, b2, a1, a2 = m[i - 1], m[i - 2], m[i], m[i + 1]
    one = F.coalesce(a1, b1)  # with a single interval every secant is the same
    first = F.array(2 * a1 - a2, 3 * a1 - 2 * a2, a1, a2)  # [before, before that, after, after that]
    last = F.array(b1, b2, 2 * b1 - b2, 3 * b1 - 2 * b2)
    second = F.array(b1, 2 * b1 - a1, a1, F.coalesce(a2, 2 * a1 - b1))
    inner = F.array(b1, b2, a1, F.coalesce(a2, 2 * a1 - b1))
    four = F.when(b1.isNull(), first).when(a1.isNull(), last).when(b2.isNull(), second).otherwise(inner)

    def weigh(acc):
        pb1, pb2, pa1, pa2 = (F.coalesce(acc[k], one) for k in range(4))
        wl, wr = F.abs(pa2 - pa1), F.abs(pb1 - pb2)
        flat = (wl + wr) <= F.lit(1e-9) * F.greatest(F.abs(pa1), F.abs(pb1))
        return F.when(flat, (pa1 + pb1) / 2).otherwise((wl * pb1 + wr * pa1) / (wl + wr))

    return F.transform(F.array(four), weigh)[0]


def _cubic(df: DataFrame, res: int, method: str, span: int | None) -> tuple[DataFrame, Column]:
    """Local cubic pieces: slopes at the known points, then one Hermite piece per interval.

    Slopes need up to three known points on each side, whatever the distance; they are found on the known rows
    alone. The pieces travel to the missing rows as the payload of the nearest known row.
    """
    span = span or span_of(res)
    known = neighbours(df.select(*KEYS, "ts", "value").filter("value is not null"), 3, ["value"], span)
    pts = known.withColumn("x", F.struct("ts", "value"))
    name = {0: "x", **{j: f"n{j}" for j in (1, 2, 3)}, **{-j: f"p{j}" for j in (1, 2, 3)}}
    # secants and widths become columns first: the slopes use each of them many times
    pts = pts.withColumns({f"_h{j + 3}": (epoch(f"{name[j + 1]}.ts") - epoch(f"{name[j]}.ts")).cast("double") for j in range(-3, 3)})
    rise = {j: F.col(f"{name[j + 1]}.value") - F.col(f"{name[j]}.value") for j in range(-3, 3)}
    pts = pts.withColumns({f"_m{j + 3}": rise[j] / F.col(f"_h{j + 3}") for j in range(-3, 3)})
    m = {j: F.col(f"_m{j + 3}") for j in range(-3, 3)}
    h = {j: F.col(f"_h{j + 3}") for j in range(-3, 3)}
    if method == "pchip":
        raw = {f"_first{i + 1}": _pchip_raw(h[i], h[i + 1], m[i], m[i + 1]) for i in (-1, 0, 1)}
        raw.update({f"_last{i + 1}": _pchip_raw(h[i - 1], h[i - 2], m[i - 1], m[i - 2]) for i in (-1, 0, 1)})
        pts = pts.withColumns(raw)
    slope = (lambda i: _pchip_slope(m, h, i)) if method == "pchip" else (lambda i: _akima_slope(m, i))
    pts = pts.select(
        *KEYS,
        "ts",
        "value",
        slope(0).alias("d0"),
        slope(1).alias("d1"),
        slope(-1).alias("dp"),
        (epoch("ts") - epoch("p1.ts")).cast("double").alias("hp"),
        F.col("p1.value").alias("yp"),
    )
    coef = ["d0", "d1", "dp", "hp", "yp"]
    gaps = df.filter("value is null").select(
        *KEYS, "ts", F.lit(None).cast("double").alias("value"), *[F.lit(None).cast("double").alias(c) for c in coef]
    )
    d = _geometry(pts.unionByName(gaps), res, span, ("value", *coef))
    x0, x1 = epoch("prev.ts"), epoch("next.ts")
    inside = _hermite(
        epoch("ts") - x0, (x1 - x0).cast("double"), F.col("prev.value"), F.col("next.value"), F.col("prev.d0"), F.col("prev.d1")
    )
    # beyond the last known point the last piece of pchip goes on; akima stops there
    beyond = _hermite(
        epoch("ts") - x0 + F.col("prev.hp"), F.col("prev.hp"), F.col("prev.yp"), F.col("prev.value"), F.col("prev.dp"), F.col("prev.d0")
    )
    after = beyond if method == "pchip" else F.lit(None).cast("double")
    return d, F.when(F.col("next").isNull(), after).otherwise(inside)


def _hermite(x, h, y0, y1, d0, d1) -> Column:
    """Cubic with values ``y0, y1`` and slopes ``d0, d1`` at both ends of an interval of width ``h``."""
    s = (y1 - y0) / h
    c2 = (3 * s - 2 * d0 - d1) / h
    c3 = (d0 + d1 - 2 * s) / (h * h)
    return y0 + x * (d0 + x * (c2 + x * c3))


def impute_historical(
    df: DataFrame,
    res: int | str,
    holidays: DataFrame | None = None,
    a: float = 0.3,
    wncutoff: float = 0.000694,
    ycutoff: int = 3,
    ydcutoff: int = 30,
    cut: str | None = None,
    max_thr: int = -1,
    same_time_window: float | None = None,
    span: int | None = None,
    flag: bool = False,
) -> DataFrame:
    """Blend ``w * interpolation + (1 - w) * history`` with ``w = exp(-a * distance)``.

    History is the mean of the known values at the same position of the week (closer than ``wncutoff`` days), within
    ``ycutoff`` years and ``ydcutoff`` days of the year (circular). Values missing before ``cut`` use only values
    before it; without any candidate the interpolation stands alone. ``same_time_window`` also accepts values of any year
    at the same time of day that are fewer than that many days of the year away.

    Candidates are never paired with missing values. A cell (component, minute of week, year) holds running sums over its days,
    366 at most, so a component of any length spreads over many small cells; a missing value meets the cell of each year once
    and takes the difference of two of its running sums.
    ``holidays(date)``, or ``holidays(id, date)`` per component, shifts holidays to the weekend.
    """
    res = seconds(res)
    d = _geometry(df, res, span)
    gap = d.filter(_is_gap() & ~_too_long(max_thr))
    w = F.exp(F.lit(-a) * F.least("fwd", "bwd"))
    todo = gap.select(*KEYS, "ts", w.alias("_w"), _linear().alias("_lin"))
    hist = _history(
        week_position(with_holidays(todo.select(*KEYS, "ts"), holidays)),
        week_position(with_holidays(df.filter("value is not null").select(*KEYS, "ts", "value"), holidays)),
        res,
        wncutoff,
        ycutoff,
        ydcutoff,
        cut,
        same_time_window,
    )
    filled = todo.join(hist, [*KEYS, "ts"], "left").select(
        *KEYS, "ts", (F.col("_w") * F.col("_lin") + (1 - F.col("_w")) * F.coalesce("_hist", "_lin")).alias("_f")
    )
    return _merged(df, filled, flag)


def _merged(df: DataFrame, filled: DataFrame, flag: bool) -> DataFrame:
    """The grid with filled values; an aggregate over the union, so no join order or null-safe key matters."""
    both = df.select(*KEYS, "ts", "value", F.lit(None).cast("double").alias("_f")).unionByName(
        filled.select(*KEYS, "ts", F.lit(None).cast("double").alias("value"), "_f")
    )
    d = both.groupBy(*KEYS, "ts").agg(F.max("value").alias("value"), F.max("_f").alias("_f"))
    out = d.select(
        *KEYS, "ts", F.coalesce("value", "_f").alias("value"), (_is_gap() & F.col("_f").isNotNull()).alias("imputed")
    )
    return out if flag else out.drop("imputed")


def _leap(year: Column) -> Column:
    return F.when((year % 4 == 0) & ((year % 100 != 0) | (year % 400 == 0)), 366).otherwise(365)


def week_cells(known: DataFrame, cut: str | None = None) -> DataFrame:
    """Running sums of known values by day of the year, one row per (component, ``_minute`` of the week, ``_year``).

    ``_days`` are the days that have values, in order; ``_s``, ``_n`` the sums and counts up to each, ``_es``, ``_en`` the same of
    the values before ``cut`` only.
    """
    early = (F.date_trunc("minute", "ts").cast("timestamp_ntz") < instant(cut)) if cut is not None else F.lit(True)
    minute = F.round(F.col("wn") * 1440).cast("bigint").alias("_minute")
    own = known.select(*KEYS, minute, F.year("ts").alias("_year"), (F.dayofyear("ts") - 1).alias("_d"), "value", early.alias("_early"))
    days = own.groupBy(*KEYS, "_minute", "_year", "_d").agg(
        F.sum("value").alias("s"),
        F.count(F.lit(1)).alias("n"),
        F.coalesce(F.sum(F.when(F.col("_early"), F.col("value"))), F.lit(0.0)).alias("es"),
        F.count(F.when(F.col("_early"), 1)).alias("en"),
    )
    cells = days.groupBy(*KEYS, "_minute", "_year").agg(F.sort_array(F.collect_list(F.struct("_d", "s", "n", "es", "en"))).alias("_c"))
    none = F.expr("cast(array() as array<struct<s:double,n:bigint,es:double,en:bigint>>)")
    start = F.struct(none.alias("all"), F.lit(0.0).alias("s"), F.lit(0).cast("bigint").alias("n"), F.lit(0.0).alias("es"), F.lit(0).cast("bigint").alias("en"))

    def add(acc, c):
        now = {k: acc[k] + c[k] for k in ("s", "n", "es", "en")}
        step = F.struct(*[v.alias(k) for k, v in now.items()])
        return F.struct(F.array_append(acc["all"], step).alias("all"), *[v.alias(k) for k, v in now.items()])

    run = F.aggregate("_c", start, add)["all"].alias("_run")
    cells = cells.select(*KEYS, "_minute", "_year", F.col("_c._d").alias("_days"), run)
    return cells.select(*KEYS, "_minute", "_year", "_days", *[F.col(f"_run.{k}").alias(f"_{k}") for k in ("s", "n", "es", "en")])


def _around(d: DataFrame, reach: int, name: str, limited: Column) -> DataFrame:
    """Add ``<name>_s`` and ``<name>_n``: sum and count of the cell's days at most ``reach`` from ``_yd``, around the turn of the year."""
    length = _leap(F.col("_year"))
    centre = F.pmod(F.col("_yd"), length)
    lo, hi = centre - reach, centre + reach
    # (last day of a run of days from the start of the year, sign)
    whole = F.lit(2 * reach + 1) >= length
    ends = [
        (F.when(whole, length - 1).otherwise(F.least(hi, length - 1)), 1),
        (F.when(whole, F.lit(-1)).otherwise(F.greatest(lo, F.lit(0)) - 1), -1),
        (F.when(~whole & (lo < 0), length - 1).otherwise(F.lit(-1)), 1),
        (F.when(~whole & (lo < 0), length + lo - 1).otherwise(F.lit(-1)), -1),
        (F.when(~whole & (hi > length - 1), hi - length).otherwise(F.lit(-1)), 1),
    ]
    upto = lambda end: F.size(F.filter("_days", lambda day: day <= end))
    d = d.withColumns({f"_i{j}": upto(end) for j, (end, _) in enumerate(ends)})

    def total(every: str, early: str) -> Column:
        sums = F.when(limited, F.col(early)).otherwise(F.col(every))
        out = F.lit(0)
        for j, (_, sign) in enumerate(ends):
            out = out + sign * F.when(F.col(f"_i{j}") > 0, F.element_at(sums, F.greatest(F.col(f"_i{j}"), F.lit(1)))).otherwise(F.lit(0))
        return out

    d = d.withColumns({f"{name}_s": total("_s", "_es"), f"{name}_n": total("_n", "_en")})
    return d.drop(*[f"_i{j}" for j in range(len(ends))])


def _history(todo, known, res, wncutoff, ycutoff, ydcutoff, cut, same_time_window) -> DataFrame:
    """Mean of the candidates of every missing value: ``(keys, ts, _hist)``."""
    m = F.round(F.col("wn") * 1440).cast("bigint")
    years = F.sequence(F.year("ts") - (ycutoff - 1), F.year("ts") + (ycutoff - 1))
    wide = int(wncutoff * 1440)  # 0 by default: minutes of the week must be equal
    near = [k for k in range(-wide, wide + 1) if abs(k) / 1440 < wncutoff]
    early = (F.col("ts") < instant(cut)) if cut is not None else F.lit(False)
    asked = todo.select(*KEYS, "ts", (F.dayofyear("ts") - 1).alias("_yd"), m.alias("_m"), early.alias("_limited"), F.explode(years).alias("_year"))
    asked = asked.withColumn("_minute", F.explode(F.array(*[F.col("_m") + F.lit(k) for k in near])))
    met = asked.join(week_cells(known, cut), [*KEYS, "_minute", "_year"])
    met = _around(met, ydcutoff - 1, "_w", F.col("_limited"))
    if same_time_window is not None:
        # values counted by the clock rule are left out of the week rule, so that none counts twice
        clock = F.pmod("_minute", F.lit(1440)) == F.pmod("_m", F.lit(1440))
        met = _around(met, min(-(-int(same_time_window * 1000) // 1000), ydcutoff) - 1, "_k", F.col("_limited"))
        met = met.withColumns({c: F.col(c) - F.when(clock, F.col(c.replace("_w", "_k"))).otherwise(F.lit(0)) for c in ("_w_s", "_w_n")})
    sums = met.select(*KEYS, "ts", F.col("_w_s").alias("_s"), F.col("_w_n").alias("_n")).filter("_n > 0")
    if same_time_window is not None:
        sums = sums.unionByName(_same_clock(todo, known, same_time_window, cut))
    return sums.groupBy(*KEYS, "ts").agg((F.sum("_s") / F.sum("_n")).alias("_hist"))


def _same_clock(todo, known, window, cut) -> DataFrame:
    """Sums of the known values at the same time of day, less than ``window`` days of the year away, in any year."""
    clock = F.pmod(epoch("ts"), F.lit(86400)).alias("_clock")
    year = F.year("ts")
    leap = _leap(year)
    early = (F.col("ts") < instant(cut)) if cut is not None else F.lit(True)
    days = known.groupBy(*KEYS, clock, (F.dayofyear("ts") - 1).alias("_cyd"), leap.alias("_len")).agg(
        F.sum("value").alias("_all_s"),
        F.count("value").alias("_all_n"),
        F.sum(F.when(early, F.col("value"))).alias("_cut_s"),
        F.count(F.when(early, F.col("value"))).alias("_cut_n"),
    )
    reach = min(-(-int(window * 1000) // 1000) - 1, 183)
    offsets = F.sequence(F.lit(-reach), F.lit(reach))
    asked = (
        todo.select(*KEYS, "ts", clock, (F.dayofyear("ts") - 1).alias("_yd"), early.alias("_early"))
        .withColumn("_len", F.explode(F.array(F.lit(365), F.lit(366))))
        .withColumn(
            "_cyd",
            F.explode(F.array_distinct(F.transform(offsets, lambda o: F.pmod(F.col("_yd") + o, F.col("_len"))))),
        )
    )
    limited = F.col("_early") if cut is not None else F.lit(False)
    return (
        asked.join(days, [*KEYS, "_clock", "_cyd", "_len"])
        .select(
            *KEYS,
            "ts",
            F.when(limited, F.col("_cut_s")).otherwise(F.col("_all_s")).alias("_s"),
            F.when(limited, F.col("_cut_n")).otherwise(F.col("_all_n")).alias("_n"),
        )
        .filter("_n > 0")
    )


def impute_recent(
    df: DataFrame,
    res: int | str,
    a: float = 0.3,
    first_days: int = 5,
    max_days: int = 19,
    cut: str | None = None,
    max_thr: int = -1,
    span: int | None = None,
    flag: bool = False,
) -> DataFrame:
    """Blend with the values at the same time of day on the preceding days of the year (any year).

    The window reaches ``first_days`` days back and grows until it finds a value, up to ``max_days``; without one the
    value stays missing. Known values are first summed per (component, time of day, day of year), so years collapse
    before the join and the join keys stay small.
    """
    res = seconds(res)
    d = _geometry(df, res, span)
    w = F.exp(F.lit(-a) * F.least("fwd", "bwd"))
    yday = F.dayofyear("ts")
    clock = F.pmod(epoch("ts"), F.lit(86400))
    before = (F.col("ts") < instant(cut)) if cut is not None else F.lit(True)
    todo = d.filter(_is_gap() & ~_too_long(max_thr)).select(
        *KEYS, "ts", w.alias("_w"), _linear().alias("_lin"), yday.alias("_yd"), clock.alias("_clock"), before.alias("_before")
    )
    days = (
        df.filter("value is not null")
        .groupBy(*KEYS, clock.alias("_clock"), yday.alias("_cyd"))
        .agg(
            F.sum("value").alias("_all_s"),
            F.count("value").alias("_all_n"),
            F.sum(F.when(before, F.col("value"))).alias("_cut_s"),
            F.count(F.when(before, F.col("value"))).alias("_cut_n"),
        )
    )
    asked = todo.withColumn("_back", F.explode(F.sequence(F.lit(1), F.lit(max_days)))).withColumn(
        "_cyd", F.col("_yd") - F.col("_back")
    )
    limited = F.col("_before") if cut is not None else F.lit(False)
    found = (
        asked.join(days, [*KEYS, "_clock", "_cyd"])
        .withColumn("_s", F.when(limited, F.col("_cut_s")).otherwise(F.col("_all_s")))
        .withColumn("_n", F.when(limited, F.col("_cut_n")).otherwise(F.col("_all_n")))
        .filter("_n > 0")
    )
    # at most max_days candidates per missing value, gathered in one small array
    per = found.groupBy(*KEYS, "ts").agg(
        F.first("_w").alias("_w"),
        F.first("_lin").alias("_lin"),
        F.collect_list(F.struct("_back", "_s", "_n")).alias("_c"),
    )
    reach = F.greatest(F.lit(first_days), F.array_min(F.transform("_c", lambda c: c["_back"])))
    used = F.filter("_c", lambda c: c["_back"] <= F.col("_reach"))
    total = lambda f: F.aggregate(F.col("_u"), F.lit(0.0), lambda acc, c: acc + c[f].cast("double"))
    filled = (
        per.withColumn("_reach", reach)
        .withColumn("_u", used)
        .select(*KEYS, "ts", (F.col("_w") * F.col("_lin") + (1 - F.col("_w")) * total("_s") / total("_n")).alias("_f"))
    )
    return _merged(df, filled, flag)


def imputed_report(flagged: DataFrame) -> DataFrame:
    """The filled values of an imputation run with ``flag=True``."""
    return flagged.filter("imputed").select(*KEYS, "ts", "value")


def null_ranges(df: DataFrame, res: int | str, span: int | None = None) -> DataFrame:
    """Remaining runs of missing values as inclusive ranges, one row per run."""
    res = seconds(res)
    d = _geometry(df, res, span).filter(_is_gap() & (F.col("fwd") == 1))
    last = F.col("ts") + F.expr("interval '1' second") * ((F.col("run_len") - 1) * res)
    return d.select(*KEYS, F.col("ts").alias("range_start"), last.alias("range_end"), F.col("run_len").alias("steps"))


