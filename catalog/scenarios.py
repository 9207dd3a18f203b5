"""Queries for joint components, models with covariates, scenarios and exact attribution."""

from __future__ import annotations

from itertools import product

import numpy as np
from pyspark.sql import functions as F

from tidewell.durable import stored
from tidewell.models import features, joint, paths, scenario, trees
from tidewell.models.linear import FixedLinear
from tidewell.operators import prep
from tidewell.plans import backtest, shapley

from .base import ev_stored, mean_rounded, mean_sql, multi_stored, register, rounded
from .flagship import START
from .forecasting import START_SQL, VAL, VAL_SQL

W = "OVER (PARTITION BY ts_id, id ORDER BY ts)"
PARTS = ["0", "1", "2"]


def covariates(multi, until=None):
    """Components 0 and 1 of the three as covariates ``t`` and ``u`` on a small scale; ``u`` may end earlier."""
    two = prep.stack(multi.filter("id in ('0', '1')"), ["0", "1"])
    u = F.col("1") / 100
    return two.select("ts_id", "ts", (F.col("0") / 100).alias("t"), (u if until is None else F.when(until, u)).alias("u"))


COVS = "SELECT ts_id, ts, max(value) FILTER (id = '0') / 100.0::DOUBLE AS t, max(value) FILTER (id = '1') / 100.0::DOUBLE AS u FROM multi_fill WHERE id < '2' GROUP BY 1, 2"


# --- training rows and coverage of models with covariates

ROWS_SQL = f"""SELECT ts_id, step, count(*) AS n, {mean_sql('sum(y)', 2)} AS y, {mean_sql('sum(l1)', 2)} AS lag_1, {mean_sql('sum(l2)', 2)} AS lag_2, {mean_sql('sum(tl)', 3)} AS t_lag_1, {mean_sql('sum(u0)', 3)} AS u_lead_0 FROM (
    SELECT ts_id, step::DOUBLE AS step, CASE step WHEN 1 THEN y0 ELSE y1 END AS y, l1, l2, tl, u0 FROM (
        SELECT ts_id, value AS y0, lead(value) {W} AS y1, lag(value) {W} AS l1, lag(value, 2) {W} AS l2, lag(t) {W} AS tl, u AS u0
        FROM ev_fill e LEFT JOIN ({COVS}) c USING (ts_id, ts)) CROSS JOIN (SELECT unnest([1, 2]) AS step))
    WHERE y IS NOT NULL AND l1 IS NOT NULL AND l2 IS NOT NULL AND tl IS NOT NULL AND u0 IS NOT NULL GROUP BY 1, 2"""


@register("m_04_training_rows", "ev_fill", "multi_fill", sql=ROWS_SQL)
def m_04_rows(spark, sf):
    """What forests and boosted trees with past and future covariates are fitted to."""
    d = ev_stored(spark, sf).join(covariates(multi_stored(spark, sf)), ["ts_id", "ts"], "left")
    rows = trees.training_rows(d, "1h", 2, 2, past={"t": 1}, future={"u": (0, 1)})
    out = rows.groupBy("ts_id", "step").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("y", "lag_1", "lag_2", "t_lag_1", "u_lead_0")])
    return mean_rounded(mean_rounded(out, "y", "lag_1", "lag_2", digits=2), "t_lag_1", "u_lead_0", digits=3)


COVERAGE = f"""SELECT m.model, ts_id, id, origins * 6 AS n, 0 AS n_missing FROM (
        SELECT ts_id, id, count(*) AS origins FROM (
            SELECT ts_id, id, unnest(generate_series(min(ts) FILTER (ts >= {START_SQL}), max(ts) - INTERVAL 5 HOUR, INTERVAL 6 HOUR)) AS origin FROM ev_fill GROUP BY 1, 2) GROUP BY 1, 2)
    CROSS JOIN (SELECT unnest(['forest', 'boosted']) AS model) m"""


@register("m_05_coverage", "ev_fill", sql=COVERAGE)
def m_05_coverage(spark, sf):
    """Every step of every origin gets a forecast from both kinds of trees, fitted with past covariates."""
    covs = covariates(multi_stored(spark, sf)).withColumnRenamed("t", "p").drop("u")
    d = ev_stored(spark, sf).join(covs, ["ts_id", "ts"], "left").fillna(0.0, ["p"])
    known = stored(d.filter(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz")), "known")
    origin = backtest.origins(d, "1h", START, 6)
    out = []
    for name, model in (
        ("forest", trees.fit_forest(known, "1h", 3, 6, trees=3, depth=3, past={"p": 1})),
        ("boosted", trees.fit_gbt(known, "1h", 3, 6, rounds=2, depth=2, past={"p": 1})),
    ):
        fc = trees.backtest_rows(model, d, "1h", origin)
        out.append(fc.groupBy("ts_id", "id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("yhat").isNull().cast("int")).alias("n_missing")).select(F.lit(name).alias("model"), "*"))
    return out[0].unionByName(out[1])


def _with_covariates(fit, **size):
    def query(spark, sf):
        covs = covariates(multi_stored(spark, sf))
        d = ev_stored(spark, sf)
        known = d.filter(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz")).join(covs, ["ts_id", "ts"], "left")
        model = fit(known, "1h", 24, 6, past={"t": 2}, future={"u": (1, 6)}, **size)
        fc = trees.predict_recursive(model, d, "1h", 12, backtest.origins(d, "1h", START, 12), covs)
        return mean_rounded(backtest.evaluate(d, fc, "1h", START, 12), "mae", "rmse").select("ts_id", "mae", "rmse")

    return query


register("m_04_forest_covariates")(_with_covariates(trees.fit_forest, trees=5, depth=4))
register("m_05_boosted_covariates")(_with_covariates(trees.fit_gbt, rounds=4, depth=3))


# --- joint components

JOINT_WIDE = "SELECT ts_id, ts, max(value) FILTER (id = '0') AS a, max(value) FILTER (id = '1') AS b, max(value) FILTER (id = '2') AS c FROM multi_fill GROUP BY 1, 2"
JOINT_ROWS = f"""WITH w AS ({JOINT_WIDE}),
    l AS (SELECT *, lag(a, 1) OVER o AS a1, lag(b, 1) OVER o AS b1, lag(c, 1) OVER o AS c1, lag(a, 24) OVER o AS a24, lag(b, 24) OVER o AS b24, lag(c, 24) OVER o AS c24,
        lead(a) OVER o AS an, lead(b) OVER o AS bn, lead(c) OVER o AS cn FROM w WINDOW o AS (PARTITION BY ts_id ORDER BY ts)),
    x AS (SELECT ts_id, target::INTEGER AS target, step::DOUBLE AS step, [[a, an], [b, bn], [c, cn]][target + 1][step] AS y, a1, b1, c1, a24, b24, c24
        FROM l CROSS JOIN (SELECT unnest([0, 1, 2]) AS target) CROSS JOIN (SELECT unnest([1, 2]) AS step))
    SELECT ts_id, target, step, count(*) AS n, {mean_sql('sum(y)', 2)} AS y, {mean_sql('sum(a1)', 2)} AS c0_lag_1, {mean_sql('sum(b24)', 2)} AS c1_lag_24, {mean_sql('sum(c1)', 2)} AS c2_lag_1 FROM x
    WHERE y IS NOT NULL AND a1 IS NOT NULL AND b1 IS NOT NULL AND c1 IS NOT NULL AND a24 IS NOT NULL AND b24 IS NOT NULL AND c24 IS NOT NULL GROUP BY 1, 2, 3"""


@register("m_04_joint_rows", "multi_fill", sql=JOINT_ROWS)
def m_04_joint(spark, sf):
    rows = joint.joint_rows(multi_stored(spark, sf), "1h", PARTS, [1, 24], 2)
    out = rows.groupBy("ts_id", "target", "step").agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in ("y", "c0_lag_1", "c1_lag_24", "c2_lag_1")])
    return mean_rounded(out, "y", "c0_lag_1", "c1_lag_24", "c2_lag_1", digits=2)


@register("m_05_joint_boosted")
def m_05_joint(spark, sf):
    """Boosted trees for three components from the lags of all, from the end of the known part."""
    d = multi_stored(spark, sf)
    known = d.filter(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz"))
    model = joint.fit_joint(known, "1h", PARTS, [1, 2, 24], 4, kind="boosted", size=3, depth=3)
    origin = backtest.origins(d.filter("id = '0'"), "1h", START, 12)
    fc = joint.predict_joint(model, d, "1h", 12, origin).drop("reason")
    return mean_rounded(backtest.evaluate(d, fc, "1h", START, 12), "mae", "rmse").select("ts_id", "mae", "rmse")


MIX = {
    "0": {"": 1.0, "c0_lag_1": 0.5, "c1_lag_24": 0.25},
    "1": {"": 2.0, "c0_lag_1": -0.25, "c1_lag_1": 0.5, "c2_lag_24": 0.5},
    "2": {"c2_lag_1": 0.75, "c0_lag_24": 0.2},
}
NEXT = ["1 + 0.5::DOUBLE * h[24].a + 0.25::DOUBLE * h[1].b", "2 - 0.25::DOUBLE * h[24].a + 0.5::DOUBLE * h[24].b + 0.5::DOUBLE * h[1].c", "0.75::DOUBLE * h[24].c + 0.2::DOUBLE * h[1].a"]
JOINT_PATH = f"""WITH RECURSIVE w AS ({JOINT_WIDE}),
    o AS (SELECT ts_id, unnest(generate_series(min(ts) FILTER (ts >= {START_SQL}), max(ts) - INTERVAL 23 HOUR, INTERVAL 24 HOUR)) AS origin FROM multi_fill WHERE id = '0' GROUP BY 1),
    s AS (SELECT o.ts_id, origin, list({{'a': a, 'b': b, 'c': c}} ORDER BY w.ts) AS h, count(*) < 24 AS short, NOT bool_and(a IS NOT NULL AND b IS NOT NULL AND c IS NOT NULL) AS gap
        FROM o JOIN w ON w.ts_id = o.ts_id AND w.ts < origin AND w.ts >= origin - INTERVAL 24 HOUR GROUP BY 1, 2),
    p AS (SELECT ts_id, origin, 0 AS step, h, CASE WHEN short THEN 'short' WHEN gap THEN 'missing' END AS reason FROM s
        UNION ALL SELECT ts_id, origin, step + 1, list_append(h[2:], CASE WHEN reason IS NULL THEN {{'a': {NEXT[0]}, 'b': {NEXT[1]}, 'c': {NEXT[2]}}} END), reason FROM p WHERE step < 12)
    SELECT ts_id, i AS id, origin, step, origin + to_hours((step - 1)::INTEGER) AS ts, round(CASE WHEN reason IS NULL THEN CASE i WHEN '0' THEN h[-1].a WHEN '1' THEN h[-1].b ELSE h[-1].c END END, 3) AS yhat, reason
    FROM p CROSS JOIN (SELECT unnest(['0', '1', '2']) AS i) WHERE step > 0"""


@register("m_07_joint_recursion", "multi_fill", sql=JOINT_PATH)
def m_07_joint(spark, sf):
    """Three components of given weights, fed back together from every origin."""
    d = multi_stored(spark, sf)
    origin = backtest.origins(d.filter("id = '0'"), "1h", START, 24)
    model = joint.fixed_joint(MIX.__getitem__, PARTS, [1, 24])
    return rounded(joint.predict_joint(model, d, "1h", 12, origin), "yhat", digits=3)


FIXED = {"": 3.0, "lag_1": 0.5, "lag_24": 0.45}
FIXED_PATH = f"""WITH RECURSIVE s AS (SELECT ts_id, id, max(ts) AS t0, list(value ORDER BY ts)[-24:] AS h FROM ev_fill WHERE ts < {START_SQL} GROUP BY 1, 2),
    p AS (SELECT ts_id, id, t0, 0 AS step, h FROM s UNION ALL
        SELECT ts_id, id, t0, step + 1, list_append(h[2:], 3 + 0.5::DOUBLE * h[24] + 0.45::DOUBLE * h[1]) FROM p WHERE step < 30)
    SELECT ts_id, id, t0 + INTERVAL 1 HOUR AS origin, step, t0 + to_hours(step) AS ts, round(h[24], 3) AS yhat, NULL::VARCHAR AS reason FROM p WHERE step > 0"""


@register("m_07_fixed_recursion", "ev_fill", sql=FIXED_PATH)
def m_07_fixed(spark, sf):
    known = ev_stored(spark, sf).filter(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz"))
    return rounded(trees.predict_recursive(FixedLinear(FIXED, [1, 24]), known, "1h", 30), "yhat", digits=3)


WALK = f"""WITH RECURSIVE s AS (SELECT ts_id, id, max(ts) AS t0, arg_max(value, ts) AS y FROM ev_fill WHERE ts < {START_SQL} GROUP BY 1, 2),
    p AS (SELECT ts_id, id, t0, 0 AS step, y FROM s UNION ALL SELECT ts_id, id, t0, step + 1, 5 + 0.9::DOUBLE * y + length(ts_id) FROM p WHERE step < 12)
    SELECT ts_id, id, t0 + INTERVAL 1 HOUR AS origin, step, t0 + to_hours(step) AS ts, round(y, 3) AS q_10, round(y, 3) AS q_90 FROM p WHERE step > 0"""


@register("m_10_recursive_paths", "ev_fill", sql=WALK)
def m_10_recursive(spark, sf):
    """Paths with residuals inside the recursion; all residuals of a component are equal, so its paths are known."""
    known = ev_stored(spark, sf).filter(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz"))
    e = known.select("ts_id", "id", "ts", F.length("ts_id").cast("double").alias("e"))
    drawn = paths.recursive_paths(FixedLinear({"": 5.0, "lag_1": 0.9}, 1), known, e, "1h", 12, 7, seed=2)
    return rounded(paths.quantiles(drawn, [0.1, 0.9]), "q_10", "q_90", digits=3)


# --- scenarios

SCENE = {"": 0.05, "lag_1": 0.4, "lag_24": 0.3, "t_lag_1": 0.1, "u_lead_0": 0.2}
SCENE_Y = "0.05 + 0.4::DOUBLE * h[24] + 0.3::DOUBLE * h[1] + 0.1::DOUBLE * b.t + 0.2::DOUBLE * CASE WHEN step + 1 BETWEEN 3 AND 5 THEN 1.5 ELSE a.u END"
SCENE_SQL = f"""WITH RECURSIVE sc AS (SELECT ts_id, id, min(value) AS lo, max(value) AS hi FROM ev_fill WHERE ts < {VAL_SQL} GROUP BY 1, 2),
    s AS (SELECT ts_id, id, max(ts) AS t0, list((value - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END ORDER BY ts)[-24:] AS h FROM ev_fill JOIN sc USING (ts_id, id) WHERE ts < {START_SQL} GROUP BY 1, 2),
    c AS (SELECT ts_id, ts, t, CASE WHEN ts < {START_SQL} + to_hours((2 * length(ts_id))::INTEGER) THEN u END AS u FROM ({COVS})),
    p AS (SELECT ts_id, id, t0, 0 AS step, h FROM s UNION ALL
        SELECT p.ts_id, p.id, t0, step + 1, list_append(h[2:], {SCENE_Y}) FROM p
        LEFT JOIN c a ON a.ts_id = p.ts_id AND a.ts = t0 + to_hours(step + 1) LEFT JOIN c b ON b.ts_id = p.ts_id AND b.ts = t0 + to_hours(step) WHERE step < 24)
    SELECT ts_id, id, t0 + INTERVAL 1 HOUR AS origin, step, t0 + to_hours(step) AS ts, round(h[24] * CASE WHEN hi = lo THEN 1 ELSE hi - lo END + lo, 3) AS yhat,
        CASE WHEN h[24] IS NULL THEN 'covariates: u' END AS reason FROM p JOIN sc USING (ts_id, id) WHERE step > 0"""


def _scene(spark, sf):
    multi, d = multi_stored(spark, sf), ev_stored(spark, sf)
    start = F.lit("2024-01-22").cast("timestamp_ntz")
    ends = F.col("ts") < start + F.expr("interval '1' hour") * (2 * F.length("ts_id"))
    return d.filter(F.col("ts") < start), prep.fit_minmax(prep.split(d, VAL, START)), covariates(multi, ends)


@register("m_09_scenario", "ev_fill", "multi_fill", sql=SCENE_SQL)
def m_09_scenario(spark, sf):
    """Given weights, scaled, with covariates of which one ends, and a scenario that sets it in three hours."""
    known, scaler, covs = _scene(spark, sf)
    hours = known.select("ts_id").distinct().withColumn("_h", F.explode(F.array(*map(F.lit, (2, 3, 4)))))
    changes = hours.select("ts_id", (F.lit("2024-01-22").cast("timestamp_ntz") + F.expr("interval '1' hour") * F.col("_h")).alias("ts"), F.lit(1.5).alias("u"))
    model = FixedLinear(SCENE, [1, 24], past={"t": 1}, future={"u": (0, 1)})
    return rounded(trees.forecast(known, model, scaler, "1h", 24, covs=covs, changes=changes), "yhat", digits=3)


@register(
    "m_09_covariate_reach",
    "ev_fill",
    "multi_fill",
    sql=f"""WITH e AS (SELECT ts_id, id, max(ts) AS t0 FROM ev_fill WHERE ts < {START_SQL} GROUP BY 1, 2),
        k AS (SELECT ts_id, 't' AS covariate, ts FROM ({COVS}) WHERE t IS NOT NULL UNION ALL
            SELECT ts_id, 'u', ts FROM ({COVS}) WHERE u IS NOT NULL AND ts < {START_SQL} + to_hours((2 * length(ts_id))::INTEGER)),
        n AS (SELECT ts_id, id, t0, covariate, s, unnest(CASE covariate WHEN 't' THEN [-2, -1] ELSE [0, 1, 2] END) AS o FROM e
            CROSS JOIN (SELECT unnest(['t', 'u']) AS covariate) CROSS JOIN (SELECT unnest(range(1, 37, 3)) AS s)),
        m AS (SELECT n.*, k.ts AS hit FROM n LEFT JOIN k ON k.ts_id = n.ts_id AND k.covariate = n.covariate AND k.ts = t0 + to_hours((s + o)::INTEGER))
        SELECT m.ts_id, m.id, m.covariate, any_value(u.known_until) AS known_until, (coalesce(min(s) FILTER (hit IS NULL), 37) - 1)::INTEGER AS steps
        FROM m LEFT JOIN (SELECT ts_id, covariate, max(ts) AS known_until FROM k GROUP BY 1, 2) u ON u.ts_id = m.ts_id AND u.covariate = m.covariate GROUP BY 1, 2, 3""",
)
def m_09_reach(spark, sf):
    known, _, covs = _scene(spark, sf)
    model = FixedLinear({}, 1, 3, past={"t": 2}, future={"u": (0, 3)})
    return scenario.covariate_reach(model, covs, known.groupBy("ts_id", "id").agg(F.max("ts").alias("last_ts")), 3600, 36)


# --- exact attribution

INF = np.inf
A, B, C = 150.0, 170.0, 130.0  # thresholds of lag_1, lag_2 and lag_24
TREES = [
    shapley.leaf({0: (-INF, A), 2: (-INF, C)}, 1.0),
    shapley.leaf({0: (-INF, A), 2: (C, INF)}, 4.0),
    shapley.leaf({0: (A, INF), 1: (-INF, B)}, 2.0),
    shapley.leaf({0: (A, INF), 1: (B, INF)}, 8.0),
    shapley.leaf({2: (-INF, B)}, -1.0),
    shapley.leaf({0: (-INF, C), 2: (B, INF)}, 0.5),
    shapley.leaf({0: (C, INF), 2: (B, INF)}, 3.0),
]
GROUND = {"lag_1": 140.0, "lag_2": 140.0, "lag_24": 140.0}
INPUTS = ["lag_1", "lag_2", "lag_24"]


def _tree_sql(x: str, y: str, z: str) -> str:
    return (
        f"(CASE WHEN {x} <= {A} THEN CASE WHEN {z} <= {C} THEN 1.0 ELSE 4.0 END ELSE CASE WHEN {y} <= {B} THEN 2.0 ELSE 8.0 END END"
        f" + CASE WHEN {z} <= {B} THEN -1.0 ELSE CASE WHEN {x} <= {C} THEN 0.5 ELSE 3.0 END END)::DOUBLE"
    )


def _subsets_sql() -> str:
    """Values of all eight coalitions, then the definition."""
    v = {m: _tree_sql(*(c if on else "140.0" for c, on in zip(INPUTS, m, strict=True))) for m in product((0, 1), repeat=3)}
    names = {m: "v" + "".join(map(str, m)) for m in v}
    rows = ", ".join(f"{sql} AS {names[m]}" for m, sql in v.items())
    parts = []
    for i, c in enumerate(INPUTS):
        terms = []
        for m in v:
            if not m[i]:
                on = tuple(1 if j == i else k for j, k in enumerate(m))
                terms.append(f"{2 if sum(m) != 1 else 1} * ({names[on]} - {names[m]})")
        parts.append(f"SELECT row_key, '{c}' AS feature, round(({' + '.join(terms)}) / 6, 4) AS attribution FROM v")
    src = f"SELECT ts_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS row_key, lag(value) {W} AS lag_1, lag(value, 2) {W} AS lag_2, lag(value, 24) {W} AS lag_24 FROM ev_fill"
    return f"WITH v AS (SELECT row_key, {rows} FROM ({src}) WHERE lag_24 IS NOT NULL) {' UNION ALL '.join(parts)}"


def _lag_rows(spark, sf):
    d = features.lag_features(ev_stored(spark, sf), "1h", [1, 2, 24]).dropna(subset=INPUTS)
    return d.withColumn("row_key", F.concat_ws("|", "ts_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss")))


@register("x_03_exact_trees", "ev_fill", sql=_subsets_sql())
def x_03_exact(spark, sf):
    """Every row and feature: a closed form over leaves here, all subsets in SQL."""
    return rounded(shapley.attribute_exact(TREES, _lag_rows(spark, sf), INPUTS, GROUND), "attribution")


@register(
    "x_03_exact_linear",
    "ev_fill",
    sql=f"""SELECT row_key, feature, {mean_sql('w * (x - 140)', 3)} AS attribution FROM (
        SELECT row_key, unnest([lag_1, lag_2, lag_24]) AS x, unnest(['lag_1', 'lag_2', 'lag_24']) AS feature, unnest([0.3, -0.7, 0.9]::DOUBLE[]) AS w FROM (
            SELECT ts_id || '|' || strftime(ts, '%Y-%m-%d %H:%M:%S') AS row_key, lag(value) {W} AS lag_1, lag(value, 2) {W} AS lag_2, lag(value, 24) {W} AS lag_24 FROM ev_fill)
        WHERE lag_24 IS NOT NULL)""",
)
def x_03_linear(spark, sf):
    model = FixedLinear({"lag_1": 0.3, "lag_2": -0.7, "lag_24": 0.9}, [1, 2, 24])
    return mean_rounded(shapley.attribute_exact(model, _lag_rows(spark, sf), INPUTS, GROUND), "attribution", digits=3)


@register("x_03_exact_forest")
def x_03_forest(spark, sf):
    """A fitted forest with covariates, all steps: mean absolute attribution of each feature and step."""
    covs = covariates(multi_stored(spark, sf))
    d = ev_stored(spark, sf).join(covs, ["ts_id", "ts"], "left")
    known = d.filter(F.col("ts") < F.lit("2024-01-22").cast("timestamp_ntz"))
    model = trees.fit_forest(known, "1h", 6, 4, trees=4, depth=4, past={"t": 1}, future={"u": (0, 2)})
    rows = trees.training_rows(d, "1h", 6, 4, model.past, model.future).withColumn("row_key", F.concat_ws("|", "ts_id", F.col("ts").cast("string"), "step"))
    ground = {c: (10.0 if c[0] in "tu" else 140.0) for c in model.inputs if c != "step"}  # the step is no player
    parts = shapley.attribute_exact(model, rows, model.inputs, ground)
    step = F.element_at(F.split("row_key", r"\|"), -1).cast("double").alias("step")
    return rounded(parts.groupBy("feature", step).agg(F.avg(F.abs("attribution")).alias("importance")), "importance")
