"""Registered queries: metrics, candidate scoring, blending and scans
(A18-A24, M10, M11, M16-M18, W1, O1)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..models import blend as bl
from ..models import folds as fo
from ..operators import metrics as me
from ..operators import setops as so
from ..sources import fixtures as fx
from .oracle_views import with_views
from .registry import query

MODELS = [m for m, _, _ in fx.PRED_MODELS]
TARGETS = ["ta", "ec", "drp"]
# Fixed scenario metadata: number of features each run was trained on.
FEATURE_COUNTS = {"m1": 12, "m2": 20, "m3": 35}


def r6(c):
    return F.round(c, 6)


def _r2_sql(y: str, p: str, mask: str | None = None) -> str:
    if mask is None:
        return f"(1 - sum(({y} - {p}) * ({y} - {p})) / (count({y}) * var_pop({y})))"
    yy, pp = f"CASE WHEN {mask} THEN {y} END", f"CASE WHEN {mask} THEN {p} END"
    return f"(1 - sum(({yy} - {pp}) * ({yy} - {pp})) / (count({yy}) * var_pop({yy})))"


# ------------------------------------------------------------------ A18-A20
@query("r2_rmse_mae", with_views(f"""
SELECT model, count(y) AS n, round({_r2_sql('y', 'pred')}, 6) AS r2,
       round(greatest({_r2_sql('y', 'pred')}, 0.0), 6) AS r2_floor,
       round(sqrt(sum((y - pred) * (y - pred)) / count(y)), 6) AS rmse, round(avg(abs(y - pred)), 6) AS mae
FROM v_pred GROUP BY model""", "v_pred"))
def r2_rmse_mae_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = me.r2_rmse_mae(fx.predictions(spark, sf_dir), "y", "pred", "model")
    return m.select("model", "n", *[r6(F.col(c)).alias(c) for c in ("r2", "r2_floor", "rmse", "mae")])


@query("fold_metrics", with_views(f"""
SELECT model, fold, count(y) AS n, round({_r2_sql('y', 'pred')}, 6) AS r2,
       round(sqrt(sum((y - pred) * (y - pred)) / count(y)), 6) AS rmse
FROM v_pred GROUP BY GROUPING SETS ((model, fold), (model))""", "v_pred"))
def fold_metrics_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = me.fold_metrics(fx.predictions(spark, sf_dir), "y", "pred", "model", "fold")
    return m.select("model", "fold", "n", r6(F.col("r2")).alias("r2"), r6(F.col("rmse")).alias("rmse"))


@query("macro_average", with_views(f"""
SELECT round(avg(r2), 6) AS macro_r2, count(*) AS n_parts
FROM (SELECT model, {_r2_sql('y', 'pred')} AS r2 FROM v_pred GROUP BY model) x""", "v_pred"))
def macro_average_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = me.r2_rmse_mae(fx.predictions(spark, sf_dir), "y", "pred", "model")
    a = me.macro_average(m, "r2")
    return a.select(r6(F.col("macro_r2")).alias("macro_r2"), "n_parts")


# ------------------------------------------------------------------ A21-A24
def run_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per run: pooled R² per target, their mean (`avg_spatial`), the
    hold-out score (`public_score`: the M1 test split stands for the
    external set) and the run's feature count."""
    sub = fx.submissions(spark, sf_dir)
    truth = fx.samples(spark, sf_dir).select("sample_id", *[F.col(t).alias(f"y_{t}") for t in TARGETS])
    j = sub.join(truth, "sample_id")
    ext = F.pmod(fo.int_hash("sample_id", 42), F.lit(100)) >= 70  # the M1 hold-out rows
    aggs = []
    for t in TARGETS:
        aggs.append(me.regression_metrics(f"y_{t}", t)[1].alias(f"r2_{t}"))
        aggs.append(me.regression_metrics(F.when(ext, F.col(f"y_{t}")), F.when(ext, F.col(t)))[1].alias(f"ext_{t}"))
    p = j.groupBy("run").agg(*aggs)
    fc = F.lit(None).cast("int")
    for r, n in FEATURE_COUNTS.items():
        fc = F.when(F.col("run") == r, F.lit(n)).otherwise(fc)
    return p.select("run", *[f"r2_{t}" for t in TARGETS],
                    ((F.col("r2_ta") + F.col("r2_ec") + F.col("r2_drp")) / 3).alias("avg_spatial"),
                    ((F.col("ext_ta") + F.col("ext_ec") + F.col("ext_drp")) / 3).alias("public_score"),
                    fc.alias("feature_count"))


PROFILES_SQL = [
    ("j", """SELECT u.run, u.sample_id, s.ta AS y_ta, s.ec AS y_ec, s.drp AS y_drp, u.ta, u.ec, u.drp
             FROM v_sub u JOIN v_sample s ON u.sample_id = s.sample_id"""),
    ("prof0", "SELECT run, " + ", ".join(
        f"{_r2_sql('y_' + t, t)} AS r2_{t}, {_r2_sql('y_' + t, t, fo.int_hash_sql('sample_id', 42) + ' % 100 >= 70')} AS ext_{t}" for t in TARGETS)
     + " FROM j GROUP BY run"),
    ("prof", """SELECT run, r2_ta, r2_ec, r2_drp, (r2_ta + r2_ec + r2_drp) / 3 AS avg_spatial,
                (ext_ta + ext_ec + ext_drp) / 3 AS public_score,
                CASE run WHEN 'm1' THEN 12 WHEN 'm2' THEN 20 WHEN 'm3' THEN 35 END AS feature_count FROM prof0"""),
]


def _dist_sql() -> list[tuple[str, str]]:
    mad = ", ".join(f"avg(abs(c.{t} - a.{t})) AS mad_{t}" for t in TARGETS)
    stats = ", ".join(f"avg({t}) AS m_{t}, stddev_samp({t}) AS s_{t}" for t in TARGETS)
    total = "0.0"
    for t, w in me.TARGET_WEIGHTS.items():
        s = f"(sa.s_{t} + 1e-6)"
        total += (f" + {w} * mad_{t} / {s} + {me.MEAN_TERM * w} * abs(sc.m_{t} - sa.m_{t}) / {s}"
                  f" + {me.STD_TERM * w} * abs(sc.s_{t} - sa.s_{t}) / {s}")
    return [
        ("pr", f"""SELECT c.run AS candidate, a.run AS anchor, {mad},
                   max(greatest({', '.join(f'abs(c.{t} - a.{t})' for t in TARGETS)})) AS max_abs_diff
                   FROM v_sub c JOIN v_sub a ON c.sample_id = a.sample_id AND c.run <> a.run GROUP BY 1, 2"""),
        ("st", f"SELECT run, {stats} FROM v_sub GROUP BY run"),
        ("dist", f"""SELECT pr.candidate, pr.anchor, {total} AS distance, pr.max_abs_diff
                     FROM pr JOIN st sc ON sc.run = pr.candidate JOIN st sa ON sa.run = pr.anchor"""),
    ]


def _distances(spark, sf_dir) -> DataFrame:
    return me.candidate_distance(fx.submissions(spark, sf_dir), "run", MODELS)


@query("candidate_distance", with_views("""
SELECT candidate, anchor, round(distance, 6) AS distance, round(max_abs_diff, 6) AS max_abs_diff FROM dist""",
                                        "v_sub", extra=_dist_sql()))
def candidate_distance_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _distances(spark, sf_dir)
    return d.select("candidate", "anchor", r6(F.col("distance")).alias("distance"),
                    r6(F.col("max_abs_diff")).alias("max_abs_diff"))


IDW_SQL = """SELECT candidate,
   CASE WHEN count(*) FILTER (WHERE max_abs_diff = 0) > 0 THEN min_by(public_score, CASE WHEN max_abs_diff = 0 THEN anchor END)
        ELSE sum((1.0 / (distance + 1e-6)) * public_score) / sum(1.0 / (distance + 1e-6)) END AS submission_estimate
   FROM dist JOIN prof ON dist.anchor = prof.run GROUP BY candidate"""


def _sub_estimate(spark, sf_dir) -> DataFrame:
    prof = run_profiles(spark, sf_dir).select("run", F.col("public_score").alias("score"))
    return me.idw_estimate(_distances(spark, sf_dir), prof, "score")


@query("idw_estimate", with_views("SELECT candidate, round(submission_estimate, 6) AS submission_estimate FROM idw",
                                  "v_sub", "v_sample", extra=PROFILES_SQL + _dist_sql() + [("idw", IDW_SQL)]))
def idw_estimate_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _sub_estimate(spark, sf_dir)
    return e.select("candidate", r6(F.col("submission_estimate")).alias("submission_estimate"))


def _profile_sql() -> str:
    terms = ("((c.avg_spatial - a.avg_spatial) / 0.018) * ((c.avg_spatial - a.avg_spatial) / 0.018)"
             " + ((c.feature_count - a.feature_count) / 10.0) * ((c.feature_count - a.feature_count) / 10.0)")
    for t, s in me.TARGET_SCALE.items():
        terms += f" + ((c.r2_{t} - a.r2_{t}) / {s}) * ((c.r2_{t} - a.r2_{t}) / {s})"
    wgt = f"(1.0 / (sqrt({terms}) + 1e-6) * CASE WHEN a.public_score >= 0.34 THEN 1.15 ELSE 1.0 END)"
    return f"""
g AS (SELECT d.candidate, sum({wgt} * a.public_score) / sum({wgt}) AS weighted_score,
             max(a.feature_count) AS max_anchor_features, first(c.feature_count) AS feature_count,
             first(c.r2_ta) AS r2_ta, first(c.r2_ec) AS r2_ec, first(c.r2_drp) AS r2_drp
      FROM dist d JOIN prof c ON c.run = d.candidate JOIN prof a ON a.run = d.anchor GROUP BY d.candidate),
m AS (SELECT g.*, least(greatest(weighted_score - greatest(feature_count - max_anchor_features, 0) * 0.0015
        + (CASE WHEN r2_drp >= 0.17 THEN 0.006 ELSE 0.0 END + CASE WHEN r2_ec >= 0.32 THEN 0.006 ELSE 0.0 END
           + CASE WHEN r2_ta >= 0.40 THEN 0.004 ELSE 0.0 END + CASE WHEN r2_drp < 0.10 THEN -0.010 ELSE 0.0 END),
        0.0), 1.0) AS metric_estimate FROM g)
SELECT m.candidate, round(m.weighted_score, 6) AS weighted_score, round(m.metric_estimate, 6) AS metric_estimate,
       round(idw.submission_estimate, 6) AS submission_estimate,
       round(CASE WHEN idw.submission_estimate IS NULL THEN m.metric_estimate
             ELSE least(greatest(0.45 * m.metric_estimate + 0.55 * idw.submission_estimate, 0.0), 1.0) END, 6)
         AS estimate
FROM m LEFT JOIN idw ON m.candidate = idw.candidate"""


def _score_profile_full_sql() -> str:
    base = with_views("SELECT 1", "v_sub", "v_sample", extra=PROFILES_SQL + _dist_sql() + [("idw", IDW_SQL)])
    return base[: base.rindex("SELECT 1")].rstrip() + ",\n" + _profile_sql()


@query("score_profile", _score_profile_full_sql())
def score_profile_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = _distances(spark, sf_dir).select("candidate", "anchor")
    s = me.score_profile(pairs, run_profiles(spark, sf_dir), _sub_estimate(spark, sf_dir))
    return s.select("candidate", *[r6(F.col(c)).alias(c) for c in
                                   ("weighted_score", "metric_estimate", "submission_estimate", "estimate")])


@query("prediction_summary", with_views("SELECT run, " + ", ".join(
    f"round(avg({t}), 6) AS {t}_mean, round(stddev_samp({t}), 6) AS {t}_std" for t in TARGETS)
    + " FROM v_sub GROUP BY run", "v_sub"))
def prediction_summary_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = me.prediction_summary(fx.submissions(spark, sf_dir), "run", TARGETS)
    return s.select("run", *[r6(F.col(c)).alias(c) for c in s.columns if c != "run"])


# ------------------------------------------------------------------ M10, M11, M16, M17
@query("fold_mean_prediction", with_views("""
SELECT sample_id, round(avg(pred), 6) AS pred_mean, count(*) AS n_models FROM v_pred GROUP BY sample_id""", "v_pred"))
def fold_mean_prediction_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = bl.fold_mean_prediction(fx.predictions(spark, sf_dir))
    return m.select("sample_id", r6(F.col("pred_mean")).alias("pred_mean"), "n_models")


@query("stack_features", with_views("""
SELECT p.sample_id, round(max(CASE WHEN model = 'm1' THEN pred END), 6) AS pred_m1,
       round(max(CASE WHEN model = 'm2' THEN pred END), 6) AS pred_m2,
       round(max(CASE WHEN model = 'm3' THEN pred END), 6) AS pred_m3, a.blue, a.green
FROM v_pred p LEFT JOIN v_api a ON p.sample_id = a.sample_id GROUP BY p.sample_id, a.blue, a.green""",
                                    "v_pred", "v_api"))
def stack_features_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    pas = fx.api_optics(spark, sf_dir).select("sample_id", "blue", "green")
    s = bl.stack_features(fx.predictions(spark, sf_dir), MODELS, passthrough=pas)
    return s.select("sample_id", *[r6(F.col(f"pred_{m}")).alias(f"pred_{m}") for m in MODELS], "blue", "green")


@query("linear_calibration", with_views(f"""
SELECT c.model, round(c.slope, 6) AS slope, round(c.intercept, 6) AS intercept,
       round({_r2_sql('p.y', 'p.pred')}, 6) AS r2_raw,
       round({_r2_sql('p.y', '(c.slope * p.pred + c.intercept)')}, 6) AS r2_cal
FROM v_pred p JOIN (SELECT model, regr_slope(y, pred) AS slope, regr_intercept(y, pred) AS intercept
                    FROM v_pred GROUP BY model) c ON p.model = c.model
GROUP BY c.model, c.slope, c.intercept""", "v_pred"))
def linear_calibration_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.predictions(spark, sf_dir)
    coef = bl.linear_calibration(p, "y", "pred", ["model"])
    cal = bl.apply_calibration(p, coef, "pred", ["model"])
    out = cal.groupBy("model", "slope", "intercept").agg(
        me.regression_metrics("y", "pred")[1].alias("r2_raw"), me.regression_metrics("y", "pred_cal")[1].alias("r2_cal"))
    return out.select("model", *[r6(F.col(c)).alias(c) for c in ("slope", "intercept", "r2_raw", "r2_cal")])


BLEND_WEIGHTS = dict(zip(MODELS, bl.TARGET_BLEND_WEIGHTS["ta"]))


@query("weighted_blend", with_views("""
SELECT sample_id, round(sum(CASE model WHEN 'm1' THEN 0.4 WHEN 'm2' THEN 0.4 WHEN 'm3' THEN 0.2 ELSE 0.0 END * pred), 6)
         AS blend
FROM v_pred WHERE model IN ('m1', 'm2', 'm3') GROUP BY sample_id""", "v_pred"))
def weighted_blend_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bl.weighted_blend(fx.predictions(spark, sf_dir), BLEND_WEIGHTS)
    return b.select("sample_id", r6(F.col("blend")).alias("blend"))


TARGET_WEIGHTS = {t: dict(zip(MODELS, w)) for t, w in bl.TARGET_BLEND_WEIGHTS.items()}


def _target_blend_sql(target: str) -> str:
    cases = " ".join(f"WHEN '{m}' THEN {w}" for m, w in TARGET_WEIGHTS[target].items())
    return f"round(sum(CASE run {cases} END * {target}), 6) AS {target}"


@query("target_blends", with_views(f"""
SELECT sample_id, {', '.join(_target_blend_sql(t) for t in TARGET_WEIGHTS)} FROM v_sub GROUP BY sample_id""", "v_sub"))
def target_blends_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = bl.target_blends(fx.submissions(spark, sf_dir), TARGET_WEIGHTS)
    return b.select("sample_id", *[r6(F.col(t)).alias(t) for t in TARGET_WEIGHTS])


@query("blend_series", with_views("""
SELECT sample_id, round((CAST(1 AS DOUBLE) - CAST(0.35 AS DOUBLE)) * max(CASE WHEN model = 'm1' THEN pred END)
                        + CAST(0.35 AS DOUBLE) * max(CASE WHEN model = 'm2' THEN pred END), 8) AS blend
FROM v_pred GROUP BY sample_id""", "v_pred"))
def blend_series_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fx.predictions(spark, sf_dir).groupBy("sample_id").pivot("model", MODELS).agg(F.first("pred"))
    # the inputs' decimals make ties at the seventh place; eight keep both engines off them
    return wide.select("sample_id", F.round(bl.blend_series(F.col("m1"), F.col("m2"), 0.35), 8).alias("blend"))


# ------------------------------------------------------------------ M18, W1, O1
SCAN_WEIGHTS = [i / 20 for i in range(21)]
VARIANTS = ["m2", "m3"]

SCAN_SQL = [
    ("w", """SELECT sample_id, max(y) AS y, max(CASE WHEN model = 'm1' THEN pred END) AS m1,
                    max(CASE WHEN model = 'm2' THEN pred END) AS m2, max(CASE WHEN model = 'm3' THEN pred END) AS m3
             FROM v_pred GROUP BY sample_id"""),
    ("scan", """SELECT v.variant, g.weight,
                  1 - sum((y - ((1 - g.weight) * m1 + g.weight * vp)) * (y - ((1 - g.weight) * m1 + g.weight * vp)))
                      / (count(*) * var_pop(y)) AS r2,
                  sqrt(sum((y - ((1 - g.weight) * m1 + g.weight * vp)) * (y - ((1 - g.weight) * m1 + g.weight * vp)))
                       / count(*)) AS rmse
                FROM (SELECT sample_id, y, m1, 'm2' AS variant, m2 AS vp FROM w
                      UNION ALL SELECT sample_id, y, m1, 'm3' AS variant, m3 AS vp FROM w) v
                CROSS JOIN (SELECT CAST(i AS DOUBLE) / 20 AS weight FROM range(0, 21) t(i)) g
                GROUP BY v.variant, g.weight"""),
]


def blend_scan_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = fx.predictions(spark, sf_dir)
    wide = p.groupBy("sample_id", "y").pivot("model", MODELS).agg(F.first("pred"))
    return bl.blend_scan(wide, "y", "m1", VARIANTS, SCAN_WEIGHTS)


@query("blend_scan", with_views("SELECT variant, weight, round(r2, 6) AS r2, round(rmse, 6) AS rmse FROM scan",
                                "v_pred", extra=SCAN_SQL))
def blend_scan_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = blend_scan_table(spark, sf_dir)
    return s.select("variant", "weight", r6(F.col("r2")).alias("r2"), r6(F.col("rmse")).alias("rmse"))


DRP_SCAN_SQL = [
    ("truth", "SELECT sample_id, ta AS y_ta, ec AS y_ec, drp AS y_drp FROM v_sample"),
    ("w2", """SELECT t.*, max(CASE WHEN run = 'm1' THEN ta END) AS p_ta, max(CASE WHEN run = 'm1' THEN ec END) AS p_ec,
                    max(CASE WHEN run = 'm1' THEN drp END) AS m1, max(CASE WHEN run = 'm2' THEN drp END) AS m2,
                    max(CASE WHEN run = 'm3' THEN drp END) AS m3
             FROM truth t JOIN v_sub s ON t.sample_id = s.sample_id GROUP BY ALL"""),
    ("other", """SELECT 1 - sum((y_ta - p_ta) * (y_ta - p_ta)) / (count(*) * var_pop(y_ta)) AS ta_r2,
                        1 - sum((y_ec - p_ec) * (y_ec - p_ec)) / (count(*) * var_pop(y_ec)) AS ec_r2 FROM w2"""),
    ("scan", """SELECT v.variant, g.weight,
                  1 - sum((y_drp - ((1 - g.weight) * m1 + g.weight * vp)) * (y_drp - ((1 - g.weight) * m1 + g.weight * vp)))
                      / (count(*) * var_pop(y_drp)) AS r2
                FROM (SELECT y_drp, m1, 'm2' AS variant, m2 AS vp FROM w2
                      UNION ALL SELECT y_drp, m1, 'm3' AS variant, m3 AS vp FROM w2) v
                CROSS JOIN (SELECT CAST(i AS DOUBLE) / 20 AS weight FROM range(0, 21) t(i)) g
                GROUP BY v.variant, g.weight"""),
]


@query("blend_scan_macro", with_views("""
SELECT variant, weight, round(r2, 6) AS drp_r2, round((ta_r2 + ec_r2 + r2) / 3, 6) AS avg_spatial FROM scan, other""",
                                      "v_sample", "v_sub", extra=DRP_SCAN_SQL))
def blend_scan_macro_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18 as the reference uses it: the third target's blend is scanned, the other two targets' scores are fixed."""
    truth = fx.samples(spark, sf_dir).select("sample_id", *[F.col(t).alias(f"y_{t}") for t in ("ta", "ec", "drp")])
    runs = fx.submissions(spark, sf_dir)
    wide = truth.join(runs.groupBy("sample_id").pivot("run", MODELS).agg(F.first("drp")), "sample_id")
    base = truth.join(runs.where(F.col("run") == "m1").select("sample_id", "ta", "ec"), "sample_id")
    scores = [me.regression_metrics(f"y_{t}", t)[1].alias(f"{t}_r2") for t in ("ta", "ec")]
    out = bl.macro_scan(bl.blend_scan(wide, "y_drp", "m1", VARIANTS, SCAN_WEIGHTS), base.agg(*scores))
    return out.select("variant", "weight", r6(F.col("r2")).alias("drp_r2"), r6(F.col("avg_spatial")).alias("avg_spatial"))


SCAN_FEATURES = 39  # Fixed value: features of the scanned blend.


def _estimated_sql() -> str:
    terms = ("((c.avg_spatial - a.avg_spatial) / 0.018) ** 2 + ((c.feature_count - a.feature_count) / 10.0) ** 2"
             + "".join(f" + ((c.r2_{t} - a.r2_{t}) / {s}) ** 2" for t, s in me.TARGET_SCALE.items()))
    weight = f"(1.0 / (sqrt({terms}) + 1e-6) * CASE WHEN a.public_score >= 0.34 THEN 1.15 ELSE 1.0 END)"
    same = ("abs(c.avg_spatial - a.avg_spatial) < 1e-4 AND c.feature_count = a.feature_count"
            + "".join(f" AND abs(c.r2_{t} - a.r2_{t}) <= 1e-4" for t in TARGETS))
    return with_views("""
SELECT variant, weight, round(r2_drp, 6) AS drp_r2, round(avg_spatial, 6) AS avg_spatial, round(estimate, 6) AS estimate,
       CAST(row_number() OVER (ORDER BY round(avg_spatial, 9) DESC, round(r2_drp, 9) DESC, round(estimate, 9) DESC, variant, weight)
            AS INTEGER) AS place
FROM est""", "v_sample", "v_sub", extra=PROFILES_SQL + DRP_SCAN_SQL + [
        ("cand", f"""SELECT variant, weight, r2 AS r2_drp, ta_r2 AS r2_ta, ec_r2 AS r2_ec, (ta_r2 + ec_r2 + r2) / 3 AS avg_spatial,
                     {SCAN_FEATURES} AS feature_count FROM scan, other"""),
        ("est", f"""SELECT c.variant, c.weight, c.r2_drp, c.avg_spatial, coalesce(
                      min_by(a.public_score, a.run) FILTER (WHERE {same}),
                      least(greatest(sum({weight} * a.public_score) / sum({weight})
                        - greatest(c.feature_count - max(a.feature_count), 0) * 0.0015
                        + CASE WHEN c.r2_drp >= 0.17 THEN 0.006 ELSE 0.0 END + CASE WHEN c.r2_ec >= 0.32 THEN 0.006 ELSE 0.0 END
                        + CASE WHEN c.r2_ta >= 0.40 THEN 0.004 ELSE 0.0 END + CASE WHEN c.r2_drp < 0.10 THEN -0.010 ELSE 0.0 END,
                        0.0), 1.0)) AS estimate
                    FROM cand c CROSS JOIN prof a GROUP BY ALL"""
         .replace("GROUP BY ALL", "GROUP BY c.variant, c.weight, c.r2_drp, c.r2_ec, c.r2_ta, c.avg_spatial, c.feature_count"))])


@query("blend_scan_estimate", _estimated_sql())
def blend_scan_estimate_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M18 with the estimate of the public score and the order by all three figures; anchors are the runs' profiles."""
    truth = fx.samples(spark, sf_dir).select("sample_id", *[F.col(t).alias(f"y_{t}") for t in TARGETS])
    runs = fx.submissions(spark, sf_dir)
    wide = truth.join(runs.groupBy("sample_id").pivot("run", MODELS).agg(F.first("drp")), "sample_id")
    base = truth.join(runs.where(F.col("run") == "m1").select("sample_id", "ta", "ec"), "sample_id")
    others = base.agg(*[me.regression_metrics(f"y_{t}", t)[1].alias(f"r2_{t}") for t in ("ta", "ec")])
    out = bl.estimated_scan(bl.blend_scan(wide, "y_drp", "m1", VARIANTS, SCAN_WEIGHTS), others,
                            run_profiles(spark, sf_dir), SCAN_FEATURES)
    return out.select("variant", "weight", r6(F.col("r2_drp")).alias("drp_r2"), r6(F.col("avg_spatial")).alias("avg_spatial"),
                      r6(F.col("estimate")).alias("estimate"), "place")


@query("best_per_group", with_views("""
SELECT variant, weight, round(r2, 6) AS r2 FROM (
  SELECT *, row_number() OVER (PARTITION BY variant ORDER BY r2 DESC, weight) AS rn FROM scan) x WHERE rn = 1""",
                                    "v_pred", extra=SCAN_SQL))
def best_per_group_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = so.best_per_group(blend_scan_table(spark, sf_dir), "variant", [F.col("r2").desc(), F.col("weight")])
    return b.select("variant", "weight", r6(F.col("r2")).alias("r2"))


@query("scan_rank", with_views("""
SELECT variant, weight, round(r2, 6) AS r2, round(rmse, 6) AS rmse FROM scan
ORDER BY r2 DESC, variant, weight LIMIT 10""", "v_pred", extra=SCAN_SQL))
def scan_rank_q(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = so.scan_rank(blend_scan_table(spark, sf_dir), [F.col("r2").desc(), F.col("variant"), F.col("weight")], 10)
    return top.select("variant", "weight", r6(F.col("r2")).alias("r2"), r6(F.col("rmse")).alias("rmse"))
