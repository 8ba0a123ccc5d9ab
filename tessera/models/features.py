"""The wide training table: samples + merged optics + climate + engineered
features (lifecycle B, then F1-F12), and its MLlib-ready form.

One plan: both optical sources left-joined onto the samples by
`sample_id` (the joins share one hash partitioning of the id, so each
input is shuffled once), one equi-join on the grid cell + month, then
projections. MLlib trees reject NULL/NaN, so missing
values get a sentinel plus the existing missing flags (there is no native
missing-value routing in MLlib).
"""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import calendar as cal
from ..functions import quality as qf
from ..functions import spectral as sp
from ..operators import joins as jn
from ..sources import fixtures as fx

TARGETS = ("ta", "ec", "drp")
SENTINEL = -9999.0

BAND_FEATURES = ["blue", "green", "red", "nir08", "swir16", "swir22", "NDMI", "MNDWI"]
INDEX_FEATURES = ["NDVI", "NDWI", "NDTI", "SABI", "WRI", "turbidity_ratio", "green_red_ratio",
                  "nir_swir_ratio", "swir_ratio"]
CLIMATE_FEATURES = ["ppt", "pet", "tmax", "tmin", "q", "ppt_pet_ratio", "temp_range", "runoff_ratio",
                    "hydro_stress", "thermal_runoff"]
CALENDAR_FEATURES = ["month_sin", "month_cos", "quarter"]
QUALITY_FEATURES = ["days_offset_filled", "days_offset_missing", "api_optical_complete",
                    "old_optical_available", "api_preferred"]
FEATURES = BAND_FEATURES + INDEX_FEATURES + CLIMATE_FEATURES + CALENDAR_FEATURES + QUALITY_FEATURES + ["lat", "lon"]

# Feature sets for ablations (P7): the full set and two reductions.
FEATURE_SETS = {
    "all": FEATURES,
    "no_old_optics": [f for f in FEATURES if f not in ("NDMI", "MNDWI", "old_optical_available")],
    "no_quality_flags": [f for f in FEATURES if f not in QUALITY_FEATURES],
    "spectral_only": BAND_FEATURES + INDEX_FEATURES,
}


def merged_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lifecycle B: samples ⋈ coalesced optics (by id) ⋈ climate (by cell+month).

    The grid cell and month are computed on the sample rows themselves, so
    the climate join is one equi-join on (cell, month) — no second pass over
    the samples and no join back by id.
    """
    s = fx.samples(spark, sf_dir).withColumns({
        "cell_i": F.floor((F.col("lat") + 35.0) / 0.5).cast("int"),
        "cell_j": F.floor((F.col("lon") - 15.0) / 0.5).cast("int"),
        "month": F.trunc("sample_ts", "month")})
    m = jn.coalesce_sources(fx.api_optics(spark, sf_dir), fx.official_optics(spark, sf_dir), spine=s,
                            api_keep=("days_offset",),
                            official_keep={"nir": "nir", "green": "green_old", "swir16": "swir16_old",
                                           "swir22": "swir22_old"})
    grid = fx.climate(spark, sf_dir).select("cell_i", "cell_j", "month", "ppt", "pet", "tmax", "tmin", "q")
    return jn.month_bucket_join(m, grid, ["cell_i", "cell_j", "month"], suffix="").drop("cell_i", "cell_j", "month")


def add_features(df: DataFrame) -> DataFrame:
    """F1-F12 on the merged table."""
    nd = sp.norm_diff_indices()
    cols = {k: nd[k] for k in ("NDVI", "NDWI", "NDTI")}
    cols.update(sp.water_indices())
    cols.update(sp.band_ratios())
    cols.update(qf.climate_interactions())
    cyc = cal.cyclic_month("sample_ts")
    cols.update(cyc)
    out = df.withColumns(cols)
    out = out.withColumns(qf.offset_fill_clip("days_offset"))
    out = out.withColumns(qf.quality_flags())
    out = out.withColumn("climate_ok", F.col("ppt").isNotNull().cast("int"))
    out = out.withColumn("sample_weight", qf.sample_weight(climate_ok="climate_ok"))
    out = out.withColumns(qf.spatial_bin())
    return out


def training_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return add_features(merged_table(spark, sf_dir))


def assemble(df: DataFrame, features, out: str = "features") -> DataFrame:
    """Sentinel-fill missing feature values, then one vector column."""
    filled = df.withColumns({f: F.coalesce(F.col(f).cast("double"), F.lit(SENTINEL)) for f in features})
    return VectorAssembler(inputCols=list(features), outputCol=out, handleInvalid="keep").transform(filled)
