"""Cleaning, flags, weights and keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .spectral import EPS

# Fixed values that must equal the reference's.
OFFSET_FILL = 61          # days_offset when no scene was found; also the clip ceiling
API_PREFERRED_MAX_OFFSET = 10
API_BANDS = ("blue", "green", "red", "nir08", "swir16", "swir22")
OLD_BANDS = ("nir", "green_old", "swir16_old", "swir22_old")
SOURCE_WEIGHTS = (1.0, 0.92, 0.85)           # complete API optics / official only / neither
OFFSET_PENALTY = 0.18                        # weight lost at the largest offset
CLIMATE_MISSING_WEIGHT = 0.95
VARIANT_SOURCE_WEIGHTS = (1.0, 0.9, 0.8)     # the variant weighting
VARIANT_OFFSET_PENALTY = 0.15
SPATIAL_BIN_DEGREES = 0.1


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def coerce_numeric(x) -> Column:
    """text/any -> double, unparsable -> NULL (plain cast raises under ANSI)."""
    return F.try_cast(_c(x), "double") if hasattr(F, "try_cast") else _c(x).try_cast("double")


def nan_to_null(x) -> Column:
    """Ingest rule: a NaN becomes NULL so it cannot poison avg/max."""
    x = _c(x)
    return F.when(~F.isnan(x), x)


def climate_interactions(ppt="ppt", pet="pet", tmax="tmax", tmin="tmin", q="q") -> dict[str, Column]:
    """climate ratios and ranges (epsilon-guarded ratios)."""
    rng = _c(tmax) - _c(tmin)
    return {
        "ppt_pet_ratio": _c(ppt) / (_c(pet) + F.lit(EPS)),
        "temp_range": rng,
        "runoff_ratio": _c(q) / (_c(ppt) + F.lit(EPS)),
        "hydro_stress": _c(pet) / (_c(ppt) + F.lit(EPS)),
        "thermal_runoff": rng * _c(q),
    }


def offset_fill_clip(x="days_offset", fill: int = OFFSET_FILL) -> dict[str, Column]:
    """F8: missing offset -> `fill`, then clip to [0, fill]; plus missing flag.
    The clip runs after the fill, so NULL never reaches least/greatest."""
    x = _c(x)
    filled = F.coalesce(x, F.lit(float(fill)))
    return {
        "days_offset_filled": F.least(F.greatest(filled, F.lit(0.0)), F.lit(float(fill))),
        "days_offset_missing": x.isNull().cast("int"),
    }


def _all_present(bands) -> Column:
    present = F.lit(True)
    for b in bands:
        present = present & _c(b).isNotNull()
    return present


def quality_flags(bands=API_BANDS, official=OLD_BANDS, offset="days_offset") -> dict[str, Column]:
    """completeness / availability / preference flags; the fallback
    source counts as available only with all of its bands."""
    complete = _all_present(bands)
    off = _c(offset)
    return {
        "api_optical_complete": complete.cast("int"),
        "old_optical_available": _all_present(official).cast("int"),
        "api_preferred": (complete & off.isNotNull() & (off <= API_PREFERRED_MAX_OFFSET)).cast("int"),
    }


def missing_flags(cols) -> dict[str, Column]:
    """per-variable is-missing flag."""
    return {f"{c}_is_missing": _c(c).isNull().cast("int") for c in cols}


def sample_weight(complete="api_optical_complete", official="old_optical_available",
                  offset="days_offset_filled", climate_ok=None) -> Column:
    """(1 | .92 | .85) * (1 - offset/61 * .18) * (1 | .95)."""
    full, official_only, neither = SOURCE_WEIGHTS
    src = (F.when(_c(complete) == 1, F.lit(full))
           .when(_c(official) == 1, F.lit(official_only)).otherwise(F.lit(neither)))
    w = src * (F.lit(1.0) - _c(offset) / F.lit(float(OFFSET_FILL)) * F.lit(OFFSET_PENALTY))
    if climate_ok is not None:
        w = w * F.when(_c(climate_ok) == 1, F.lit(1.0)).otherwise(F.lit(CLIMATE_MISSING_WEIGHT))
    return w


def sample_weight_variant(complete="api_optical_complete", official="old_optical_available",
                          offset="days_offset_filled") -> Column:
    """F11 (variant): (1 | .9 | .8) * (1 - offset/61 * .15)."""
    full, official_only, neither = VARIANT_SOURCE_WEIGHTS
    src = (F.when(_c(complete) == 1, F.lit(full))
           .when(_c(official) == 1, F.lit(official_only)).otherwise(F.lit(neither)))
    return src * (F.lit(1.0) - _c(offset) / F.lit(float(OFFSET_FILL)) * F.lit(VARIANT_OFFSET_PENALTY))


def round_half_even(x, digits: int = 1) -> Column:
    """numpy-style rounding. `F.round` is half-up; `bround` is half-even
    on the decimal value, which is what `np.round` gives for these inputs."""
    return F.bround(_c(x), digits)


def spatial_bin(lat="lat", lon="lon") -> dict[str, Column]:
    """0.1° bins, half-even, `-0.0` normalised, text key `lat_lon`."""
    per = round(1 / SPATIAL_BIN_DEGREES)
    la = F.rint(_c(lat) * per) / per + F.lit(0.0)
    lo = F.rint(_c(lon) * per) / per + F.lit(0.0)
    return {"lat_bin": la, "lon_bin": lo,
            "spatial_group": F.concat_ws("_", la.cast("string"), lo.cast("string"))}


def log_target(x) -> Column:
    """log1p."""
    return F.log1p(_c(x))


def unlog_target(x) -> Column:
    """expm1."""
    return F.expm1(_c(x))


def threshold_label(y, threshold: float) -> Column:
    """1 when y >= threshold."""
    return (_c(y) >= F.lit(threshold)).cast("int")
