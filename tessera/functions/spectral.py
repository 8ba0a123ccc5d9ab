"""Spectral indices and pixel-quality expressions.

All are Column -> Column and stay inside whole-stage codegen. Under ANSI
mode a division by zero raises, so every ratio either carries the epsilon
used by the reference or goes through `try_divide`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference's for identical results.
EPS = 1e-8            # divisor epsilon of the engineered indices
LEGACY_EPS = 1e-10    # epsilon of the older NDMI definition
QA_BAD_BITS = 2 | 8 | 16   # dilated cloud, cloud, cloud shadow (bits 1, 3, 4)
DN_SCALE, DN_OFFSET = 0.0000275, -0.2   # surface-reflectance scale/offset
DN_MISSING_HIGH = 65535                 # saturated / fill value
# Named QA flags of the 16-bit pixel-quality band (bit -> name), natural order.
QA_FLAGS = {
    "fill": 0, "dilated_cloud": 1, "cirrus": 2, "cloud": 3, "shadow": 4,
    "snow": 5, "clear": 6, "water": 7,
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def norm_diff(a, b, eps: float = EPS) -> Column:
    """(a - b) / (a + b + eps): NDVI, NDWI, MNDWI, NDTI."""
    a, b = _c(a), _c(b)
    return (a - b) / (a + b + F.lit(eps))


def ratio(a, b, eps: float = EPS) -> Column:
    """a / (b + eps); eps=None divides with NULL on zero instead of raising."""
    a, b = _c(a), _c(b)
    if eps is None:
        return F.try_divide(a, b)
    return a / (b + F.lit(eps))


def norm_diff_indices(nir08="nir08", red="red", green="green", swir16="swir16") -> dict[str, Column]:
    """the four normalised differences of the engineered feature set."""
    return {
        "NDVI": norm_diff(nir08, red),
        "NDWI": norm_diff(green, nir08),
        "MNDWI": norm_diff(green, swir16),
        "NDTI": norm_diff(red, green),
    }


def water_indices(nir08="nir08", red="red", green="green", blue="blue", swir16="swir16") -> dict[str, Column]:
    """SABI and WRI."""
    return {
        "SABI": (_c(nir08) - _c(red)) / (_c(blue) + _c(green) + F.lit(EPS)),
        "WRI": (_c(green) + _c(red)) / (_c(nir08) + _c(swir16) + F.lit(EPS)),
    }


def band_ratios(blue="blue", green="green", red="red", nir08="nir08",
                swir16="swir16", swir22="swir22") -> dict[str, Column]:
    """four band ratios with epsilon in the divisor."""
    return {
        "turbidity_ratio": ratio(red, blue),
        "green_red_ratio": ratio(green, red),
        "nir_swir_ratio": ratio(nir08, swir16),
        "swir_ratio": ratio(swir16, swir22),
    }


def legacy_indices(nir="nir", green="green", swir16="swir16", with_eps: bool = True) -> dict[str, Column]:
    """older NDMI/MNDWI. One reference copy has no epsilon: that form
    divides with `try_divide` so a zero denominator is NULL, not an error."""
    n, g, s = _c(nir), _c(green), _c(swir16)
    if with_eps:
        return {"NDMI": (n - s) / (n + s + F.lit(LEGACY_EPS)),
                "MNDWI": (g - s) / (g + s + F.lit(LEGACY_EPS))}
    return {"NDMI": F.try_divide(n - s, n + s), "MNDWI": F.try_divide(g - s, g + s)}


def with_legacy_indices(df, nir="nir", green="green", swir16="swir16", with_eps: bool = True):
    """add NDMI / MNDWI only where the frame does not already carry them
    (a source that ships its own indices keeps them)."""
    cols = {k: v for k, v in legacy_indices(nir, green, swir16, with_eps).items() if k not in df.columns}
    return df.withColumns(cols) if cols else df


def qa_clear(qa="qa", bad_bits: int = QA_BAD_BITS) -> Column:
    """pixel is clear when none of the bad QA bits is set."""
    return _c(qa).bitwiseAND(F.lit(bad_bits)) == 0


def qa_flag_mask(flags, qa="qa") -> Column:
    """F13 (named form): True where any of the named flags is set."""
    bits = reduce(lambda acc, f: acc | (1 << QA_FLAGS[f]), flags, 0)
    return _c(qa).bitwiseAND(F.lit(bits)) != 0


def mask_pixels(bands, clear: Column) -> dict[str, Column]:
    """masked pixels become NULL in every band."""
    return {b: F.when(clear, _c(b)) for b in bands}


def valid_dn(x) -> Column:
    """a digital number is valid iff 0 < DN < 65535; otherwise NULL."""
    x = _c(x)
    return F.when((x > 0) & (x < DN_MISSING_HIGH), x)


def zero_as_missing(x) -> Column:
    """a reduced value of exactly 0 means 'no data'."""
    return F.nullif(_c(x), F.lit(0.0))


def dn_to_reflectance(x) -> Column:
    """F16: surface reflectance from a digital number (bands only, not QA)."""
    return _c(x) * F.lit(DN_SCALE) + F.lit(DN_OFFSET)
