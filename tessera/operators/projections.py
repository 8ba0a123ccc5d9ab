"""Projections and row filters.

All of these are narrow transformations (no shuffle) except `head_n`
(a global top-n: TakeOrderedAndProject keeps n rows per task) and the
one-row null-count / distinct-level scans that `na_indicator` and
`one_hot` need to decide their output columns.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rename_map(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Source names -> canonical names (absent sources ignored)."""
    return df.withColumnsRenamed({k: v for k, v in mapping.items() if k in df.columns})


def rename_pattern(df: DataFrame, words: tuple[str, str], canonical: str) -> DataFrame:
    """Any column whose name contains both words becomes `canonical`."""
    a, b = (w.lower() for w in words)
    hits = [c for c in df.columns if a in c.lower() and b in c.lower() and c != canonical]
    return df.withColumnsRenamed({c: canonical for c in hits[:1]}) if hits else df


def drop_duplicate_columns(df: DataFrame) -> DataFrame:
    """Keep the first column of each repeated name (after a concat)."""
    seen, keep = set(), []
    for i, name in enumerate(df.columns):
        if name not in seen:
            seen.add(name)
            keep.append(i)
    if len(keep) == len(df.columns):
        return df
    tmp = df.toDF(*[f"_c{i}" for i in range(len(df.columns))])
    return tmp.select(*[F.col(f"_c{i}").alias(df.columns[i]) for i in keep])


def feature_select(df: DataFrame, wanted, exclude=()) -> list[str]:
    """Wanted features that exist in the frame, minus an ablation list."""
    present = set(df.columns)
    return [c for c in wanted if c in present and c not in set(exclude)]


def align_columns(df: DataFrame, order, fill=0.0) -> DataFrame:
    """Training column order; absent columns become the fill constant."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(fill).cast("double").alias(c) for c in order])


def all_present(cols) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in cols])


def filter_complete(df: DataFrame, cols) -> DataFrame:
    """Keep rows where every listed column is present."""
    return df.where(all_present(cols))


def head_n(df: DataFrame, n: int, order) -> DataFrame:
    """P10: first n rows by a stable order (smoke-run switch)."""
    return df.orderBy(*order).limit(n)


def drop_empty_records(df: DataFrame, payload) -> DataFrame:
    """Keep a record when any payload value is present."""
    return df.where(F.coalesce(*[F.col(c) for c in payload]).isNotNull())


def complete_cases(df: DataFrame) -> DataFrame:
    """Drop rows with any NULL."""
    return df.na.drop(how="any")


def bbox(lat: float, lon: float, size: float) -> tuple[float, float, float, float]:
    """(min_lon, min_lat, max_lon, max_lat) around a centroid."""
    h = size / 2
    return lon - h, lat - h, lon + h, lat + h


def in_bbox(lat_col: str, lon_col: str, box, closed: bool = True) -> Column:
    """Point inside a box; closed (between) or open (strict) ends."""
    min_lon, min_lat, max_lon, max_lat = box
    la, lo = F.col(lat_col), F.col(lon_col)
    if closed:
        return la.between(min_lat, max_lat) & lo.between(min_lon, max_lon)
    return (la > min_lat) & (la < max_lat) & (lo > min_lon) & (lo < max_lon)


def null_counts(df: DataFrame, cols) -> dict[str, int]:
    """One pass over the data, one small row back: NULL count per column."""
    row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols]).first()
    return {c: int(row[c]) for c in cols}


def na_indicator(df: DataFrame, cols, keep_missing=()) -> DataFrame:
    """`<col>_na` flag only for columns that have a missing value;
    text columns fill with 'Missing'; numeric columns listed in
    `keep_missing` (bands) stay NULL, others are left as they are."""
    counts = null_counts(df, cols)
    types = dict(df.dtypes)
    flags = {f"{c}_na": F.col(c).isNull().cast("int") for c in cols if counts[c] > 0}
    fills = {c: F.coalesce(F.col(c), F.lit("Missing")) for c in cols
             if counts[c] > 0 and types[c] == "string" and c not in keep_missing}
    return df.withColumns({**fills, **flags})


def _safe(name: str) -> str:
    return re.sub(r"[^0-9A-Za-z]+", "_", name).strip("_")


MAX_LEVELS = 10_000


def one_hot(df: DataFrame, col: str, prefix: str | None = None, max_levels: int = MAX_LEVELS) -> DataFrame:
    """one 0/1 column per distinct level (sorted), no NA column; the
    source column is dropped. Levels come from one distinct aggregate; they
    are the output's columns, so more than `max_levels` are refused.

    Levels whose names become equal (`a b`, `a-b`) are told apart by a number
    (`c_a_b`, `c_a_b_2`); a name that the frame has already is refused.
    """
    found = df.select(col).where(F.col(col).isNotNull()).distinct().orderBy(col).limit(max_levels + 1).collect()
    if len(found) > max_levels:
        raise ValueError(f"{col} has more than {max_levels} levels")
    p, names = prefix or col, {}
    for v in (r[0] for r in found):
        base = f"{p}_{_safe(str(v))}"
        name, n = base, 2
        while name.lower() in names:  # column names ignore case
            name, n = f"{base}_{n}", n + 1
        names[name.lower()] = (name, v)
    clash = [name for low, (name, _) in names.items() if low in {c.lower() for c in df.columns}]
    if clash:
        raise ValueError(f"one_hot would replace the columns {clash}")
    return df.withColumns({name: (F.col(col) == F.lit(v)).cast("int") for name, v in names.values()}).drop(col)
