"""Scalar functions on hand-made edge rows (FIXTURES §6)."""

import datetime as dt

from pyspark.sql import functions as F

from tessera.functions import calendar as cal
from tessera.functions import quality as qf
from tessera.functions import spectral as sp


def test_abs_day_offset_half_days(spark):
    base = dt.datetime(2014, 5, 10, 12, 0)
    rows = [(base, base - dt.timedelta(hours=12)), (base, base + dt.timedelta(hours=12)),
            (base, base + dt.timedelta(days=30)), (base, base - dt.timedelta(days=30))]
    df = spark.createDataFrame(rows, "sample_ts timestamp_ntz, scene_ts timestamp_ntz")
    got = [r[0] for r in df.select(cal.abs_day_offset("scene_ts", "sample_ts")).collect()]
    assert got == [1, 0, 30, 30]  # -0.5 d -> 1, +0.5 d -> 0 (floor, not truncation)


def test_parse_dayfirst_and_bad_text(spark):
    df = spark.createDataFrame([("02-01-2014",), ("2014-01-02",), ("31-02-2014",), ("junk",), (None,)], "s string")
    got = [r[0] for r in df.select(cal.parse_dayfirst("s")).collect()]
    assert got == [dt.date(2014, 1, 2), dt.date(2014, 1, 2), None, None, None]


def test_coerce_numeric_bad_text_is_null(spark):
    df = spark.createDataFrame([("1.5",), ("",), ("abc",), ("-2",)], "s string")
    assert [r[0] for r in df.select(qf.coerce_numeric("s")).collect()] == [1.5, None, None, -2.0]


def test_spatial_bin_half_even_and_negative_zero(spark):
    df = spark.createDataFrame([(-32.05, 0.05), (-0.04, 18.25), (-32.15, 18.35)], "lat double, lon double")
    out = df.select(*[c.alias(k) for k, c in qf.spatial_bin().items()]).collect()
    assert out[1]["lat_bin"] == 0.0 and str(out[1]["lat_bin"]) == "0.0"   # no -0.0
    assert out[1]["spatial_group"] == "0.0_18.2"                            # 18.25 -> 18.2 (half-even)
    assert out[0]["spatial_group"].startswith("-32.0")                      # numpy: -32.05 -> -32.0 on binary value


def test_offset_fill_clip_null_and_bounds(spark):
    df = spark.createDataFrame([(None,), (-3.0,), (70.0,), (12.0,)], "days_offset double")
    out = df.select(*[c.alias(k) for k, c in qf.offset_fill_clip().items()]).collect()
    assert [r[0] for r in out] == [61.0, 0.0, 61.0, 12.0]
    assert [r[1] for r in out] == [1, 0, 0, 0]


def test_valid_dn_and_zero_median(spark):
    df = spark.createDataFrame([(0.0,), (65535.0,), (1.0,), (65534.0,)], "x double")
    assert [r[0] for r in df.select(sp.valid_dn("x")).collect()] == [None, None, 1.0, 65534.0]
    assert [r[0] for r in df.select(sp.zero_as_missing("x")).collect()][0] is None


def test_legacy_indices_without_epsilon_null_on_zero(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (3.0, 1.0, 1.0)], "nir double, green double, swir16 double")
    out = df.select(sp.legacy_indices(with_eps=False)["NDMI"]).collect()
    assert out[0][0] is None and abs(out[1][0] - 0.5) < 1e-12


def test_qa_masks(spark):
    df = spark.createDataFrame([(0,), (2,), (8,), (16,), (64,), (1 << 6 | 1 << 3,)], "qa int")
    clear = [r[0] for r in df.select(sp.qa_clear("qa")).collect()]
    assert clear == [True, False, False, False, True, False]
    named = [r[0] for r in df.select(sp.qa_flag_mask(["cloud", "shadow"])).collect()]
    assert named == [False, False, True, True, False, True]


def test_calendar_season(spark):
    df = spark.createDataFrame([(dt.date(2014, m, 1),) for m in (1, 3, 6, 9, 12)], "d date")
    got = [r[0] for r in df.select(cal.calendar_parts("d")["season"]).collect()]
    assert got == [0, 1, 2, 3, 0]


def test_sample_weight(spark):
    df = spark.createDataFrame([(1, 1, 0.0), (0, 1, 61.0), (0, 0, 30.5)],
                               "api_optical_complete int, old_optical_available int, days_offset_filled double")
    got = [round(r[0], 6) for r in df.select(qf.sample_weight()).collect()]
    assert got == [1.0, round(0.92 * 0.82, 6), round(0.85 * (1 - 0.5 * 0.18), 6)]


def test_day_offset_ignores_session_time_zone(spark):
    rows = [(dt.datetime(2014, 3, 1, 0, 0), dt.datetime(2014, 3, 31, 0, 0)),   # spans the US DST switch
            (dt.datetime(2014, 3, 9, 12, 0), dt.datetime(2014, 3, 8, 23, 59))]
    df = spark.createDataFrame(rows, "sample_ts timestamp_ntz, scene_ts timestamp_ntz")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        got = [r[0] for r in df.select(cal.abs_day_offset("scene_ts", "sample_ts")).collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert got == [30, 1]


def test_legacy_indices_only_when_absent(spark):
    df = spark.createDataFrame([(3.0, 2.0, 1.0, 0.7)], "nir double, green double, swir16 double, NDMI double")
    out = sp.with_legacy_indices(df).first()
    assert out.NDMI == 0.7 and abs(out.MNDWI - (2.0 - 1.0) / (3.0 + 1e-10)) < 1e-12


def test_metrics_after_expm1(spark):
    import math

    from tessera.operators.metrics import r2_rmse_mae

    rows = [(math.log1p(y), math.log1p(p)) for y, p in ((10.0, 12.0), (20.0, 18.0), (30.0, 33.0))]
    df = spark.createDataFrame(rows, "y double, p double")
    r = r2_rmse_mae(df, "y", "p", unlog=True).first()
    ys, ps = [10.0, 20.0, 30.0], [12.0, 18.0, 33.0]
    mean = sum(ys) / 3
    want = 1 - sum((a - b) ** 2 for a, b in zip(ys, ps)) / sum((a - mean) ** 2 for a in ys)
    assert abs(r.r2 - want) < 1e-9 and abs(r.mae - 7 / 3) < 1e-9
