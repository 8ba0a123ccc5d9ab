"""DuckDB text of the derived tables, for the oracle SQL of each query.

Only the base tables are registered in the oracle, so each oracle query
carries the views it needs as a `WITH` prefix. The definitions are the
DuckDB twins of `tessera.sources.fixtures`.
"""

from __future__ import annotations

VIEWS: dict[str, str] = {
    "v_sample": """
SELECT o_orderkey AS sample_id, o_custkey AS site_id, o_orderdate + to_hours(o_orderkey*5 % 24) AS sample_ts,
       -35.18 + (o_custkey*37 % 1346)/CAST(100 AS DOUBLE) AS lat,
       14.97 + (o_custkey*101 % 1782)/CAST(100 AS DOUBLE) AS lon,
       o_totalprice/1000 AS ta,
       CAST((o_orderkey*7919 + o_custkey*31) % 5000 AS DOUBLE)/10 AS ec,
       CAST((o_orderkey*104729) % 1600 AS DOUBLE)/10 AS drp
FROM orders""",
    "v_api": """
SELECT o_orderkey AS sample_id,
       CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE CAST(7000 + o_orderkey*57 % 9000 AS DOUBLE) END AS blue,
       CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE CAST(7000 + o_orderkey*131 % 9000 AS DOUBLE) END AS green,
       CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE CAST(7000 + o_orderkey*89 % 9000 AS DOUBLE) END AS red,
       CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE CAST(7000 + o_orderkey*173 % 9000 AS DOUBLE) END AS nir08,
       CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE CAST(7000 + o_orderkey*211 % 9000 AS DOUBLE) END AS swir16,
       CASE WHEN o_orderkey % 8 = 3 OR o_orderkey % 101 = 0 THEN NULL ELSE CAST(7000 + o_orderkey*241 % 9000 AS DOUBLE) END AS swir22,
       CASE WHEN o_orderkey % 8 = 3 THEN NULL ELSE CAST(o_orderkey % 70 AS DOUBLE) END AS days_offset
FROM orders""",
    "v_official": """
SELECT o_orderkey AS sample_id,
       CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE CAST(7000 + o_orderkey*167 % 9000 AS DOUBLE) END AS nir,
       CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE CAST(7000 + o_orderkey*127 % 9000 AS DOUBLE) END AS green,
       CASE WHEN o_orderkey % 9 = 4 THEN NULL ELSE CAST(7000 + o_orderkey*199 % 9000 AS DOUBLE) END AS swir16,
       CASE WHEN o_orderkey % 9 = 4 OR o_orderkey % 103 = 0 THEN NULL ELSE CAST(7000 + o_orderkey*233 % 9000 AS DOUBLE) END AS swir22
FROM orders""",
    "v_pixel": """
SELECT o_custkey AS site_id, l_shipdate + to_hours((o_custkey*7 + day(l_shipdate)*11) % 24) AS scene_ts,
       l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(7000 + l_partkey*131 % 9000 AS DOUBLE) AS green,
       CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE CAST(7000 + (l_partkey*173 + l_linenumber*911) % 9000 AS DOUBLE) END AS nir08,
       CAST(7000 + (l_partkey*57 + l_suppkey*13) % 9000 AS DOUBLE) AS red,
       CAST(7000 + (l_partkey*101 + l_suppkey*17) % 9000 AS DOUBLE) AS blue,
       CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE CAST(7000 + (l_partkey*211 + l_linenumber*53) % 9000 AS DOUBLE) END AS swir16,
       CAST(7000 + (l_partkey*241 + l_suppkey*29) % 9000 AS DOUBLE) AS swir22,
       CAST((l_partkey*7 + l_suppkey*3) % 64 AS INT) AS qa
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
    "v_climate": """
SELECT CAST(l_suppkey % 27 AS INT) AS cell_i, CAST(l_suppkey*7 % 36 AS INT) AS cell_j,
       -35.0 + (l_suppkey % 27)*CAST(0.5 AS DOUBLE) AS lat,
       15.0 + (l_suppkey*7 % 36)*CAST(0.5 AS DOUBLE) AS lon,
       CAST(date_trunc('month', l_shipdate) AS DATE) AS month,
       round(avg(l_quantity)*3, 6) AS ppt, round(avg(l_discount)*2000, 6) AS pet,
       round(20 + avg(l_tax)*200, 6) AS tmax, round(5 + avg(l_tax)*100, 6) AS tmin,
       CAST(count(*) AS DOUBLE) AS q
FROM lineitem GROUP BY 1, 2, 3, 4, 5""",
    "v_pred": """
SELECT o_orderkey AS sample_id, m AS model, o_totalprice/1000 AS y,
       o_totalprice/1000*w + CAST(o_orderkey*k % 1000 AS DOUBLE)/10 AS pred,
       CAST(o_custkey % 5 AS INT) AS fold
FROM orders CROSS JOIN (VALUES ('m1', CAST(0.8 AS DOUBLE), 7919), ('m2', CAST(0.7 AS DOUBLE), 104729),
                               ('m3', CAST(0.9 AS DOUBLE), 1299709)) AS b(m, w, k)""",
    "v_scenecat": """
SELECT site_id, scene_ts, round(avg(CAST((qa & 8) <> 0 AS INT))*100, 6) AS cloud_cover,
       count(*) AS n_pixels,
       CASE WHEN site_id % 2 = 0 THEN 'landsat-8' ELSE 'landsat-9' END AS platform
FROM v_pixel GROUP BY site_id, scene_ts""",
}

VIEWS["v_sub"] = """
SELECT s.sample_id, b.m AS run, s.ta*b.w + CAST(s.sample_id*b.k % 1000 AS DOUBLE)/10 AS ta,
       s.ec*b.w + CAST(s.sample_id*b.k % 500 AS DOUBLE)/10 AS ec,
       s.drp*b.w + CAST(s.sample_id*b.k % 300 AS DOUBLE)/10 AS drp
FROM v_sample s
CROSS JOIN (VALUES ('m1', CAST(0.8 AS DOUBLE), 7919), ('m2', CAST(0.7 AS DOUBLE), 104729),
                   ('m3', CAST(0.9 AS DOUBLE), 1299709)) AS b(m, w, k)"""

VIEWS["v_footprint"] = """
SELECT *, lat - tall AS south, lat + tall AS north, lon - wide AS west, lon + wide AS east FROM (
  SELECT *, -35.18 + (site_id*37 % 1346)/CAST(100 AS DOUBLE) AS lat, 14.97 + (site_id*101 % 1782)/CAST(100 AS DOUBLE) AS lon,
         CASE WHEN site_id % 97 = 0 THEN CAST(3 AS DOUBLE) ELSE (1 + site_id*13 % 30)/CAST(100 AS DOUBLE) END AS tall,
         CASE WHEN site_id % 89 = 0 THEN CAST(2 AS DOUBLE) ELSE (1 + site_id*17 % 25)/CAST(100 AS DOUBLE) END AS wide
  FROM v_scenecat) x"""

DEPS = {"v_scenecat": ["v_pixel"], "v_sub": ["v_sample"], "v_footprint": ["v_scenecat"]}


def with_views(body: str, *names: str, extra: list[tuple[str, str]] | None = None) -> str:
    """Prefix `body` with the named views (dependencies first) and extra CTEs."""
    order: list[str] = []

    def add(n):
        for d in DEPS.get(n, []):
            add(d)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n].strip()})" for n in order]
    ctes += [f"{n} AS ({sql.strip()})" for n, sql in (extra or [])]
    if not ctes:
        return body.strip()
    return "WITH " + ",\n".join(ctes) + "\n" + body.strip()


# F9 in DuckDB: |floor((scene - sample) / 1 day)| on elapsed microseconds.
def day_offset_sql(scene: str, sample: str) -> str:
    return f"CAST(abs(floor(date_diff('microsecond', {sample}, {scene}) / 86400000000.0)) AS BIGINT)"


# Exact distance in time, for the order of scenes (the floored day offset is an output only).
def gap_sql(scene: str, sample: str) -> str:
    return f"abs(date_diff('microsecond', {sample}, {scene}))"
