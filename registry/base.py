"""Registration helper and the SQL form of the derived views."""

from __future__ import annotations

import importlib

ALL: dict = {}
SQL: dict[str, str] = {}

FAMILIES = ("catalog", "pixels", "detectors", "fusing", "pairs", "measure", "extras", "composed", "ingest")

# SQL twins of siltmark.sources.driver_tables
VIEWS = {
    "det": """
SELECT CAST(n_nationkey AS BIGINT) AS event_id,
       TIMESTAMP '2024-01-15 00:00:00' + n_nationkey * INTERVAL 6 HOUR AS origin,
       CAST(55 + (n_nationkey * 7) % 10 AS DOUBLE) AS lat,
       CAST(-150 + (n_nationkey * 11) % 10 AS DOUBLE) AS lon, CAST(3 AS DOUBLE) AS radius_km
FROM nation""",
    "scenes": """
SELECT event_id AS scene_id, ts AS acq,
       CASE event_type WHEN 'view' THEN 'Sentinel-2' WHEN 'click' THEN 'Landsat'
            WHEN 'purchase' THEN 'Sentinel-1' WHEN 'signup' THEN 'NISAR' ELSE 'PlanetScope' END AS source,
       CASE WHEN event_id % 17 <> 0 THEN CAST((event_id * 37) % 101 AS DOUBLE) END AS cloud_pct,
       user_id % 6 AS relative_orbit,
       CASE WHEN user_id % 2 = 0 THEN 'ascending' ELSE 'descending' END AS orbit_state,
       CASE WHEN event_id % 5 = 0 THEN 'EW' ELSE 'IW' END AS mode,
       -150.25::DOUBLE + (user_id % 20) / 2.0::DOUBLE - (0.5::DOUBLE + (event_id % 4) / 4.0::DOUBLE) AS w,
       54.75::DOUBLE + ((event_id * 13) % 20) / 2.0::DOUBLE - (0.5::DOUBLE + (event_id % 4) / 4.0::DOUBLE) AS s,
       -150.25::DOUBLE + (user_id % 20) / 2.0::DOUBLE + (0.5::DOUBLE + (event_id % 4) / 4.0::DOUBLE) AS e,
       54.75::DOUBLE + ((event_id * 13) % 20) / 2.0::DOUBLE + (0.5::DOUBLE + (event_id % 4) / 4.0::DOUBLE) AS n
FROM events""",
    "obs": """
SELECT l_orderkey // 4096 AS event_id, l_linenumber AS scene,
       CAST(l_orderkey % 32 AS INTEGER) AS "row", CAST(l_partkey % 32 AS INTEGER) AS col,
       max(CAST(floor(l_extendedprice) AS BIGINT) % 3000) AS red,
       max(CAST(floor(l_extendedprice) AS BIGINT) % 7000) AS nir,
       max(CAST(floor(l_quantity) AS BIGINT) * 60) AS green,
       max((l_suppkey * 20) % 3000) AS blue,
       max((CAST(floor(l_quantity) AS BIGINT) * 41) % 3000) AS swir1,
       CAST(max(l_suppkey % 12) AS INTEGER) AS scl,
       CASE WHEN l_linenumber <= 3 THEN 'pre' ELSE 'post' END AS side
FROM lineitem GROUP BY ALL""",
    "grids": """
SELECT DISTINCT l_orderkey // 4096 AS event_id, 32 AS n_rows, 32 AS n_cols FROM lineitem""",
    "dense": """
SELECT event_id, CAST(r AS INTEGER) AS "row", CAST(c AS INTEGER) AS col
FROM grids, range(32) a(r), range(32) b(c)""",
    "dem": """
SELECT DISTINCT event_id, "row", col,
       CAST(100 + 20 * "row" + (col * col) % 50 + event_id % 7 AS DOUBLE) AS h FROM obs""",
    "strips": """
SELECT o_orderkey AS feature_id,
       TIMESTAMP '2023-12-20 00:00:00'
         + (date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) % 60 + 60) % 60 * INTERVAL 1 DAY
         + ((o_orderkey * 37) % 86400) * INTERVAL 1 SECOND AS acq,
       ['WV01','WV02','WV03','GE01','SKY'][o_custkey % 5 + 1] AS sensor,
       CAST((o_orderkey * 7) % 50 AS DOUBLE) AS ona, CAST((o_orderkey * 3) % 60 AS DOUBLE) AS sun_el,
       CAST((o_orderkey * 11) % 360 AS DOUBLE) AS sun_az, CAST((o_orderkey * 13) % 36 AS DOUBLE) / 100 AS cloud,
       CASE o_orderkey % 3 WHEN 0 THEN 'LV3D' WHEN 1 THEN 'LV2A' END AS processing_level,
       CASE WHEN o_orderkey % 29 = 0 THEN 'VIVID_BASIC' WHEN o_orderkey % 31 = 0 THEN 'RDOG_BASE'
            ELSE 'DAILY_TAKE' END AS product_name,
       CASE WHEN o_orderkey % 23 = 0 THEN 'Radar' ELSE 'Optical' END AS sensor_type,
       o_orderkey % 19 = 0 AS third_party,
       -150.25::DOUBLE + (o_custkey % 20) / 2.0::DOUBLE - (0.25::DOUBLE + (o_orderkey % 4) / 8.0::DOUBLE) AS w,
       54.75::DOUBLE + ((o_orderkey * 13) % 20) / 2.0::DOUBLE - (0.25::DOUBLE + (o_orderkey % 4) / 8.0::DOUBLE) AS s,
       -150.25::DOUBLE + (o_custkey % 20) / 2.0::DOUBLE + (0.25::DOUBLE + (o_orderkey % 4) / 8.0::DOUBLE) AS e,
       54.75::DOUBLE + ((o_orderkey * 13) % 20) / 2.0::DOUBLE + (0.25::DOUBLE + (o_orderkey % 4) / 8.0::DOUBLE) AS n
FROM orders""",
    "outlines": """
SELECT p_brand AS slide, ['total','best','low','high'][p_partkey % 4 + 1] AS role,
       p_partkey AS polygon_id, p_size * p_retailprice AS area_m2 FROM part""",
    "ledger": """
SELECT o_orderkey AS order_id, CASE o_orderstatus WHEN 'F' THEN 'pre' WHEN 'O' THEN 'post' END AS side,
       o_custkey % 25 AS event_id, scene_ids, o_orderkey % 7 <> 0 AS has_box,
       -150.0::DOUBLE + (o_custkey % 100) / 10.0::DOUBLE - 0.5 AS w, 55.0::DOUBLE + (o_orderkey % 100) / 10.0::DOUBLE - 0.25 AS s,
       -150.0::DOUBLE + (o_custkey % 100) / 10.0::DOUBLE + 0.5 AS e, 55.0::DOUBLE + (o_orderkey % 100) / 10.0::DOUBLE + 0.25 AS n,
       CASE WHEN o_orderkey % 14 <> 0 THEN 55.0::DOUBLE + (o_orderkey % 100) / 10.0::DOUBLE END AS centre_lat,
       CASE WHEN o_orderkey % 14 <> 0 THEN -150.0::DOUBLE + (o_custkey % 100) / 10.0::DOUBLE END AS centre_lon,
       CAST(5 + o_orderkey % 20 AS DOUBLE) AS radius_km,
       CASE o_orderkey % 3 WHEN 0 THEN 'analytic_udm2' WHEN 1 THEN 'visual' END AS bundle,
       o_orderdate AS created
FROM orders JOIN (SELECT l_orderkey AS o_orderkey,
                         list_sort(list(DISTINCT CAST(l_partkey % 40 AS VARCHAR))) AS scene_ids
                  FROM lineitem GROUP BY 1) USING (o_orderkey)""",
    "peaks": """
SELECT 'Peak ' || (s_suppkey % 50) AS name, -150.0::DOUBLE + ((s_suppkey * 7) % 40) * 0.002::DOUBLE AS lon,
       60.0::DOUBLE + ((s_suppkey * 3) % 30) * 0.002::DOUBLE AS lat, 1 AS priority, s_suppkey AS seq FROM supplier
UNION ALL
SELECT 'Peak ' || (c_custkey % 50), -150.0::DOUBLE + ((c_custkey * 7) % 40) * 0.002::DOUBLE,
       60.0::DOUBLE + ((c_custkey * 3) % 30) * 0.002::DOUBLE, 2, c_custkey FROM customer""",
}
# one layer per scene (l), per scene after the event (p) and per pair of scenes (g): event_id * 8 + its number
VIEWS["obs_l"] = "SELECT * REPLACE (event_id * 8 + scene AS event_id) FROM obs"
for _k, _lo, _hi in (("l", 1, 8), ("p", 4, 8), ("g", 0, 4)):
    VIEWS[f"grids_{_k}"] = f"SELECT event_id * 8 + c AS event_id, n_rows, n_cols FROM grids, range({_lo}, {_hi}) t(c)"
    VIEWS[f"dense_{_k}"] = VIEWS["dense"].replace("grids", f"grids_{_k}")
NEEDS = {"dense": ("grids",), "dem": ("obs",), "obs_l": ("obs",)}
NEEDS |= {f"grids_{k}": ("grids",) for k in "lpg"} | {f"dense_{k}": (f"grids_{k}",) for k in "lpg"}


def with_views(names, body: str, extra: str = "") -> str:
    """Prefix ``body`` with the named views, their own needs first."""
    order: list[str] = []

    def add(name: str) -> None:
        for n in NEEDS.get(name, ()):
            add(n)
        if name not in order:
            order.append(name)

    for n in names:
        add(n)
    ctes = [f"{n} AS ({VIEWS[n]})" for n in order]
    recursive = extra.startswith("RECURSIVE ")
    extra = extra.removeprefix("RECURSIVE ").strip().rstrip(",")
    if extra:
        ctes.append(extra)
    return "WITH " + ("RECURSIVE " if recursive else "") + ",\n".join(ctes) + "\n" + body if ctes else body


def register(name: str, sql: str | None = None, views=(), extra: str = ""):
    """Decorator: register ``fn(spark, sf_dir)`` and its SQL twin."""
    def wrap(fn):
        ALL[name] = fn
        if sql is not None:
            SQL[name] = with_views(views, sql, extra)
        return fn
    return wrap


def load_all() -> None:
    for family in FAMILIES:
        importlib.import_module(f"registry.{family}")
