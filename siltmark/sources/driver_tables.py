"""The engine's input shapes derived from the benchmark parquet tables.

Every view scans a whole table; the number of events of the pixel views grows with
the data (one 32 x 32 grid per 4,096 order keys).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.session import prepare

GRID = 32
ORDERS_PER_EVENT = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    origin = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(hours=k * 6)
    return n.select(
        k.cast("bigint").alias("event_id"), origin.alias("origin"),
        (55 + (k * 7) % 10).cast("double").alias("lat"),
        (-150 + (k * 11) % 10).cast("double").alias("lon"),
        F.lit(3.0).alias("radius_km"),
    )


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i, u = F.col("event_id"), F.col("user_id")
    source = (F.when(F.col("event_type") == "view", "Sentinel-2")
              .when(F.col("event_type") == "click", "Landsat")
              .when(F.col("event_type") == "purchase", "Sentinel-1")
              .when(F.col("event_type") == "signup", "NISAR")
              .otherwise("PlanetScope"))
    lon = F.lit(-150.25) + (u % 20) / 2
    lat = F.lit(54.75) + ((i * 13) % 20) / 2
    half = F.lit(0.5) + (i % 4) / 4
    return e.select(
        i.alias("scene_id"), F.col("ts").cast("timestamp_ntz").alias("acq"), source.alias("source"),
        F.when(i % 17 != 0, ((i * 37) % 101).cast("double")).alias("cloud_pct"),
        (u % 6).alias("relative_orbit"),
        F.when(u % 2 == 0, "ascending").otherwise("descending").alias("orbit_state"),
        F.when(i % 5 == 0, "EW").otherwise("IW").alias("mode"),
        F.struct((lon - half).alias("w"), (lat - half).alias("s"),
                 (lon + half).alias("e"), (lat + half).alias("n")).alias("bbox"),
    )


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One measured cell of one scene: bands as raw counts plus a class code."""
    li = table(spark, sf_dir, "lineitem")
    price = F.floor("l_extendedprice")
    qty = F.floor("l_quantity")
    return li.groupBy(
        F.expr(f"l_orderkey div {ORDERS_PER_EVENT}").alias("event_id"),
        F.col("l_linenumber").alias("scene"),
        (F.col("l_orderkey") % GRID).cast("int").alias("row"),
        (F.col("l_partkey") % GRID).cast("int").alias("col"),
    ).agg(
        F.max(price % 3000).alias("red"), F.max(price % 7000).alias("nir"),
        F.max(qty * 60).alias("green"), F.max((F.col("l_suppkey") * 20) % 3000).alias("blue"),
        F.max((qty * 41) % 3000).alias("swir1"), F.max(F.col("l_suppkey") % 12).cast("int").alias("scl"),
    ).withColumn("side", F.when(F.col("scene") <= 3, "pre").otherwise("post"))


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return (li.select(F.expr(f"l_orderkey div {ORDERS_PER_EVENT}").alias("event_id")).distinct()
            .select("event_id", F.lit(GRID).alias("n_rows"), F.lit(GRID).alias("n_cols"),
                    F.lit(-150.0).alias("x0"), F.lit(1 / 2048).alias("dx"),
                    F.lit(60.0).alias("y0"), F.lit(-1 / 4096).alias("dy")))


def layer_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells with every scene as a layer of its own: ``event_id`` is event * 8 + scene."""
    return observations(spark, sf_dir).withColumn("event_id", F.col("event_id") * 8 + F.col("scene"))


def layer_grids(spark: SparkSession, sf_dir: str, numbers) -> DataFrame:
    """Grids of the layers event * 8 + number."""
    return grids(spark, sf_dir).withColumn("event_id", F.explode(F.array(*[F.col("event_id") * 8 + n for n in numbers])))


def elevation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Height of every cell some scene measured; other cells are voids."""
    h = 100 + 20 * F.col("row") + (F.col("col") * F.col("col")) % 50 + F.col("event_id") % 7
    return (observations(spark, sf_dir).select("event_id", "row", "col").distinct()
            .withColumn("h", h.cast("double")))


def truth_expr(row="row", col="col"):
    r, c = F.col(row), F.col(col)
    return (r - 16) * (r - 16) + (c - 16) * (c - 16) <= 36


def strips(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    lon = F.lit(-150.25) + (F.col("o_custkey") % 20) / 2
    lat = F.lit(54.75) + ((k * 13) % 20) / 2
    hw = F.lit(0.25) + (k % 4) / 8
    days = F.pmod(F.datediff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date")), F.lit(60))
    acq = (F.lit("2023-12-20 00:00:00").cast("timestamp_ntz")
           + F.make_dt_interval(days=days, secs=((k * 37) % 86400).cast("decimal(18,6)")))
    return o.select(
        k.alias("feature_id"), acq.alias("acq"),
        F.element_at(F.array(*[F.lit(s) for s in ("WV01", "WV02", "WV03", "GE01", "SKY")]),
                     (F.col("o_custkey") % 5 + 1).cast("int")).alias("sensor"),
        ((k * 7) % 50).cast("double").alias("ona"), ((k * 3) % 60).cast("double").alias("sun_el"),
        ((k * 11) % 360).cast("double").alias("sun_az"), (((k * 13) % 36) / 100).alias("cloud"),
        F.when(k % 3 == 0, "LV3D").when(k % 3 == 1, "LV2A").alias("processing_level"),
        F.when(k % 29 == 0, "VIVID_BASIC").when(k % 31 == 0, "RDOG_BASE")
        .otherwise("DAILY_TAKE").alias("product_name"),
        F.when(k % 23 == 0, "Radar").otherwise("Optical").alias("sensor_type"),
        (k % 19 == 0).alias("third_party"),
        F.struct((lon - hw).alias("w"), (lat - hw).alias("s"),
                 (lon + hw).alias("e"), (lat + hw).alias("n")).alias("bbox"),
    )


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        F.col("p_brand").alias("slide"),
        F.element_at(F.array(*[F.lit(r) for r in ("total", "best", "low", "high")]),
                     (k % 4 + 1).cast("int")).alias("role"),
        k.alias("polygon_id"), (F.col("p_size") * F.col("p_retailprice")).alias("area_m2"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered orders.  An order holds at most the line items of one order key."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    ids = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.array_sort(F.collect_set((F.col("l_partkey") % 40).cast("string"))).alias("scene_ids"))
    k = F.col("o_orderkey")
    lon = F.lit(-150.0) + (F.col("o_custkey") % 100) / 10
    lat = F.lit(55.0) + (k % 100) / 10
    return o.join(ids, "o_orderkey").select(
        k.alias("order_id"),
        F.when(F.col("o_orderstatus") == "F", "pre").when(F.col("o_orderstatus") == "O", "post").alias("side"),
        (F.col("o_custkey") % 25).alias("event_id"), "scene_ids",
        F.when(k % 7 != 0, F.struct((lon - 0.5).alias("w"), (lat - 0.25).alias("s"),
                                    (lon + 0.5).alias("e"), (lat + 0.25).alias("n"))).alias("bbox"),
        F.when(k % 14 != 0, lat).alias("centre_lat"), F.when(k % 14 != 0, lon).alias("centre_lon"),
        (5 + k % 20).cast("double").alias("radius_km"),
        F.when(k % 3 == 0, "analytic_udm2").when(k % 3 == 1, "visual").alias("bundle"),
        F.col("o_orderdate").cast("timestamp_ntz").alias("created"),
    )


def peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shape(df, key, priority):
        k = F.col(key)
        return df.select(
            F.concat(F.lit("Peak "), (k % 50).cast("string")).alias("name"),
            (F.lit(-150.0) + ((k * 7) % 40) * 0.002).alias("lon"),
            (F.lit(60.0) + ((k * 3) % 30) * 0.002).alias("lat"),
            F.lit(priority).alias("priority"), k.alias("seq"))
    return shape(table(spark, sf_dir, "supplier"), "s_suppkey", 1).unionByName(
        shape(table(spark, sf_dir, "customer"), "c_custkey", 2))
