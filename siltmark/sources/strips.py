"""Strip catalogue ingest: GeoJSON features to typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltmark.functions.timing import micros, parse_time

PROPS = ("featureId string, legacyIdentifier string, acquisitionDate string, createdDate string, source string, "
         "sensorCode string, sensorName string, productName string, sensorType string, isThirdParty boolean, "
         "vendorName string, sourceCompanyName string, offNadirAngle double, sunElevation double, sunAzimuth double, "
         "cloudCover double, groundSampleDistance double, bandConfiguration string, processingLevel string, "
         "demCorrection string, ce90Accuracy double, earliestAcquisitionTime string, latestAcquisitionTime string, "
         "outputMosaic boolean, copyright string, licenseType string")
# Vendors of third-party sensors and the multi-date rule.
VENDORS = {"UMBRA": "Umbra", "ICEYE": "ICEYE", "CAPELLA": "Capella Space", "SKYSAT": "Planet Labs (SkySat)", "BLACKSKY": "BlackSky"}
OWN_VENDOR, THIRD_PARTY, MOSAICS, MULTI_DATE_S = "Vantor", "THIRD_PARTY", ("RDOG_BASE",), 300.0


def _text(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def _schema() -> str:
    fields = ", ".join(f.strip().replace(" ", ": ", 1) for f in PROPS.split(","))
    return f"struct<properties: struct<{fields}>, geometry: struct<type: string, coordinates: string>>"


def parse_features(raw: DataFrame, body: str = "feature") -> DataFrame:
    """One JSON feature per row -> parsed ``properties`` and ``geometry`` columns."""
    f = F.from_json(F.col(body), _schema())
    return raw.withColumn("_f", f).select("*", F.col("_f.properties").alias("p"), F.col("_f.geometry").alias("g")).drop("_f")


def read_collection(spark, path: str) -> DataFrame:
    """Feature collections on disk, one feature per row as JSON text."""
    docs = spark.read.text(path, wholetext=True)
    feats = F.from_json("value", "struct<features: array<string>>")["features"]
    return docs.select(F.explode(feats).alias("feature"))


def require_fields(parsed: DataFrame) -> DataFrame:
    """One record without an id or a readable date makes the whole batch fail."""
    bad = (_text(F.col("p.featureId")).isNull() | parse_time(F.col("p.acquisitionDate")).isNull())
    msg = F.lit("a strip record lacks featureId or a readable acquisitionDate")
    return parsed.filter(F.when(bad, F.raise_error(msg).cast("boolean")).otherwise(F.lit(True)))


def missing_fields(parsed: DataFrame) -> DataFrame:
    """How many records lack each required field."""
    return parsed.agg(F.count_if(_text(F.col("p.featureId")).isNull()).alias("no_id"),
                      F.count_if(parse_time(F.col("p.acquisitionDate")).isNull()).alias("no_date"), F.count(F.lit(1)).alias("n"))


def exterior_rings(geometry: Column) -> Column:
    """Exterior ring of every part with at least three points."""
    poly = F.from_json(geometry["coordinates"], "array<array<array<double>>>")
    multi = F.from_json(geometry["coordinates"], "array<array<array<array<double>>>>")
    parts = F.when(geometry["type"] == "Polygon", F.array(poly)).when(geometry["type"] == "MultiPolygon", multi)
    rings = F.transform(F.filter(parts, lambda p: F.size(p) > 0), lambda p: F.transform(
        F.get(p, F.lit(0)), lambda q: F.struct(F.get(q, F.lit(0)).alias("lon"), F.get(q, F.lit(1)).alias("lat"))))
    return F.filter(rings, lambda r: F.size(r) >= 3)


def sensor_name(p: Column) -> Column:
    raw = F.upper(F.coalesce(_text(p["source"]), _text(p["sensorCode"]), _text(p["sensorName"])))
    return _text(F.regexp_replace(raw, "_(VNIR|SWIR|PAN|MS|CAVIS)$", ""))


def typed(parsed: DataFrame) -> DataFrame:
    """Typed strips: sensor, vendor, multi-date flag, and junk accuracy values nulled."""
    p = F.col("p")
    product, sensor = _text(p["productName"]), sensor_name(p)
    pu = F.upper(F.coalesce(product, F.lit("")))
    third = F.coalesce(p["isThirdParty"], F.lit(False)) | (pu == THIRD_PARTY)
    table = F.create_map(*[x for k, v in VENDORS.items() for x in (F.lit(k), F.lit(v))])
    vendor = F.coalesce(_text(p["vendorName"]), _text(p["sourceCompanyName"]),
                        F.when(third, F.coalesce(table[F.coalesce(sensor, F.lit(""))], sensor)).otherwise(OWN_VENDOR))
    level = _text(p["processingLevel"])
    junk = (F.upper(F.coalesce(level, F.lit(""))) == "LV2A") | (p["ce90Accuracy"] < 0.5)
    early, late = parse_time(p["earliestAcquisitionTime"]), parse_time(p["latestAcquisitionTime"])
    span = F.coalesce(F.abs(micros(late) - micros(early)) / 1e6, F.lit(0.0))
    multi = (span > MULTI_DATE_S) | F.coalesce(p["outputMosaic"], F.lit(False)) | pu.isin(*MOSAICS)
    rest = [c for c in parsed.columns if c not in ("p", "g", "feature")]
    return parsed.select(
        *rest, F.trim(p["featureId"]).alias("feature_id"), _text(p["legacyIdentifier"]).alias("catalog_id"),
        parse_time(p["acquisitionDate"]).cast("timestamp_ntz").alias("acq"),
        parse_time(p["createdDate"]).cast("timestamp_ntz").alias("created"), sensor.alias("sensor"),
        product.alias("product_name"), _text(p["sensorType"]).alias("sensor_type"), third.alias("third_party"),
        vendor.alias("vendor"), p["offNadirAngle"].alias("ona"), p["sunElevation"].alias("sun_el"),
        p["sunAzimuth"].alias("sun_az"), p["cloudCover"].alias("cloud"), p["groundSampleDistance"].alias("gsd_m"),
        level.alias("processing_level"), F.when(~F.coalesce(junk, F.lit(False)), p["ce90Accuracy"]).alias("ce90"),
        multi.alias("multi_date"), exterior_rings(F.col("g")).alias("rings"))
