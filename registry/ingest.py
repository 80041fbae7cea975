"""Delivered files, the score table and known keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from registry.base import register
from siltmark.functions import text as X
from siltmark.session import shared_folder
from siltmark.sources import deliveries, sinks
from siltmark.sources import driver_tables as D


def metadata_files(spark, d):
    """A metadata file per scene of every customer's order; every fifth order holds no footprint, every ninth no scene."""
    c, k = D.table(spark, d, "customer"), F.col("c_custkey")
    scene = F.explode(F.sequence(F.lit(0), F.when(k % 9 == 0, F.lit(-1)).otherwise(k % 3), F.lit(1)))
    c = c.filter(k % 9 != 0).select(k.alias("k"), "c_nationkey", scene.alias("i"))
    k, i = F.col("k"), F.col("i")
    x, y = F.lit(-150.0) + k % 100 / 10 + i / 4, F.lit(55.0) + k % 50 / 10
    ring = F.array(*[F.array(x + a, y + b) for a, b in ((0, 0), (0.5, 0), (0.5, 0.25), (0, 0))])
    body = F.when(k % 5 == 0, F.lit('{"geometry": null}')).otherwise(F.to_json(F.struct(F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"))))
    path = F.format_string("project%d/planet_cache/ev%d/%s/ord%d/%d_%d_3B_AnalyticMS_metadata.json", k % 4, F.col("c_nationkey"),
                           F.when(k % 2 == 0, "pre").otherwise("post"), k, F.lit(20240101) + k % 28, i)
    return c.select("k", path.alias("path"), body.alias("body"))


@register("ledger_ingest_in_two_passes", sql="""
WITH s AS (SELECT c_custkey AS k, c_nationkey, unnest(range(0, c_custkey % 3 + 1)) AS i FROM customer WHERE c_custkey % 9 <> 0)
SELECT 'ord' || k AS order_id, CASE WHEN k % 10 < 7 THEN 1 ELSE 2 END AS pass, 'ev' || any_value(c_nationkey) AS event_id, CASE WHEN k % 2 = 0 THEN 'pre' ELSE 'post' END AS side,
  string_agg((20240101 + k % 28) || '_' || i, ',' ORDER BY i) AS scene_ids, CASE WHEN k % 10 < 7 AND k % 7 = 0 THEN NULL ELSE 'adopted' END AS source,
  CASE WHEN k % 5 <> 0 THEN round(-150.0::DOUBLE + k % 100 / 10.0::DOUBLE, 6) END AS w, CASE WHEN k % 5 <> 0 THEN round(55.0::DOUBLE + k % 50 / 10.0::DOUBLE, 6) END AS s,
  CASE WHEN k % 5 <> 0 THEN round(-150.0::DOUBLE + k % 100 / 10.0::DOUBLE + max(i) / 4.0::DOUBLE + 0.5, 6) END AS e, CASE WHEN k % 5 <> 0 THEN round(55.0::DOUBLE + k % 50 / 10.0::DOUBLE + 0.25, 6) END AS n
FROM s GROUP BY k""")
def q_ingest(spark, d):
    """Files delivered in two lots are ingested twice; the second pass opens the new files only.

    Some orders of the first lot are in the ledger already, without a footprint, which their files fill in.
    """
    files, root, state = metadata_files(spark, d), shared_folder(spark, "deliveries"), shared_folder(spark, "ingest")
    early = F.col("k") % 10 < 7
    known = files.filter(early & (F.col("k") % 7 == 0)).groupBy("k").agg(F.first("path").alias("path"), F.array_sort(F.collect_set(F.regexp_extract("path", r"(\d+_\d+)_3B", 1))).alias("scene_ids"))
    ledger = known.select(F.concat(F.lit("ord"), F.col("k").cast("string")).alias("order_id"), F.regexp_extract("path", r"/(ev\d+)/", 1).alias("event_id"), F.regexp_extract("path", "/(pre|post)/", 1).alias("side"),
                          "scene_ids", F.lit(None).cast("struct<w:double,s:double,e:double,n:double>").alias("bbox"), F.lit(1).alias("pass"))
    for number, lot in ((1, early), (2, ~early)):
        deliveries.write_deliveries(files.filter(lot), root)
        ledger = deliveries.adopt(ledger, deliveries.read_new_deliveries(spark, root, state)).withColumn("pass", F.coalesce("pass", F.lit(number)))
    return ledger.select("order_id", "pass", "event_id", "side", F.array_join("scene_ids", ",").alias("scene_ids"), "source", *[F.round(f"bbox.{c}", 6).alias(c) for c in "wsen"])


@register("score_table_rewrites_one_event", views=("obs_l",), sql="""
SELECT event_id, "row", col, CASE WHEN event_id % 8 = 4 THEN -nir ELSE nir END / 7000.0::DOUBLE AS score, red AS evidence, event_id % 8 = 4 AS rewritten FROM obs_l""")
def q_scores(spark, d):
    """Bands of every event as a partitioned table; some events written anew leave all other events' files as they are."""
    cells = D.layer_observations(spark, d).select("event_id", "row", "col", (F.col("nir") / F.lit(7000.0)).alias("score"), F.col("red").alias("evidence"))
    path = shared_folder(spark, "scores")
    shape = "row int, col int, score double, evidence long, event_id long"
    sinks.write_scores(cells, path)

    def files(name):
        return sinks.score_files(spark, path).groupBy("event_id").agg(F.array_sort(F.collect_list("file")).alias(name))
    before = files("was")
    sinks.write_scores(cells.filter(F.col("event_id") % 8 == 4).withColumn("score", -F.col("score")), path)
    changed = before.join(files("now"), "event_id").select("event_id", (F.col("was") != F.col("now")).alias("rewritten"))
    # written, so that Spark knows its size when it is joined to the cells
    folder = shared_folder(spark, "files")
    changed.write.parquet(folder)
    return sinks.read_scores(spark, path, columns=shape).join(spark.read.schema(changed.schema).parquet(folder), "event_id")


@register("keys_of_one_host_removed", sql="""
SELECT page_id, 'a https://tiles.planet.com/x?v=1 b https://other.org/x?v=1&api_key=OTHERKEY' || page_id || ' c https://planet.com/y?v=2 ' || CASE WHEN page_id % 2 = 0 THEN 'https://planet.com/y' ELSE '' END AS clean FROM pages""")
def q_host(spark, d):
    """Key parameters leave the URLs of one host and its subdomains, other hosts' URLs stay."""
    i = F.col("page_id").cast("string")
    t = F.concat(F.lit("a https://tiles.planet.com/x?v=1&api_key=SECRETKEY"), i, F.lit(" b https://other.org/x?v=1&api_key=OTHERKEY"), i, F.lit(" c https://planet.com/y?api_key=SECRETKEY"), i, F.lit("&v=2 "),
                 F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("https://planet.com/y?api_key=SECRETKEY"), i)).otherwise(""))
    return D.table(spark, d, "pages").select("page_id", X.strip_url_keys(t, "planet.com").alias("clean"))


@register("known_key_hidden_however_spelled", sql="""
WITH k AS (SELECT doc_id, coalesce(text, '') AS text, substr(sha256('a' || doc_id), 1, 32) AS h FROM documents)
SELECT doc_id, sha256(text || ' 1 <KEY> 2 <KEY> 3 <KEY> 4 <KEY> 5 <KEY> 6 <KEY> 7 ' || substr(h, 1, 7)) AS digest FROM k""")
def q_known(spark, d):
    """A key the caller knows leaves each document as it is, percent-encoded, and as the UUID it is base64 of."""
    h = F.substring(F.sha2(F.concat(F.lit("a"), F.col("doc_id").cast("string")), 256), 1, 32)
    uuid = F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])
    dashed = F.base64(F.encode(uuid, "UTF-8"))
    forms = [dashed, F.url_encode(dashed), uuid, F.upper(uuid), h, F.upper(h)]
    parts = [F.coalesce("text", F.lit(""))]
    for n, f in enumerate(forms, 1):
        parts += [F.lit(f" {n} "), f]
    t = F.concat(*parts, F.lit(" 7 "), F.substring(h, 1, 7))
    return D.table(spark, d, "documents").select("doc_id", F.sha2(X.redact(t, dashed), 256).alias("digest"))
