"""Ledger rows from delivered metadata files on shared storage.

Folders are listed and files opened by tasks: a list of files is a table, which the driver never holds.
"""

from __future__ import annotations

import functools

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.functions import geo
from siltmark.session import stable

LAYOUT = r"/(?:planet_cache|planet_render)/([^/]+)/(pre|post)/([^/]+)/"
SUFFIX = "_metadata.json"
BATCH = 1024        # paths or files a task hands on at once
SCENES = "path string, event_id string, side string, order_id string, scene_id string, points array<struct<lon:double,lat:double>>"


def _storage(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if ":" in path.split("/")[0] else f"file://{path}")


def write_deliveries(files: DataFrame, root: str) -> int:
    """Write ``path, body`` below a folder all executors reach; a file is whole or not there.  Returns how many.

    A repeated task writes the same files again.
    """
    def run(batches):
        there, base = _storage(root)
        n = 0
        for b in batches:
            for path, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                to = f"{base}/{path}"
                folder, name = to.rsplit("/", 1)
                there.create_dir(folder, recursive=True)
                with there.open_output_stream(f"{folder}/.{name}.part") as out:
                    out.write(body.encode())
                there.move(f"{folder}/.{name}.part", to)
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return files.select("path", "body").mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def listed(spark: SparkSession, root: str, suffix: str = SUFFIX) -> DataFrame:
    """``path`` of every file below ``root`` that ends so, metadata files if not told; names led by a dot or an underscore are passed over.

    One level of folders is listed at a time, each folder by one task.
    """
    there, base = _storage(root)
    shape = "path string, folder boolean"
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        own, _ = _storage(root)
        for b in batches:
            for folder in b.column(0).to_pylist():
                seen = [(i.path, i.type == fs.FileType.Directory) for i in own.get_file_info(fs.FileSelector(folder))
                        if i.base_name[0] not in "._" and (i.type == fs.FileType.Directory or i.base_name.endswith(suffix))]
                for k in range(0, len(seen), BATCH):
                    paths, folders = zip(*seen[k:k + BATCH])
                    yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(folders, pa.bool_())], ["path", "folder"])

    files, level = [], spark.createDataFrame([(base.rstrip("/"),)] if there.get_file_info(base).type == fs.FileType.Directory else [], "path string")
    while not level.isEmpty():
        found = stable(level.repartition(slices, "path").mapInArrow(run, shape))
        files.append(found.filter("NOT folder").select("path"))
        level = found.filter("folder").select("path")
    return functools.reduce(DataFrame.unionAll, files, level)


def opened(files: DataFrame, root: str) -> DataFrame:
    """``path, value``: the whole text of each file."""
    slices = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def run(batches):
        there, _ = _storage(root)
        for b in batches:
            paths = b.column(0).to_pylist()
            for k in range(0, len(paths), BATCH):
                part, bodies = paths[k:k + BATCH], []
                for path in part:
                    with there.open_input_stream(path) as f:
                        bodies.append(f.read().decode(errors="replace"))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.string()), pa.array(bodies, pa.string())], ["path", "value"])
    return files.select("path").repartition(slices, "path").mapInArrow(run, "path string, value string")


def parsed(docs: DataFrame, path: Column) -> DataFrame:
    """One row per file from ``value`` and its path: event, side, order (empty outside the layout), scene id, footprint points."""
    docs = docs.select("value", path.alias("path"))
    name = F.element_at(F.split("path", "/"), -1)
    pair = r"\[\s*(-?[\d.eE+-]+)\s*,\s*(-?[\d.eE+-]+)"
    pts = F.regexp_extract_all(F.get_json_object("value", "$.geometry.coordinates"), F.lit(pair), F.lit(0))

    def num(p, i):
        return F.regexp_extract(p, pair, i).try_cast("double")
    return docs.select(
        "path", F.regexp_extract("path", LAYOUT, 1).alias("event_id"), F.regexp_extract("path", LAYOUT, 2).alias("side"),
        F.regexp_extract("path", LAYOUT, 3).alias("order_id"),
        F.regexp_replace(name, r"(_3B.*)?_metadata\.json$", "").alias("scene_id"),
        F.transform(pts, lambda p: F.struct(num(p, 1).alias("lon"), num(p, 2).alias("lat"))).alias("points"))


def delivered(files: DataFrame) -> DataFrame:
    """The scenes among ``parsed`` files."""
    return files.filter(F.col("order_id") != "").drop("path")


def read_deliveries(spark: SparkSession, root: str) -> DataFrame:
    """All delivered scenes below ``root``."""
    return delivered(parsed(opened(listed(spark, root), root), F.col("path")))


def read_new_deliveries(spark: SparkSession, root: str, state: str) -> DataFrame:
    """Scenes whose files no earlier call with the same ``state`` folder has read; files read before are not opened again.

    What a call read is a folder of the state's table, paths included, and counts once it is written whole: a call that
    is lost half-way is taken up by the next one, and no file is counted twice.
    """
    there, base = _storage(state)
    n = 0
    while there.get_file_info(f"{base}/scenes/call={n}/_SUCCESS").type == fs.FileType.File:
        n += 1
    calls = [f"{state}/scenes/call={i}" for i in range(n + 1)]
    files = listed(spark, root)
    if n:
        files = files.join(spark.read.schema("path string").parquet(*calls[:n]).hint("merge"), "path", "left_anti")
    parsed(opened(files, root), F.col("path")).write.mode("overwrite").parquet(calls[n])
    return delivered(spark.read.schema(SCENES).parquet(calls[n]))


def adopt(ledger: DataFrame, scenes: DataFrame) -> DataFrame:
    """Known orders keep their row (a missing footprint is filled in); new ones are added.

    Both sides grow with the orders, so neither is broadcast.
    """
    b = F.when(F.size("points") > 0, geo.ring_box(F.col("points")))
    s = scenes.withColumn("_b", b)
    got = s.groupBy("order_id").agg(
        F.first("event_id").alias("event_id"), F.first("side").alias("side"),
        F.array_sort(F.collect_set("scene_id")).alias("scene_ids"),
        F.min("_b.w").alias("_w"), F.min("_b.s").alias("_s"), F.max("_b.e").alias("_e"), F.max("_b.n").alias("_n"))
    got = got.withColumn("bbox", F.when(F.col("_w").isNotNull(), F.struct(
        F.col("_w").alias("w"), F.col("_s").alias("s"), F.col("_e").alias("e"), F.col("_n").alias("n")))).drop("_w", "_s", "_e", "_n")
    have = ledger.join(got.select("order_id", F.col("bbox").alias("_box")).hint("merge"), "order_id", "left").withColumn(
        "bbox", F.coalesce("bbox", "_box")).drop("_box")
    fresh = got.join(ledger.select("order_id").hint("merge"), "order_id", "left_anti").withColumn("source", F.lit("adopted"))
    return have.unionByName(fresh, allowMissingColumns=True)
