"""Helpers the operators of this package share: reading tables, shared folders, stable cut points."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltmark.session import release, shared_folder, stable

ROW = "_siltmark_row"

__all__ = ["ROW", "read", "release", "shared_folder", "stable", "stored", "text_or_empty", "id_bucket", "numbered", "only_rows"]


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read from there: one job, and nothing of it stays on the driver."""
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def id_bucket(name: str, n: int) -> Column:
    """crc32 of the decimal id modulo n; a null id falls in bucket 0."""
    return F.coalesce(F.crc32(F.col(name).cast("string")) % n, F.lit(0))


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a number per row.  A table scan numbers its rows alike whenever it is read."""
    return docs.withColumn(ROW, F.monotonically_increasing_id())


def only_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose numbers ``rows`` lists, all columns as they came."""
    return numbered(docs).join(rows.select(ROW), ROW, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
