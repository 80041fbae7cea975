"""Exact dedup by content sort (operator 7), DataFrame functions only.

Normalised texts are range-partitioned by splitters that Spark samples, sorted externally, and
neighbours are compared in full.  Splitters are the first ``HEAD`` characters, a hash and the input split,
so what the sampling sends to the driver does not grow with the length of texts, and a text that a third of
all rows share stays contiguous in the order but is dealt over as many tasks as it has input splits.
Each run of equal neighbours within one split elects its row; the few runs of one text (at most one
a split) are then merged by the SHA-256 of the text, on rows of about a hundred bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siltmark.llm.sharing import ROW, only_rows, read, stable, text_or_empty

HEAD = 32
SPACES = r"[\x20\x09-\x0D]+"


def content_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One narrow row per document: digest, and the row its run of equal neighbours elects.

    Columns: doc_id, text_sha256, slice, place (1 = elected in its run), run_size, n_points, row number.
    """
    d = docs.select(
        F.col(id_col).alias("doc_id"),
        F.regexp_replace(text_or_empty(text_col), SPACES, "").alias("body"),
        F.length(text_or_empty(text_col)).alias("n_points"),
        F.spark_partition_id().alias("slice"), F.monotonically_increasing_id().alias(ROW),
    ).withColumns({"head": F.substring("body", 1, HEAD), "hash": F.xxhash64("body")})
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = d.repartitionByRange(parts, "head", "hash", "slice")
    run = W.partitionBy("head", "hash", "slice", "body")
    return ranged.select(
        "doc_id", "slice", "n_points", ROW,
        F.row_number().over(run.orderBy(F.desc("n_points"), F.col("doc_id").asc_nulls_last())).alias("place"),
        F.count(F.lit(1)).over(run).alias("run_size"),
        F.sha2("body", 256).alias("text_sha256"),
    )


def mark_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: which row of its text stays.

    Of equal normalised texts the row with the most code points stays, then the smallest id.  A null
    text counts as empty.  A null id loses every tie.  Of rows equal in text and id exactly one is
    marked as kept.  Input columns other than the two named are ignored; an empty table gives no rows.
    """
    runs = stable(content_runs(docs, id_col, text_col))
    heads = runs.filter(F.col("place") == 1)
    order = F.struct((-F.col("n_points")).alias("a"), F.col("doc_id").isNull().alias("b"),
                     F.col("doc_id").alias("c"), F.col("slice").alias("d"))
    groups = stable(heads.groupBy("text_sha256").agg(
        F.min(order).alias("best"), F.sum("run_size").alias("group_size")))
    return runs.join(groups, "text_sha256").select(
        "doc_id", F.col("best.c").alias("keep_id"), "group_size",
        ((F.col("place") == 1) & (F.col("slice") == F.col("best.d"))).alias("kept"), "text_sha256", ROW)


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each normalised text, all columns as they came."""
    return only_rows(docs, mark_copies(docs, id_col, text_col).filter("kept"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the id that stays for its text."""
    return mark_copies(read(spark, sf_dir, "documents")).drop(ROW)


SQL = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body,
                  length(coalesce(text, '')) AS n FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
       row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM d WINDOW w AS (PARTITION BY body ORDER BY n DESC, doc_id NULLS LAST)
"""
