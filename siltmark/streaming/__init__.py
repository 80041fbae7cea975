"""Continuous ledger upkeep.

There is no windowed or stateful stream in this domain; the one incremental job is the
order ledger, whose upsert by key runs per micro-batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltmark.operators.ledger import upsert


def ledger_batch(ledger_path: str):
    """``foreachBatch`` function: fold a micro-batch of records into the next ledger version.

    Each batch writes its own ``version=<batch>`` folder from the newest earlier one, so a retried
    batch overwrites only itself and skipped numbers do no harm.  Of several records of an
    order in a batch the one created last counts.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rest = [c for c in batch.columns if c != "order_id"]
        newest = batch.groupBy("order_id").agg(F.max_by(F.struct(*rest), F.struct("created", *[c for c in rest if c != "created"])).alias("r")).select("order_id", "r.*")
        try:
            seen = spark.read.parquet(ledger_path).filter(F.col("version") < batch_id)
            last = seen.agg(F.max("version")).first()[0]
        except AnalysisException:  # no version yet
            last = None
        if last is not None:
            newest = upsert(spark.read.parquet(f"{ledger_path}/version={last}"), newest)
        newest.write.mode("overwrite").parquet(f"{ledger_path}/version={batch_id}")
    return run
