"""Incremental appends: micro-batches merged into a table of snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftline.operators import merge


def append_stream(stream: DataFrame, folder: str, on: list[str], values: list[str], order: str, checkpoint: str, check_empty: bool = False) -> StreamingQuery:
    """Merge every micro-batch of ``stream`` into the newest snapshot below ``folder``, by :func:`weftline.operators.merge.append`.

    Of rows with equal coordinates in a batch the last by ``order`` counts. Snapshots are named by their batch, so that a batch that is
    run again after a failure writes the same snapshot over; the newest one before stays as its base. A stream that starts from
    nothing over a folder with snapshots raises.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        last = batch.groupBy(*on).agg(F.max(F.struct(order, *values)).alias("_r")).select(*on, F.col(f"_r.{order}").alias("pos"), *(F.col(f"_r.{v}").alias(v) for v in values))
        base = _snapshot_before(spark, folder, batch_id)
        if base is None:
            base = last.limit(0)
        merge.append(base.withColumn("pos", F.col("pos").cast("long")), last.withColumn("pos", F.col("pos").cast("long")), on, values, check_empty=check_empty).write.mode("overwrite").parquet(f"{folder}/batch={batch_id:08d}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _snapshot_before(spark, folder: str, batch_id: int) -> DataFrame | None:
    """The newest whole snapshot before a batch; None only for the first batch of an empty folder. One whose write broke off is no snapshot."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [f.getPath() for f in fs.listStatus(path)] if fs.exists(path) else []
    held = {int(p.getName()[6:]) for p in found if p.getName().startswith("batch=") and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    before = [b for b in held if b < batch_id]
    if held - {0} if not batch_id else not before:
        raise RuntimeError(f"{folder} doesn't hold the snapshots before batch {batch_id}, or holds later ones: rows would be lost")
    return spark.read.parquet(f"{folder}/batch={max(before):08d}") if before else None


def snapshot(spark, folder: str) -> DataFrame:
    """The newest snapshot."""
    newest = spark.read.parquet(folder).agg(F.max("batch")).first()[0]
    return spark.read.parquet(f"{folder}/batch={int(newest):08d}")
