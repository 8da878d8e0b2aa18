"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def on_workers(spark: SparkSession) -> None:
    """Let Python workers that share this machine's files find the package, whatever folder the driver was started in.

    A cluster without shared files gets it as usual, by ``--py-files`` or an installed package.
    """
    root, env = os.path.dirname(os.path.dirname(os.path.abspath(__file__))), spark.sparkContext.environment
    held = [x for x in env.get("PYTHONPATH", "").split(os.pathsep) if x]
    if root not in held:
        env["PYTHONPATH"] = os.pathsep.join([root, *held])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    on_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``. Where it is unset a local session gets a folder of its
    own; a cluster, whose executors don't share this machine's folders, raises."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            return current.get()
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="weftline-checkpoint-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(named)
    return named


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it from there: the lineage ends here and survives lost executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As :func:`cut`, as a Parquet table: smaller where values repeat, and read by column. It stays in the checkpoint folder."""
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/weftline-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """Add columns that are computed exactly once for a row: later filters on them stay above, instead of repeating costly expressions
    below. A one-element explode is the barrier; it stays in generated code and moves no data."""
    for name, column in columns.items():
        df = df.withColumn(name, F.explode(F.array(column)))
    return df


def small_rows(df: DataFrame, at_most: int = 10_000) -> list:
    """Rows of a reference table of fixed size. Raises instead of collecting a table that has outgrown ``at_most`` rows."""
    rows = df.limit(at_most + 1).collect()
    if len(rows) > at_most:
        raise ValueError(f"a reference table has more than {at_most} rows")
    return rows
