"""Reading the driver's tables, and the one place that knows their layout."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt over as many partitions as shuffles have: where few bytes mean much work, files make too few tasks."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def dealt(rows: DataFrame, *keys: str, parts: int = 8) -> DataFrame:
    """Rows dealt by key, over ``parts`` times as many partitions as shuffles have: for steps that gather and sort whole groups, a
    task then holds so much less. What follows by these keys, or by them and others, needs no exchange."""
    return rows.repartition(parts * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def checkpointed(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint in the folder of ``spark.checkpoint.dir``, which all executors
    share. Only a local session may do without the setting: its threads share the driver's temporary folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="pagetally")
        context.setCheckpointDir(folder)
    return df.checkpoint()
