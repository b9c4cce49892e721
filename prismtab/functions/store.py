"""Cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def cut(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint under spark.checkpoint.dir. Where none is set, a run on this one machine takes a temporary folder; a cluster must name one."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        found = spark.conf.get("spark.checkpoint.dir", None)
        if not found and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(found or tempfile.mkdtemp(prefix="prismtab-"))
    return df.checkpoint(eager=True)


def find_package(spark: SparkSession) -> None:
    """Python workers find this package where the driver does, however it was put on the driver's path."""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = env.get("PYTHONPATH", "").split(os.pathsep)
    if here not in paths:
        env["PYTHONPATH"] = os.pathsep.join([here, *[p for p in paths if p]])
