"""Cutting lineage where a long composition would grow its plan without bound."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder of ``spark.checkpoint.dir`` and read from there.

    Where the setting is absent, a temporary folder serves a local master, and others raise: their machines share none.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(base or "file://" + tempfile.mkdtemp(prefix="lamella-"))
    return df.checkpoint()
