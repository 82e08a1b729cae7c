"""Reading tables and cutting lineage, in one place for every query."""

from __future__ import annotations

import os
import re
import tempfile

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` under ``root``; a file or a directory of part files."""
    return spark.read.parquet(os.path.join(root, f"{name}.parquet"))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared checkpoint folder and read it from there.

    The folder is the one that ``spark.checkpoint.dir`` names. Where it is unset, a session whose
    driver is its only process gets a folder of its own; on a cluster this raises ValueError, as
    a folder of one machine cannot be read by the others. The copy survives the loss of executors.
    """
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named and not re.fullmatch(r"local(?:\[[^\]]*\])?", context.master):
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = named or tempfile.mkdtemp(prefix="scholia-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def bounded_sample(df: DataFrame, key: Column, n: int, where: Column | None = None, spare: int = 2) -> list[Row]:
    """At most ``n`` rows for which ``where`` holds, those with the smallest hashes of ``key``; all of them in a table of no more.

    The rows are thinned out by their hash before any are sent, so what reaches the driver is
    bounded by ``n``, not by the number of partitions. With ``where``, ``spare`` times as many rows are
    looked at in one pass, which gives fewer than ``n`` where fewer than one in ``spare`` fits;
    counting a whole table of files before costs no pass.
    """
    total, wanted = df.count(), n * (1 if where is None else spare)
    order = F.xxhash64(key)
    if total > wanted:
        width = 1 << 40
        df = df.where(F.pmod(order, F.lit(width)) < int(width * min(1.0, (1.2 * wanted + 100) / total)))
        order = F.pmod(order, F.lit(width))
    # One task takes the last step, so that not every partition sends its first n.
    return (df if where is None else df.where(where)).repartition(1).orderBy(order).limit(n).collect()
