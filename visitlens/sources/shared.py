"""Intermediate results that several plans read: written once, where driver and executors see them."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where it is unset, a local session gets a temporary folder and a cluster an error."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    folder = tempfile.mkdtemp(prefix="visitlens-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return shared_folder(spark)


class Shared:
    """Written tables of one job.  They outlive lost executors, and go when the job ends (``with``)."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name = spark, name
        self._base: str | None = None

    @property
    def base(self) -> str:
        if self._base is None:
            self._base = f"{shared_folder(self.spark)}/{self.name}-{uuid.uuid4().hex}"
        return self._base

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.base}/{name}"
        df.write.mode("errorifexists").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def __enter__(self) -> Shared:
        return self

    def __exit__(self, *_) -> None:
        if self._base:
            p = self.spark._jvm.org.apache.hadoop.fs.Path(self._base)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
