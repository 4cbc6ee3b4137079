"""Helpers shared by the corpus operators: table access, shared scratch tables, row numbers, hashing."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seed of the second 64-bit half of a 128-bit key.
SECOND_SEED = 7_919_113
#: Shuffle files of a finished write are deleted at once: nothing reads them again.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; on a cluster that is an error, since no folder
    of one machine is seen by the others.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    kept = spark.sparkContext._jsc.sc().getCheckpointDir()
    if kept.isDefined():
        return kept.get()
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
    where = "file://" + tempfile.mkdtemp(prefix="visitlens-")
    spark.sparkContext.setCheckpointDir(where)
    return where


class Scratch:
    """Tables written to the shared folder to cut lineage; they survive the loss of any executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.n = spark, 0
        self.base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"

    def save(self, df: DataFrame, name: str, by: str | None = None) -> DataFrame:
        """``df`` as a written table, in one folder for each value of column ``by``."""
        self.n += 1
        path = f"{self.base}/{self.n:03d}-{name}"
        conf, before = self.spark.conf, self.spark.conf.get(_CLEAN, None)
        if before is not None:
            conf.set(_CLEAN, "true")
        try:
            (df.write.partitionBy(by) if by else df.write).parquet(path)
        finally:
            if before is not None:
                conf.set(_CLEAN, before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
            path.getFileSystem(conf).delete(path, True)


#: Rows of one short key that are broadcast at most, and bytes of longer rows.
FEW_KEYS, FEW_BYTES = 1_000_000, 32 << 20


def if_few(keys: DataFrame, most: int = FEW_KEYS) -> DataFrame:
    """``keys``, rows of a number or two, to be broadcast if they are counted and few; else a join moves both sides as usual."""
    return F.broadcast(keys) if keys.limit(most + 1).count() <= most else keys


def if_small(rows: DataFrame, size: Column, most: int = FEW_BYTES) -> DataFrame:
    """``rows``, to be broadcast if their sizes in bytes, summed up first, are small in all."""
    return F.broadcast(rows) if (rows.agg(F.sum(size)).first()[0] or 0) <= most else rows


#: Files whose names are numbered at most; a table of more is written again with row numbers.
MAX_FILES = 100_000
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):/+"


def numbered(docs: DataFrame, scratch: Scratch, name: str = "rid") -> DataFrame:
    """``docs`` with a number for each row that is the same however often the plan is evaluated.

    Rows of a plain scan are numbered by file (in the order of names) and place in the file, whatever the splits
    are.  Rows of any other plan are written with numbers first, since a plan with a shuffle may deal its rows
    otherwise when it runs again.
    """
    files = _scanned_files(docs)
    if files is None:
        return scratch.save(docs.withColumn(name, F.monotonically_increasing_id()), "numbered")
    known = docs.sparkSession.createDataFrame([(f, i) for i, f in enumerate(files)], "file__ string, file_no__ long")
    path = F.regexp_replace(F.col("_metadata.file_path"), _SCHEME, "$1:/")
    with_file = docs.select("*", path.alias("file__"), F.col("_metadata.row_index").alias("row_index__"))
    number = F.shiftleft(F.coalesce("file_no__", F.raise_error(F.concat(F.lit("unknown file "), "file__")).cast("long")), 33) + F.col("row_index__")
    return with_file.join(F.broadcast(known), "file__", "left").select(*docs.columns, number.alias(name))


def _scanned_files(docs: DataFrame) -> list[str] | None:
    """Files of a plan that only scans, selects and filters, in a fixed order; None for others."""
    if "_metadata" in docs.columns or not docs._jdf.queryExecution().analyzed().deterministic():
        return None
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except AnalysisException:
        return None
    files = sorted({re.sub(_SCHEME, r"\1:/", f) for f in docs.inputFiles()})
    return files if len(files) <= MAX_FILES else None


def unit_interval(*cols: Column) -> Column:
    """A number in [0, 1) that depends on the given columns alone."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 11).cast("double") / F.lit(float(1 << 53))


def shield(docs: DataFrame, needed: tuple[str, ...] = ("doc_id", "text", "source")):
    """``docs`` with all other columns renamed out of the way, and a function that brings them back.

    That function takes a frame and the names of columns added to it; these replace columns of the same name.
    """
    names: list[str] = []
    for i, c in enumerate(docs.columns):
        names.append(c if c in needed and c not in names else f"x{i}__")

    def restore(df: DataFrame, *added: str) -> DataFrame:
        return df.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns, strict=True) if c not in added], *added)

    return docs.toDF(*names), restore


#: Rows and bytes of text that a Python worker holds as objects at a time.
SLICE_ROWS, SLICE_BYTES = 512, 1 << 20


def slices(batch: pa.RecordBatch, column: str = "text") -> Iterator[tuple[pa.RecordBatch, list[bytes | None]]]:
    """Parts of an Arrow batch with their texts in UTF-8, so that few texts are Python objects at the same time."""
    texts = batch.column(batch.schema.get_field_index(column)).cast(pa.large_binary())
    ends = texts.buffers()[1]
    offsets = memoryview(ends).cast("q")[texts.offset : texts.offset + len(texts) + 1] if ends is not None else [0] * (len(texts) + 1)
    first = 0
    while first < len(texts):
        last = first + 1
        while last < len(texts) and last - first < SLICE_ROWS and offsets[last + 1] - offsets[first] <= SLICE_BYTES:
            last += 1
        yield batch.slice(first, last - first), texts.slice(first, last - first).to_pylist()
        first = last
