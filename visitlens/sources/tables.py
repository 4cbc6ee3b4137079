"""Result tables as Parquet folders that can be updated by key, once for each batch.

A table is cut by an expression, its day as a rule.  An update rewrites only the slices that its rows
touch, into a folder named by the batch, and then puts a manifest in place that says which folder
holds each slice.  A batch that is played again finds its manifest and changes nothing; readers of one of the
last KEEP manifests are not disturbed, what only older ones name is deleted.  What the driver holds is the manifest, one line for each slice.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Manifests that stay readable.
KEEP = 20


class SlicedTable:
    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, keys: list[str], slice_by: str):
        self.spark, self.path, self.schema, self.keys, self.slice_by = spark, path.rstrip("/"), schema, keys, slice_by

    # -- manifest

    def _fs(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _manifests(self) -> list[tuple[int, str]]:
        fs, folder = self._fs(f"{self.path}/_manifests")
        if not fs.exists(folder):
            return []
        names = [x.getPath().getName() for x in fs.listStatus(folder)]
        return sorted((int(n[:-5]), f"{self.path}/_manifests/{n}") for n in names if n.endswith(".json") and n[0] != ".")

    def _manifest(self) -> tuple[int, dict[str, str]]:
        found = self._manifests()
        if not found:
            return -1, {}
        batch, path = found[-1]
        return batch, self._load(path)

    def _commit(self, batch_id: int, slices: dict[str, str]) -> None:
        text = json.dumps(slices, sort_keys=True).encode()
        fs, target = self._fs(f"{self.path}/_manifests/{batch_id}.json")
        _, draft = self._fs(f"{self.path}/_manifests/.{batch_id}.draft")
        out = fs.create(draft, True)
        out.write(bytearray(text))
        out.close()
        if not fs.rename(draft, target):
            raise OSError(f"batch {batch_id} could not be made visible: {target}")

    def _load(self, path: str) -> dict[str, str]:
        return json.loads(self.spark.read.text(path, wholetext=True).first()[0])

    def _prune(self) -> None:
        """Delete old manifests and the slices that no other names.  Slices go first: what is cut short is done next time."""
        found = self._manifests()
        old, kept = found[:-KEEP], found[-KEEP:]
        if not old:
            return
        # the newest manifests; a slice that a later one dropped is never named again
        named = {p for _, path in kept for p in self._load(path).values()}
        folders = {p.rsplit("/", 1)[0] for p in named}
        for _, manifest in old:
            gone = set(self._load(manifest).values()) - named
            for p in gone | ({p.rsplit("/", 1)[0] for p in gone} - folders):
                fs, target = self._fs(p)
                fs.delete(target, True)
            fs, target = self._fs(manifest)
            fs.delete(target, False)

    # -- reading and writing

    @property
    def last_batch(self) -> int:
        return self._manifest()[0]

    def read(self, slices: list[str] | None = None) -> DataFrame:
        """The table as of the last manifest, or some slices of it."""
        held = self._manifest()[1]
        paths = [p for s, p in sorted(held.items()) if slices is None or s in slices]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def merge(self, rows: DataFrame, batch_id: int, how: Callable[[DataFrame, DataFrame], DataFrame]) -> bool:
        """Replace the touched slices by ``how(held, rows)``; False if this batch has been applied before."""
        last, held = self._manifest()
        if batch_id <= last:
            return False
        key = F.coalesce(F.expr(self.slice_by).cast("string"), F.lit(""))
        touched = sorted(r[0] for r in rows.select(key).distinct().collect())
        if touched:
            folder = f"{self.path}/batch-{batch_id}"
            merged = how(self.read(touched), rows).select(*self.schema.names).withColumn("_slice", key)
            merged.write.mode("overwrite").partitionBy("_slice").parquet(folder)
            for s in touched:
                name = s.replace("%", "%25").replace("/", "%2F").replace(":", "%3A") or "__HIVE_DEFAULT_PARTITION__"
                held[s] = f"{folder}/_slice={name}"
            fs, _ = self._fs(folder)
            held = {s: p for s, p in held.items() if s not in touched or fs.exists(self._fs(p)[1])}
        self._commit(batch_id, held)
        self._prune()
        return True

    def add(self, rows: DataFrame, batch_id: int, amount: str) -> bool:
        """Add ``amount`` to the rows with the same key; new keys are inserted."""

        def how(held: DataFrame, new: DataFrame) -> DataFrame:
            both = held.select(*self.keys, amount).unionByName(new.select(*self.keys, amount))
            return both.groupBy(*self.keys).agg(F.sum(amount).alias(amount))

        return self.merge(rows, batch_id, how)

    def upsert(self, rows: DataFrame, batch_id: int) -> bool:
        """Rows replace those with the same key."""
        return self.merge(rows, batch_id, lambda held, new: held.join(new, self.keys, "left_anti").unionByName(new.select(*self.schema.names)))

    def insert_missing(self, rows: DataFrame, batch_id: int) -> bool:
        """Only rows with a new key are added."""
        return self.merge(rows, batch_id, lambda held, new: held.unionByName(new.select(*self.schema.names).join(held, self.keys, "left_anti").dropDuplicates(self.keys)))

    def replace_groups(self, rows: DataFrame, batch_id: int) -> bool:
        """All held rows of the groups (key columns) that ``rows`` has are replaced."""
        return self.merge(rows, batch_id, lambda held, new: held.join(new.select(*self.keys).distinct(), self.keys, "left_anti").unionByName(new.select(*self.schema.names)))


def write_result(df: DataFrame, path: str, task_id: int, append: bool = False) -> None:
    """Write a task's rows of a result table; running the task again replaces them, also by none, unless it is the second writer."""
    df.drop("task_id").write.mode("append" if append else "overwrite").parquet(f"{path}/task_id={int(task_id)}")
