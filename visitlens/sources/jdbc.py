"""Tables in a database over JDBC; connections and batches are Spark's."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

#: Longest text key of a table that this module makes.
KEY_LENGTH = 255


@dataclass(frozen=True)
class JdbcStore:
    """Reads and writes tables under one URL.  ``properties`` may hold user, password and driver."""

    spark: SparkSession
    url: str
    properties: dict[str, str] = field(default_factory=dict)
    batch_size: int = 1000

    def read(self, table: str, column: str | None = None, low: int = 0, high: int = 0, parts: int = 1) -> DataFrame:
        """A whole table or query; with a numeric column, in ``parts`` ranges read at the same time."""
        if column and parts > 1:
            return self.spark.read.jdbc(self.url, table, column=column, lowerBound=low, upperBound=high, numPartitions=parts, properties=self.properties)
        return self.spark.read.jdbc(self.url, table, properties=self.properties)

    def append(self, df: DataFrame, table: str, connections: int | None = None) -> None:
        out = df.coalesce(connections) if connections else df
        out.write.option("batchsize", self.batch_size).jdbc(self.url, table, mode="append", properties=self.properties)

    def replace(self, df: DataFrame, table: str) -> None:
        df.write.option("batchsize", self.batch_size).option("truncate", "true").jdbc(self.url, table, mode="overwrite", properties=self.properties)

    # -- updates: rows are staged by Spark's writer, then moved by the database in one transaction

    def upsert(self, df: DataFrame, table: str, keys: Sequence[str]) -> None:
        """Rows replace those with the same key, the others are inserted.  Keys aren't null and single in ``df``."""
        staged = self._stage(df, table, keys)
        self._execute(*self._move(df, table, staged, self._same(table, staged, keys)), f"DROP TABLE {staged}")

    def add(self, df: DataFrame, table: str, keys: Sequence[str], amount: str) -> None:
        """``amount`` is added to that of the row with the same key; new keys are inserted."""
        staged, q = self._stage(df, table, keys), self._quote
        same = self._same(table, staged, keys)
        held = f"UPDATE {staged} SET {q(amount)} = {q(amount)} + COALESCE((SELECT {table}.{q(self._own(table, amount))} FROM {table} WHERE {same}), 0)"
        self._execute(held, *self._move(df, table, staged, same), f"DROP TABLE {staged}")

    def insert_missing(self, df: DataFrame, table: str, keys: Sequence[str]) -> None:
        """Only rows with a new key are inserted."""
        staged = self._stage(df, table, keys)
        known = f"DELETE FROM {staged} WHERE EXISTS (SELECT 1 FROM {table} WHERE {self._same(table, staged, keys)})"
        self._execute(known, self._move(df, table, staged, "1 = 0")[1], f"DROP TABLE {staged}")

    def replace_where(self, df: DataFrame, table: str, values: Mapping[str, int]) -> None:
        """The rows with these values are replaced by ``df``, also where it is empty."""
        staged = self._stage(df, table)
        which = " AND ".join(f"{self._quote(self._own(table, c))} = {int(v)}" for c, v in values.items())
        self._execute(f"DELETE FROM {table} WHERE {which}", self._move(df, table, staged, "1 = 0")[1], f"DROP TABLE {staged}")

    def _stage(self, df: DataFrame, table: str, keys: Sequence[str] = ()) -> str:
        """``df`` in a table of its own, left over ones of a run that failed are overwritten; ``table`` is made if there is none."""
        # not every database compares texts of any length
        types = ", ".join(f"`{k}` VARCHAR({KEY_LENGTH})" for k in keys if df.schema[k].dataType.typeName() == "string")

        def write(rows: DataFrame, name: str) -> None:
            out = rows.write.option("batchsize", self.batch_size)
            (out.option("createTableColumnTypes", types) if types else out).jdbc(self.url, name, mode="overwrite", properties=self.properties)

        if not self._exists(table):
            write(df.limit(0), table)
        staged = f"{table}_staged"
        write(df, staged)
        return staged

    def _move(self, df: DataFrame, table: str, staged: str, same: str) -> list[str]:
        theirs = ", ".join(self._quote(self._own(table, c)) for c in df.columns)
        ours = ", ".join(self._quote(c) for c in df.columns)
        return [f"DELETE FROM {table} WHERE EXISTS (SELECT 1 FROM {staged} WHERE {same})", f"INSERT INTO {table} ({theirs}) SELECT {ours} FROM {staged}"]

    def _same(self, table: str, staged: str, keys: Sequence[str]) -> str:
        return " AND ".join(f"{staged}.{self._quote(k)} = {table}.{self._quote(self._own(table, k))}" for k in keys)

    def _own(self, table: str, column: str) -> str:
        """The column's name as the table spells it."""
        return next((c for c in self.read(table).columns if c.lower() == column.lower()), column)

    def _quote(self, name: str) -> str:
        return self.spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(self.url).quoteIdentifier(name)

    def _connect(self):
        jvm = self.spark._jvm
        if "driver" in self.properties:
            jvm.org.apache.spark.sql.execution.datasources.jdbc.DriverRegistry.register(self.properties["driver"])
        login = jvm.java.util.Properties()
        for k, v in self.properties.items():
            if k != "driver":
                login.setProperty(k, v)
        return jvm.java.sql.DriverManager.getConnection(self.url, login)

    def _exists(self, table: str) -> bool:
        con = self._connect()
        try:
            con.createStatement().executeQuery(f"SELECT 1 FROM {table} WHERE 1 = 0")
            return True
        except Py4JJavaError:
            return False
        finally:
            con.close()

    def _execute(self, *statements: str) -> None:
        con = self._connect()
        try:
            con.setAutoCommit(False)
            for statement in statements:
                con.createStatement().executeUpdate(statement)
            con.commit()
        except Exception:
            con.rollback()
            raise
        finally:
            con.close()
