"""Adapter from the star-schema tables to the behaviour model.

Each view selects only what it needs, so column pruning reaches the scan of the table behind it.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.sources.shared import Shared

PAGES, CATEGORIES, PRODUCTS, CITIES, ADS = 10, 20, 100, 25, 10


@dataclass
class Views:
    """The model's tables over a folder of Parquet files."""

    spark: SparkSession
    folder: str

    def _table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self._table("events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))

    @cached_property
    def shared(self) -> Shared:
        return Shared(self.spark, "queries")

    @cached_property
    def user_visit_action(self) -> DataFrame:
        return self._actions(self.events)

    def actions_on(self, first: str | None = None, end: str | None = None) -> DataFrame:
        """``user_visit_action`` of the days from ``first`` to before ``end``, by bounds on the stored time, which reach the scan."""
        events = self.events
        if first:
            events = events.where(F.col("ts") >= self._time(dt.date.fromisoformat(first)))
        if end:
            events = events.where(F.col("ts") < self._time(dt.date.fromisoformat(end)))
        return self._actions(events)

    def clicks_in(self, start: str, end: str) -> DataFrame:
        """``user_visit_action`` of the clicks between two points in time, both included, by stored columns."""
        ts, second = F.col("ts"), dt.timedelta(seconds=1)
        first, last = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end).replace(microsecond=0)
        return self._actions(self.events.where((F.col("event_type") == "click") & (ts >= self._time(first)) & (ts < self._time(last + second))))

    def _time(self, at: dt.date) -> Column:
        return F.lit(at.isoformat().replace("T", " ")).cast(self.events.schema["ts"].dataType)

    def create_views(self) -> list[str]:
        """The model's tables as temporary views for SQL text."""
        names = ["user_visit_action", "user_info", "product_info", "city_info", "ad_log"]
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)
        return names

    def _actions(self, events: DataFrame) -> DataFrame:
        k = F.col("k")

        def only(kind: str, value: Column) -> Column:
            return F.when(F.col("event_type") == kind, value)

        def text(c: Column) -> Column:
            return c.cast("string")

        date = F.date_format("ts", "yyyy-MM-dd")
        return events.select(
            "event_id",
            date.alias("date"),
            "user_id",
            F.concat_ws("_", text(F.col("user_id")), date).alias("session_id"),
            (k % PAGES).alias("page_id"),
            F.date_trunc("second", "ts").alias("action_time"),
            only("view", F.concat(F.lit("kw"), text(k % 10))).alias("search_keyword"),
            only("click", k % CATEGORIES).alias("click_category_id"),
            only("click", k).alias("click_product_id"),
            only("signup", F.concat_ws(",", text(k % CATEGORIES), text((k + 7) % CATEGORIES))).alias("order_category_ids"),
            only("signup", F.concat_ws(",", text(k), text((k + 1) % PRODUCTS))).alias("order_product_ids"),
            only("purchase", text(k % CATEGORIES)).alias("pay_category_ids"),
            only("purchase", text(k)).alias("pay_product_ids"),
            (F.col("user_id") % CITIES).alias("city_id"),
        )

    @cached_property
    def user_info(self) -> DataFrame:
        key = F.col("c_custkey")
        return self._table("customer").select(
            key.alias("user_id"),
            F.col("c_name").alias("username"),
            F.col("c_name").alias("name"),
            (F.lit(18) + key % 50).cast("int").alias("age"),
            F.col("c_mktsegment").alias("professional"),
            F.concat(F.lit("NATION_"), F.col("c_nationkey").cast("string")).alias("city"),
            F.when(key % 2 == 0, "male").otherwise("female").alias("gender"),
        )

    @cached_property
    def product_info(self) -> DataFrame:
        status = F.concat(F.lit('{"product_status": '), (F.col("p_partkey") % 2).cast("string"), F.lit("}"))
        return self._table("part").select(F.col("p_partkey").alias("product_id"), F.col("p_name").alias("product_name"), status.alias("extend_info"))

    @cached_property
    def city_info(self) -> DataFrame:
        nation, region = self._table("nation"), self._table("region")
        return nation.join(region, nation["n_regionkey"] == region["r_regionkey"]).select(
            F.col("n_nationkey").alias("city_id"), F.col("n_name").alias("city_name"), F.col("r_name").alias("area")
        )

    @cached_property
    def ad_log(self) -> DataFrame:
        """Clicks as an ad log; names are single words, as in the text form of the log."""

        def word(c: str) -> Column:
            return F.replace(F.col(c), F.lit(" "), F.lit("-"))

        clicks = self.events.where("event_type = 'click'").select(
            F.col("ts").cast("timestamp").alias("ts"), "user_id", (F.col("k") % ADS).alias("ad_id"), (F.col("user_id") % CITIES).alias("city_id")
        )
        return clicks.join(self.city_info, "city_id").select("ts", word("area").alias("province"), word("city_name").alias("city"), "user_id", "ad_id")


#: The same views for DuckDB, to be put before a query.
SQL_VIEWS = """
WITH ev AS (
  SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, strftime(ts, '%Y-%m-%d') AS day FROM events
), user_visit_action AS (
  SELECT event_id, day AS date, user_id, user_id || '_' || day AS session_id, k % 10 AS page_id, date_trunc('second', ts) AS action_time,
    CASE WHEN event_type = 'view' THEN 'kw' || (k % 10) END AS search_keyword,
    CASE WHEN event_type = 'click' THEN k % 20 END AS click_category_id, CASE WHEN event_type = 'click' THEN k END AS click_product_id,
    CASE WHEN event_type = 'signup' THEN (k % 20) || ',' || ((k + 7) % 20) END AS order_category_ids,
    CASE WHEN event_type = 'signup' THEN k || ',' || ((k + 1) % 100) END AS order_product_ids,
    CASE WHEN event_type = 'purchase' THEN CAST(k % 20 AS VARCHAR) END AS pay_category_ids, CASE WHEN event_type = 'purchase' THEN CAST(k AS VARCHAR) END AS pay_product_ids,
    user_id % 25 AS city_id
  FROM ev
), user_info AS (
  SELECT c_custkey AS user_id, c_name AS username, c_name AS name, CAST(18 + c_custkey % 50 AS INTEGER) AS age, c_mktsegment AS professional,
    'NATION_' || c_nationkey AS city, CASE WHEN c_custkey % 2 = 0 THEN 'male' ELSE 'female' END AS gender
  FROM customer
), product_info AS (
  SELECT p_partkey AS product_id, p_name AS product_name, '{"product_status": ' || (p_partkey % 2) || '}' AS extend_info FROM part
), city_info AS (
  SELECT n_nationkey AS city_id, n_name AS city_name, r_name AS area FROM nation JOIN region ON n_regionkey = r_regionkey
), ad_log AS (
  SELECT ts, replace(area, ' ', '-') AS province, replace(city_name, ' ', '-') AS city, user_id, k % 10 AS ad_id
  FROM ev JOIN city_info ON user_id % 25 = city_id WHERE event_type = 'click'
)
"""
