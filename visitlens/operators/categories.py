"""Category popularity: counts by kind of action, top categories, and their top sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.scalars import ids_of

TOP = 10


def category_events(actions: DataFrame) -> DataFrame:
    """(kind, category_id): one row for each category that an action clicks, orders or pays."""

    def tagged(kind: str, ids):
        return F.transform(ids, lambda x: F.struct(F.lit(kind).alias("kind"), x.cast("long").alias("category_id")))

    clicked = F.when(F.col("click_category_id").isNotNull(), F.array("click_category_id")).otherwise(F.array().cast("array<bigint>"))
    kinds = F.concat(tagged("click", clicked), tagged("order", ids_of(F.col("order_category_ids"))), tagged("pay", ids_of(F.col("pay_category_ids"))))
    return actions.select(F.explode(kinds).alias("e")).select("e.kind", "e.category_id")


def category_counts(actions: DataFrame) -> DataFrame:
    """Three counts a category in one aggregation."""
    return category_events(actions).groupBy("category_id").agg(*[F.count(F.when(F.col("kind") == k, 1)).alias(f"{k}_count") for k in ("click", "order", "pay")])


def category_distinct(actions: DataFrame) -> DataFrame:
    return category_events(actions).select("category_id").distinct()


def top_categories(actions: DataFrame, n: int = TOP, task_id: int = 0) -> DataFrame:
    """The first ``n`` by clicks, orders, payments, all descending; ties by category."""
    ordered = category_counts(actions).orderBy(F.desc("click_count"), F.desc("order_count"), F.desc("pay_count"), "category_id")
    return ordered.limit(n).select(F.lit(task_id).cast("long").alias("task_id"), "category_id", "click_count", "order_count", "pay_count")


def category_session_count(actions: DataFrame) -> DataFrame:
    clicks = actions.where(F.col("click_category_id").isNotNull())
    return clicks.groupBy(F.col("click_category_id").alias("category_id"), "session_id").agg(F.count("*").alias("click_count"))


def top_sessions(actions: DataFrame, categories: DataFrame, n: int = TOP, task_id: int = 0) -> DataFrame:
    """For each of at most TOP categories the ``n`` sessions with most clicks; ties by session."""
    per = category_session_count(actions).join(F.broadcast(categories.select("category_id")), "category_id")
    order = Window.partitionBy("category_id").orderBy(F.desc("click_count"), "session_id")
    return per.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).select(F.lit(task_id).cast("long").alias("task_id"), "category_id", "session_id", "click_count")
