"""Seeded test data of any size, made on the executors by hashing row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Search words of the generated sessions.
KEYWORDS = ["火锅", "蛋糕", "重庆辣子鸡", "重庆小面", "呷哺呷哺", "新辣道鱼火锅", "国贸大厦", "太古商场", "日本料理", "温泉"]


def _draw(n: int, *keys) -> Column:
    return F.pmod(F.xxhash64(*[F.lit(k) if isinstance(k, (str, int)) else k for k in keys]), F.lit(n))


def mock_actions(spark: SparkSession, sessions: int = 1000, actions: int = 11, users: int = 100, day: str = "2017-07-23", seed: int = 1) -> DataFrame:
    """user_visit_action with ``actions`` rows a session on average."""
    base = spark.range(sessions).select(
        F.col("id").alias("s"),
        _draw(users, F.col("id"), "user", seed).alias("user_id"),
        F.md5(F.concat_ws("-", F.col("id"), F.lit(seed))).alias("session_id"),
        (_draw(2 * actions - 1, F.col("id"), "n", seed) + 1).cast("int").alias("n"),
        _draw(23, F.col("id"), "hour", seed).alias("hour"),
    )
    rows = base.select("*", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"))

    def drawn(n: int, what: str) -> Column:
        return _draw(n, F.col("s"), F.col("i"), what, seed)

    kind = drawn(4, "kind")
    time = F.to_timestamp(F.lit(day)) + F.make_interval(hours=F.col("hour").cast("int"), mins=drawn(59, "minute").cast("int"), secs=drawn(59, "second").cast("decimal(18,6)"))
    return rows.select(
        F.lit(day).alias("date"),
        "user_id",
        "session_id",
        drawn(10, "page").alias("page_id"),
        time.alias("action_time"),
        F.when(kind == 0, F.element_at(F.array(*[F.lit(k) for k in KEYWORDS]), drawn(10, "keyword").cast("int") + 1)).alias("search_keyword"),
        F.when(kind == 1, drawn(100, "category")).alias("click_category_id"),
        F.when(kind == 1, drawn(100, "product")).alias("click_product_id"),
        *[
            F.when(kind == k, drawn(100, what).cast("string")).alias(name)
            for k, what, name in ((2, "category", "order_category_ids"), (2, "product", "order_product_ids"), (3, "category", "pay_category_ids"), (3, "product", "pay_product_ids"))
        ],
        drawn(10, "city").alias("city_id"),
    )


def mock_users(spark: SparkSession, users: int = 100, seed: int = 1) -> DataFrame:
    i = F.col("id")
    return spark.range(users).select(
        i.alias("user_id"),
        F.concat(F.lit("user"), i).alias("username"),
        F.concat(F.lit("name"), i).alias("name"),
        _draw(60, i, "age", seed).cast("int").alias("age"),
        F.concat(F.lit("professional"), _draw(100, i, "professional", seed)).alias("professional"),
        F.concat(F.lit("city"), _draw(100, i, "city", seed)).alias("city"),
        F.when(_draw(2, i, "gender", seed) == 0, "male").otherwise("female").alias("gender"),
    )


def mock_products(spark: SparkSession, products: int = 100, seed: int = 1) -> DataFrame:
    i = F.col("id")
    status = F.concat(F.lit('{"product_status": '), _draw(2, i, "status", seed), F.lit("}"))
    return spark.range(products).select(i.alias("product_id"), F.concat(F.lit("product"), i).alias("product_name"), status.alias("extend_info"))
