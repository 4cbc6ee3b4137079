"""Most clicked products of every area."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.scalars import concat2, group_concat_distinct, json_field

TOP = 3
#: Level of each area, first of the original regions, then of the regions in the star schema.
AREA_LEVELS = {"A级": ("华北", "华东"), "B级": ("华南", "华中"), "C级": ("西北", "西南")}
REGION_LEVELS = {"A级": ("AMERICA", "EUROPE"), "B级": ("ASIA",), "C级": ("MIDDLE EAST", "AFRICA")}
OTHER_LEVEL = "D级"


def click_actions(actions: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """Clicks on a product; ``start`` and ``end`` are points in time, both included."""
    product = F.col("click_product_id")
    out = actions.where(product.isNotNull() & ~product.cast("string").isin("NULL", "null"))
    if start:
        out = out.where(F.col("action_time") >= F.lit(start).cast("timestamp"))
    if end:
        out = out.where(F.col("action_time") <= F.lit(end).cast("timestamp"))
    return out.select("city_id", product.cast("long").alias("product_id"))


def click_city(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    return clicks.join(cities, "city_id").select("city_id", "city_name", "area", "product_id")


def area_product_clicks(clicks: DataFrame, cities: DataFrame) -> DataFrame:
    """Clicks by area and product, with the cities they came from.

    Clicks are counted by city first, so that one row for each city and product meets the city names.
    """
    per_city = clicks.groupBy("city_id", "product_id").agg(F.count("*").alias("n"))
    return (
        click_city_counts(per_city, cities)
        .groupBy("area", "product_id")
        .agg(F.sum("n").alias("click_count"), group_concat_distinct(concat2(F.col("city_id"), F.col("city_name"), ":")).alias("city_infos"))
    )


def click_city_counts(per_city: DataFrame, cities: DataFrame) -> DataFrame:
    return per_city.join(cities, "city_id")


def area_level(area: Column, levels: Mapping[str, Sequence[str]] = AREA_LEVELS) -> Column:
    out: Column | None = None
    for level, areas in levels.items():
        out = F.when(area.isin(*areas), level) if out is None else out.when(area.isin(*areas), level)
    return F.lit(OTHER_LEVEL) if out is None else out.otherwise(OTHER_LEVEL)


def area_top_products(clicks: DataFrame, cities: DataFrame, products: DataFrame, levels: Mapping[str, Sequence[str]] = AREA_LEVELS, n: int = TOP, task_id: int = 0) -> DataFrame:
    """The ``n`` most clicked known products of each area; ties by product."""
    counted = area_product_clicks(clicks, cities).join(products.select("product_id", "product_name", "extend_info"), "product_id")
    order = Window.partitionBy("area").orderBy(F.desc("click_count"), "product_id")
    top = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return top.select(
        F.lit(task_id).cast("long").alias("task_id"),
        "area",
        area_level(F.col("area"), levels).alias("area_level"),
        "product_id",
        "city_infos",
        "click_count",
        "product_name",
        json_field(F.col("extend_info"), "product_status").alias("product_status"),
    )
