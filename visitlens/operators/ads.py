"""Ad clicks as batch queries: user counts, blacklist, statistics, province ranking and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.scalars import date_key, format_date

BLACKLIST_CLICKS = 100
TOP = 3


def parse_log(lines: DataFrame, column: str = "value") -> DataFrame:
    """``epoch_ms province city user_id ad_id`` lines; those that can't be read are left out."""
    parts = F.split(F.col(column), " ")
    out = lines.where(F.size(parts) == 5).select(
        F.timestamp_millis(F.try_to_number(parts[0], F.lit("9999999999999999")).cast("long")).alias("ts"),
        parts[1].alias("province"),
        parts[2].alias("city"),
        parts[3].try_cast("long").alias("user_id"),
        parts[4].try_cast("long").alias("ad_id"),
    )
    return out.where("ts IS NOT NULL AND user_id IS NOT NULL AND ad_id IS NOT NULL")


def log_lines(log: DataFrame) -> DataFrame:
    """The text form of a log."""
    return log.select(F.concat_ws(" ", F.unix_millis("ts").cast("string"), "province", "city", F.col("user_id").cast("string"), F.col("ad_id").cast("string")).alias("value"))


def user_click_count(log: DataFrame) -> DataFrame:
    return log.groupBy(format_date(F.col("ts")).alias("date"), "user_id", "ad_id").agg(F.count("*").alias("click_count"))


def black_list(counts: DataFrame, threshold: int = BLACKLIST_CLICKS) -> DataFrame:
    """Users with ``threshold`` or more clicks on one ad in one day."""
    return counts.where(F.col("click_count") >= threshold).select("user_id").distinct()


def filtered_log(log: DataFrame, blacklist: DataFrame) -> DataFrame:
    return log.join(blacklist, "user_id", "left_anti")


def ad_stat(log: DataFrame) -> DataFrame:
    return log.groupBy(date_key(F.col("ts")).alias("date"), "province", "city", "ad_id").agg(F.count("*").alias("click_count"))


def province_count(stat: DataFrame) -> DataFrame:
    """Cities rolled up; the day becomes ``yyyy-MM-dd``."""
    day = F.concat_ws("-", F.substring("date", 1, 4), F.substring("date", 5, 2), F.substring("date", 7, 2))
    return stat.groupBy(day.alias("date"), "province", "ad_id").agg(F.sum("click_count").alias("click_count"))


def province_top(stat: DataFrame, n: int = TOP) -> DataFrame:
    order = Window.partitionBy("date", "province").orderBy(F.desc("click_count"), "ad_id")
    return province_count(stat).withColumn("place", F.row_number().over(order)).where(F.col("place") <= n).drop("place")


def _minute(ts: Column) -> list[Column]:
    return [format_date(ts).alias("date"), F.date_format(ts, "HH").alias("hour"), F.date_format(ts, "mm").alias("minute")]


def click_trend(log: DataFrame, minutes: int | None = 60) -> DataFrame:
    """Clicks by minute and ad over the last ``minutes`` up to the latest click (all, if None)."""
    if minutes is not None:
        last = F.broadcast(log.agg(F.max("ts").alias("last")))  # one row
        log = log.join(last, F.col("ts") > F.col("last") - F.expr(f"INTERVAL {int(minutes)} MINUTES"))
    return log.groupBy(*_minute(F.col("ts")), "ad_id").agg(F.count("*").alias("click_count"))


def click_sliding_window(log: DataFrame, length: str = "60 minutes", slide: str = "10 seconds") -> DataFrame:
    """Clicks by ad over every sliding window; a click counts in length / slide windows."""
    per = log.groupBy(F.window("ts", length, slide).alias("w"), "ad_id").agg(F.count("*").alias("click_count"))
    return per.select(F.date_format("w.start", "yyyy-MM-dd HH:mm:ss").alias("window_start"), "ad_id", "click_count")
