"""Ad clicks as streams.

``AdClickJob`` is the whole job with its feedback loop: a batch is filtered by the blacklist that earlier
batches made, then counted, and its unfiltered clicks go into the counts that extend the blacklist.
The functions below it are single results as native stateful queries.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from visitlens.functions.scalars import date_key, format_date
from visitlens.operators import ads
from visitlens.schemas import KEYS, RESULTS
from visitlens.sources.tables import SlicedTable

#: Tables that aren't cut by day.
SLICES = {"ad_black_list": "pmod(xxhash64(user_id), 16)"}


@dataclass
class AdClickJob:
    """One query on the raw log, five result tables under ``path``."""

    spark: SparkSession
    path: str
    threshold: int = ads.BLACKLIST_CLICKS

    def table(self, name: str) -> SlicedTable:
        return SlicedTable(self.spark, f"{self.path}/{name}", RESULTS[name], KEYS[name], SLICES.get(name, "date"))

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Everything a micro-batch does; applying it again changes nothing."""
        batch = batch.persist()
        try:
            kept = ads.filtered_log(batch, self.table("ad_black_list").read()).persist()
            try:
                stat = self.table("ad_stat")
                new = ads.ad_stat(kept)
                stat.add(new, batch_id, "click_count")
                days = [r[0] for r in new.select("date").distinct().collect()]
                self.table("ad_province_top3").replace_groups(ads.province_top(stat.read(days)), batch_id)
                self.table("ad_click_trend").add(ads.click_trend(kept, None), batch_id, "click_count")
            finally:
                kept.unpersist()
            counts = self.table("ad_user_click_count")
            clicks = ads.user_click_count(batch)
            counts.add(clicks, batch_id, "click_count")
            days = [r[0] for r in clicks.select("date").distinct().collect()]
            self.table("ad_black_list").insert_missing(ads.black_list(counts.read(days), self.threshold), batch_id)
        finally:
            batch.unpersist()

    def start(self, log: DataFrame, checkpoint: str, available_now: bool = False, interval: str = "5 seconds") -> StreamingQuery:
        writer = log.writeStream.option("checkpointLocation", checkpoint).foreachBatch(self.apply)
        return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()


def user_click_counts(log: DataFrame, late: str = "1 day") -> DataFrame:
    """Running clicks by day, user and ad; state goes a day after the day has passed.  For update mode."""
    return (
        log.withWatermark("ts", late)
        .groupBy(F.window("ts", "1 day").alias("day"), "user_id", "ad_id")
        .agg(F.count("*").alias("click_count"))
        .select(format_date(F.col("day.start")).alias("date"), "user_id", "ad_id", "click_count")
    )


def ad_stats(log: DataFrame, blacklist: DataFrame, late: str = "1 day") -> DataFrame:
    """Running clicks by day, province, city and ad without the users of a static blacklist.  For update mode."""
    kept = log.withWatermark("ts", late).join(blacklist, "user_id", "left_anti")
    per = kept.groupBy(F.window("ts", "1 day").alias("day"), "province", "city", "ad_id").agg(F.count("*").alias("click_count"))
    return per.select(date_key(F.col("day.start")).alias("date"), "province", "city", "ad_id", "click_count")


def click_trends(log: DataFrame, keep: str = "60 minutes") -> DataFrame:
    """Clicks by minute and ad, each minute open for ``keep``.  For update mode."""
    per = log.withWatermark("ts", keep).groupBy(F.window("ts", "1 minute").alias("w"), "ad_id").agg(F.count("*").alias("click_count"))
    start = F.col("w.start")
    return per.select(format_date(start).alias("date"), F.date_format(start, "HH").alias("hour"), F.date_format(start, "mm").alias("minute"), "ad_id", "click_count")


def sliding_clicks(log: DataFrame, length: str = "60 minutes", slide: str = "10 seconds", late: str = "60 minutes") -> DataFrame:
    """Clicks by ad over sliding windows of event time.  For update mode."""
    return ads.click_sliding_window(log.withWatermark("ts", late), length, slide)
