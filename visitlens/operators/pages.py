"""Page flow: how often one page of a target flow leads to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.scalars import ratio2


def target_pairs(spark, flow: Sequence[int]) -> DataFrame:
    """(idx, page_split) of consecutive pages, from 1; a pair that the flow repeats has a row for each place."""
    return spark.createDataFrame([(i, f"{a}_{b}") for i, (a, b) in enumerate(zip(flow, flow[1:], strict=False), 1)], "idx int, page_split string")


def page_moves(actions: DataFrame) -> DataFrame:
    """(page_id, page_split): every action's page, and its move from the session's page before, by time then event."""
    tie = [c for c in ("event_id",) if c in actions.columns]
    order = Window.partitionBy("session_id").orderBy("action_time", *tie, "page_id")
    before = F.lag("page_id").over(order)
    return actions.select("page_id", F.when(before.isNotNull(), F.concat_ws("_", before.cast("string"), F.col("page_id").cast("string"))).alias("page_split"))


def page_split_pv(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """Page views of the pairs in the flow; pairs that never occur have no row."""
    wanted = sorted({f"{a}_{b}" for a, b in zip(flow, flow[1:], strict=False)})
    return page_moves(actions).where(F.col("page_split").isin(wanted)).groupBy("page_split").agg(F.count("*").alias("pv"))


def start_page_pv(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    return actions.agg(F.count(F.when(F.col("page_id") == (flow[0] if flow else None), 1)).alias("start_pv"))


def page_convert_rate(actions: DataFrame, flow: Sequence[int]) -> DataFrame:
    """(idx, page_split, pv, convert_rate): pv over that of the pair before, the first over the start page's.

    A pair without views has rate 0; a rate over nothing is null.
    """
    targets = target_pairs(actions.sparkSession, flow)
    wanted = sorted({f"{a}_{b}" for a, b in zip(flow, flow[1:], strict=False)})
    start = F.count(F.when(F.col("page_id") == (flow[0] if flow else None), 1)).alias("start_pv")
    # one scan for both: a row for each pair of the flow, and one for all other moves
    counts = page_moves(actions).groupBy(F.when(F.col("page_split").isin(wanted), F.col("page_split")).alias("page_split")).agg(F.count("*").alias("pv"), start)
    listed = F.collect_list(F.when(F.col("page_split").isNotNull(), F.struct("page_split", "pv")))
    one = F.broadcast(counts.agg(F.map_from_entries(listed).alias("pvs"), F.coalesce(F.sum("start_pv"), F.lit(0).cast("long")).alias("start_pv")))  # one row
    pv = targets.crossJoin(one).withColumn("pv", F.coalesce(F.try_element_at("pvs", "page_split"), F.lit(0).cast("long")))
    before = F.coalesce(F.lag("pv").over(Window.orderBy("idx")), F.col("start_pv"))
    return pv.select("idx", "page_split", "pv", ratio2(F.col("pv"), before).alias("convert_rate"))


def page_convert_rate_string(actions: DataFrame, flow: Sequence[int], task_id: int = 0) -> DataFrame:
    """The rates as one string in the order of the flow."""
    pair = F.concat("page_split", F.lit("="), F.coalesce(F.col("convert_rate").cast("string"), F.lit("null")))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", pair.alias("pair")))), lambda x: x["pair"]), "|")
    return page_convert_rate(actions, flow).agg(joined.alias("convert_rate")).select(F.lit(task_id).cast("long").alias("task_id"), "convert_rate")
