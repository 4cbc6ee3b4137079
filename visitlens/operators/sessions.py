"""Session analysis: aggregates, parameterised filter, histogram, stratified sample and detail rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.scalars import date_hour, format_time, or_zero, ratio2, seconds_between
from visitlens.params import TaskParams

#: (name, least, most) in seconds and in steps.  Neighbours share their bounds; 0 s is in no bucket.
LENGTH_BUCKETS = [
    ("1s_3s", 1, 3), ("4s_6s", 4, 6), ("7s_9s", 7, 9), ("10s_30s", 10, 30), ("30s_60s", 30, 60),
    ("1m_3m", 60, 180), ("3m_10m", 180, 600), ("10m_30m", 600, 1800), ("30m", 1800, None),
]
STEP_BUCKETS = [("1_3", 1, 3), ("4_6", 4, 6), ("7_9", 7, 9), ("10_30", 10, 30), ("30_60", 30, 60), ("60", 60, None)]
SAMPLE_SIZE = 100


def actions_between(actions: DataFrame, params: TaskParams) -> DataFrame:
    """Half-open range of dates; a missing bound sets no condition.  It reaches the scan where ``date`` is a stored column."""
    out = actions
    if params.start_date:
        out = out.where(F.col("date") >= params.start_date)
    if params.end_date:
        out = out.where(F.col("date") < params.end_date)
    return out


def session_partials(actions: DataFrame) -> DataFrame:
    """One row a session; partial aggregates are combined before the one shuffle."""
    return actions.groupBy("session_id").agg(
        F.min("user_id").alias("user_id"),
        F.array_sort(F.collect_set(F.when(F.col("search_keyword") != "", F.col("search_keyword")))).alias("search_keywords"),
        F.array_sort(F.collect_set("click_category_id")).alias("click_category_ids"),
        F.min("action_time").alias("start_time"),
        seconds_between(F.max("action_time"), F.min("action_time")).alias("visit_length"),
        F.count("*").alias("step_length"),
    )


def session_full_info(actions: DataFrame, users: DataFrame) -> DataFrame:
    """Sessions with their user's data; those of unknown users disappear."""
    return session_partials(actions).join(users.select("user_id", "age", "professional", "city", "gender"), "user_id")


def session_condition(params: TaskParams) -> Column:
    """All conditions that are set; a condition on missing data is not met."""
    conditions = [F.lit(True)]
    if params.start_age is not None and params.end_age is not None:
        conditions.append(F.col("age").between(params.start_age, params.end_age))
    if params.professionals:
        conditions.append(F.col("professional").isin(list(params.professionals)))
    if params.cities:
        conditions.append(F.col("city").isin(list(params.cities)))
    if params.gender:
        conditions.append(F.col("gender") == params.gender)
    if params.keywords:
        conditions.append(F.arrays_overlap("search_keywords", F.array(*[F.lit(x) for x in params.keywords])))
    if params.category_ids:
        conditions.append(F.arrays_overlap("click_category_ids", F.array(*[F.lit(x).cast("long") for x in params.category_ids])))
    return F.coalesce(reduce(lambda a, b: a & b, conditions), F.lit(False))


def filter_sessions(sessions: DataFrame, params: TaskParams) -> DataFrame:
    return sessions.where(session_condition(params))


def _in_bucket(c: Column, least: int, most: int | None) -> Column:
    return (c >= least) if most is None else c.between(least, most)


def session_aggr_stat(sessions: DataFrame, task_id: int = 0) -> DataFrame:
    """Count and share of every bucket, in one pass; shares are null without sessions."""
    buckets = [(n, F.col("visit_length"), a, b) for n, a, b in LENGTH_BUCKETS] + [(n, F.col("step_length"), a, b) for n, a, b in STEP_BUCKETS]
    counts = sessions.agg(F.count("*").alias("session_count"), *[F.count(F.when(_in_bucket(c, a, b), 1)).alias(n) for n, c, a, b in buckets])
    return counts.select(F.lit(task_id).cast("long").alias("task_id"), "session_count", *[ratio2(F.col(n), F.col("session_count")).alias(n) for n, *_ in buckets])


def session_hour_count(sessions: DataFrame) -> DataFrame:
    return sessions.groupBy(date_hour(F.col("start_time")).alias("date_hour")).agg(F.count("*").alias("session_count"))


def session_random_extract(sessions: DataFrame, total: int = SAMPLE_SIZE, seed: str = "visitlens", task_id: int = 0) -> DataFrame:
    """A sample spread evenly over days and, within a day, in proportion over hours.

    Quotas are whole parts, so fewer than ``total`` may come.  The order within an hour is a seeded hash:
    the same sessions are drawn again.  Quotas are computed on the counts, one row an hour.
    """
    keyed = sessions.withColumn("date_hour", date_hour(F.col("start_time"))).withColumn("day", F.substring("date_hour", 1, 10))
    hours = keyed.groupBy("day", "date_hour").agg(F.count("*").alias("n"))
    days = hours.groupBy("day").agg(F.sum("n").alias("day_n"))
    per_day = days.agg(F.floor(F.lit(total) / F.count("*")).alias("per_day"))
    quotas = hours.join(days, "day").join(F.broadcast(per_day)).select("date_hour", F.expr("least(n, (n * per_day) div day_n)").alias("quota")).where("quota > 0")
    order = Window.partitionBy("date_hour").orderBy(F.md5(F.concat(F.lit(seed), "session_id")), "session_id")
    # the rank comes first: it can be limited by a bound on the quota before rows are moved
    drawn = keyed.withColumn("place", F.row_number().over(order)).where(F.col("place") <= total).join(quotas, "date_hour").where(F.col("place") <= F.col("quota"))
    return drawn.select(
        F.lit(task_id).cast("long").alias("task_id"),
        "session_id",
        format_time(F.col("start_time")).alias("start_time"),
        F.array_join("search_keywords", ",").alias("search_keywords"),
        F.array_join(F.transform("click_category_ids", lambda x: x.cast("string")), ",").alias("click_category_ids"),
    )


def detail_columns(task_id: int) -> list[Column]:
    return [
        F.lit(task_id).cast("long").alias("task_id"),
        F.col("user_id"),
        F.col("session_id"),
        F.col("page_id"),
        format_time(F.col("action_time")).alias("action_time"),
        F.col("search_keyword"),
        or_zero(F.col("click_category_id")).alias("click_category_id"),
        or_zero(F.col("click_product_id")).alias("click_product_id"),
        *[F.col(c) for c in ("order_category_ids", "order_product_ids", "pay_category_ids", "pay_product_ids")],
    ]


def actions_of(actions: DataFrame, sessions: DataFrame) -> DataFrame:
    """The actions of the given sessions, each once."""
    return actions.join(sessions.select("session_id"), "session_id", "left_semi")


def session_detail(actions: DataFrame, sessions: DataFrame, task_id: int = 0) -> DataFrame:
    """Detail rows of sampled or filtered sessions; missing click ids read 0."""
    return actions_of(actions, sessions).select(*detail_columns(task_id))


def session_detail_repeated(actions: DataFrame, top_sessions: DataFrame, task_id: int = 0) -> DataFrame:
    """Detail rows for every row of ``top_sessions``: a session listed k times gives its actions k times."""
    return actions.join(top_sessions.select("session_id"), "session_id").select(*detail_columns(task_id))
