"""Schemas of inputs and result tables; columns are always accessed by name."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {"string": T.StringType(), "long": T.LongType(), "int": T.IntegerType(), "double": T.DoubleType(), "timestamp": T.TimestampType()}


def _schema(text: str) -> T.StructType:
    """Nullable columns from ``name type, name type``; needs no session."""
    return T.StructType([T.StructField(name.strip("`"), _TYPES[kind]) for name, kind in (part.split() for part in text.split(","))])


USER_VISIT_ACTION = _schema(
    "date string, user_id long, session_id string, page_id long, action_time timestamp, search_keyword string, "
    "click_category_id long, click_product_id long, order_category_ids string, order_product_ids string, "
    "pay_category_ids string, pay_product_ids string, city_id long"
)
USER_INFO = _schema("user_id long, username string, name string, age int, professional string, city string, gender string")
PRODUCT_INFO = _schema("product_id long, product_name string, extend_info string")
CITY_INFO = _schema("city_id int, city_name string, area string")
TASK = _schema(
    "task_id long, task_name string, create_time string, start_time string, finish_time string, task_type string, task_status string, task_param string"
)
AD_LOG = _schema("ts timestamp, province string, city string, user_id long, ad_id long")

RESULTS = {
    "session_aggr_stat": _schema(
        "task_id long, session_count long, `1s_3s` double, `4s_6s` double, `7s_9s` double, `10s_30s` double, `30s_60s` double, "
        "`1m_3m` double, `3m_10m` double, `10m_30m` double, `30m` double, `1_3` double, `4_6` double, `7_9` double, `10_30` double, `30_60` double, `60` double"
    ),
    "session_random_extract": _schema("task_id long, session_id string, start_time string, search_keywords string, click_category_ids string"),
    "session_detail": _schema(
        "task_id long, user_id long, session_id string, page_id long, action_time string, search_keyword string, click_category_id long, "
        "click_product_id long, order_category_ids string, order_product_ids string, pay_category_ids string, pay_product_ids string"
    ),
    "top10_category": _schema("task_id long, category_id long, click_count long, order_count long, pay_count long"),
    "top10_session": _schema("task_id long, category_id long, session_id string, click_count long"),
    "page_split_convert_rate": _schema("task_id long, convert_rate string"),
    "area_top3_product": _schema(
        "task_id long, area string, area_level string, product_id long, city_infos string, click_count long, product_name string, product_status string"
    ),
    "ad_user_click_count": _schema("date string, user_id long, ad_id long, click_count long"),
    "ad_black_list": _schema("user_id long"),
    "ad_stat": _schema("date string, province string, city string, ad_id long, click_count long"),
    "ad_province_top3": _schema("date string, province string, ad_id long, click_count long"),
    "ad_click_trend": _schema("date string, hour string, minute string, ad_id long, click_count long"),
}
#: Columns that identify a row of a result table when it is updated.
KEYS = {
    "session_aggr_stat": ["task_id"],
    "ad_user_click_count": ["date", "user_id", "ad_id"],
    "ad_black_list": ["user_id"],
    "ad_stat": ["date", "province", "city", "ad_id"],
    "ad_province_top3": ["date", "province"],
    "ad_click_trend": ["date", "hour", "minute", "ad_id"],
}
