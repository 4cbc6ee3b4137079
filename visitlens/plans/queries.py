"""Registered queries over the star-schema tables, each with the same result as DuckDB SQL."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens import jobs
from visitlens.functions import scalars as S
from visitlens.operators import ads, categories, pages, products, sessions
from visitlens.params import TaskParams
from visitlens.schemas import TASK
from visitlens.session import pin
from visitlens.sources.logs import file_log
from visitlens.sources.testdata import SQL_VIEWS, Views
from visitlens.streaming.ads import AdClickJob

#: Parameters of the registered queries.
PARAMS = TaskParams(
    task_id=1,
    start_date="2024-01-03",
    end_date="2024-01-28",
    start_age=20,
    end_age=60,
    gender="male",
    category_ids=(1, 2, 3, 5, 7, 11, 13, 17),
    target_page_flow=(1, 2, 3, 4, 5, 6, 7, 8, 9),
)
SAMPLE = 1000
#: The test log has few clicks by one user on one ad in a day.
CLICKS = 2

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    """Adds a query under its function's name; the SQL goes behind the views."""

    def add(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Views(pin(spark), folder))

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = SQL_VIEWS + sql
        return f

    return add


def _actions(v: Views) -> DataFrame:
    return sessions.actions_between(v.actions_on(PARAMS.start_date, PARAMS.end_date), PARAMS)


def _sessions(v: Views) -> DataFrame:
    return sessions.session_full_info(_actions(v), v.user_info)


def _passing(v: Views) -> DataFrame:
    return sessions.filter_sessions(_sessions(v), PARAMS)


def _detail(v: Views) -> DataFrame:
    return sessions.actions_of(_actions(v), _passing(v))


_A = f", acts AS (SELECT * FROM user_visit_action WHERE date >= '{PARAMS.start_date}' AND date < '{PARAMS.end_date}')"
_S = (
    _A
    + """, part AS (
  SELECT session_id, min(user_id) AS user_id, coalesce(list_sort(list(DISTINCT search_keyword) FILTER (WHERE search_keyword IS NOT NULL)), []) AS kws,
    coalesce(list_sort(list(DISTINCT click_category_id) FILTER (WHERE click_category_id IS NOT NULL)), []) AS cats,
    min(action_time) AS start_time, CAST(epoch(max(action_time)) - epoch(min(action_time)) AS BIGINT) AS visit_length, count(*) AS step_length
  FROM acts GROUP BY session_id
), sess AS (SELECT part.*, age, professional, city, gender FROM part JOIN user_info USING (user_id))"""
)
_P = _S + f", passing AS (SELECT * FROM sess WHERE age BETWEEN {PARAMS.start_age} AND {PARAMS.end_age} AND gender = '{PARAMS.gender}' AND list_has_any(cats, [{', '.join(map(str, PARAMS.category_ids))}]))"
_D = _P + ", det AS (SELECT * FROM acts WHERE session_id IN (SELECT session_id FROM passing))"
_OUT = """1 AS task_id, user_id, session_id, page_id, strftime(action_time, '%Y-%m-%d %H:%M:%S') AS action_time, search_keyword,
  coalesce(click_category_id, 0) AS click_category_id, coalesce(click_product_id, 0) AS click_product_id, order_category_ids, order_product_ids, pay_category_ids, pay_product_ids"""


def _ratio(part: str, whole: str) -> str:
    return f"CASE WHEN ({whole}) > 0 THEN ((200 * ({part}) + ({whole})) // (2 * ({whole}))) / 100.0 END"


# ---- area ranking

_AREA = """, clicks AS (SELECT city_id, click_product_id AS product_id FROM user_visit_action WHERE click_product_id IS NOT NULL AND action_time BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-29 12:00:00'
), apc AS (
  SELECT area, product_id, count(*) AS click_count, string_agg(DISTINCT city_id || ':' || city_name, ',' ORDER BY city_id || ':' || city_name) AS city_infos
  FROM clicks JOIN city_info USING (city_id) GROUP BY area, product_id
)"""


def _clicks(v: Views) -> DataFrame:
    between = "2024-01-02 00:00:00", "2024-01-29 12:00:00"
    return products.click_actions(v.clicks_in(*between), *between)


@register(
    _AREA
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS place FROM apc JOIN product_info USING (product_id))
SELECT 1 AS task_id, area, CASE WHEN area IN ('AMERICA', 'EUROPE') THEN 'A级' WHEN area IN ('ASIA') THEN 'B级' WHEN area IN ('MIDDLE EAST', 'AFRICA') THEN 'C级' ELSE 'D级' END AS area_level,
  product_id, city_infos, click_count, product_name, json_extract_string(extend_info, '$.product_status') AS product_status FROM r WHERE place <= 3"""
)
def area_top3_product(v: Views) -> DataFrame:
    return products.area_top_products(_clicks(v), v.city_info, v.product_info, products.REGION_LEVELS, task_id=1)


@register(_AREA + " SELECT area, product_id, click_count, city_infos FROM apc")
def area_product_click_count(v: Views) -> DataFrame:
    return products.area_product_clicks(_clicks(v), v.city_info)


@register(_AREA + " SELECT city_id, city_name, area, product_id FROM clicks JOIN city_info USING (city_id)")
def click_action_city_join(v: Views) -> DataFrame:
    return products.click_city(_clicks(v), v.city_info)


# ---- sessions


@register(_S + " SELECT session_id, user_id, array_to_string(kws, ',') AS search_keywords, array_to_string(cats, ',') AS click_category_ids, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, visit_length, step_length, age, professional, city, gender FROM sess")
def session_full_info(v: Views) -> DataFrame:
    return _printed(_sessions(v))


@register(_P + " SELECT session_id, user_id, array_to_string(kws, ',') AS search_keywords, array_to_string(cats, ',') AS click_category_ids, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, visit_length, step_length, age, professional, city, gender FROM passing")
def session_filter(v: Views) -> DataFrame:
    return _printed(_passing(v))


def _printed(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "search_keywords": F.array_join("search_keywords", ","),
            "click_category_ids": F.array_join(F.transform("click_category_ids", lambda x: x.cast("string")), ","),
            "start_time": S.format_time(F.col("start_time")),
        }
    )


def _histogram_sql(source: str) -> str:
    def count(column: str, a: int, b: int | None) -> str:
        return f"count(*) FILTER (WHERE {column} >= {a}" + (f" AND {column} <= {b})" if b is not None else ")")

    named = [(n, count("visit_length", a, b)) for n, a, b in sessions.LENGTH_BUCKETS] + [(n, count("step_length", a, b)) for n, a, b in sessions.STEP_BUCKETS]
    return "SELECT 1 AS task_id, count(*) AS session_count, " + ", ".join(f'{_ratio(c, "count(*)")} AS "{n}"' for n, c in named) + f" FROM {source}"


@register(_P + " " + _histogram_sql("passing"))
def session_aggr_stat(v: Views) -> DataFrame:
    return sessions.session_aggr_stat(_passing(v), 1)


@register(_S + " " + _histogram_sql("sess"))
def session_aggr_stat_all(v: Views) -> DataFrame:
    return sessions.session_aggr_stat(_sessions(v), 1)


@register(_D + f" SELECT {_OUT} FROM det")
def session_detail_filtered(v: Views) -> DataFrame:
    return sessions.session_detail(_actions(v), _passing(v), 1)


@register(_P + " SELECT strftime(start_time, '%Y-%m-%d_%H') AS date_hour, count(*) AS session_count FROM passing GROUP BY 1")
def session_hour_count(v: Views) -> DataFrame:
    return sessions.session_hour_count(_passing(v))


_SAMPLE = (
    _S
    + f""", keyed AS (SELECT *, strftime(start_time, '%Y-%m-%d_%H') AS dh, strftime(start_time, '%Y-%m-%d') AS day FROM sess
), hours AS (SELECT day, dh, count(*) AS n FROM keyed GROUP BY day, dh
), quotas AS (SELECT dh, least(n, (n * ({SAMPLE} // (SELECT count(DISTINCT day) FROM hours))) // sum(n) OVER (PARTITION BY day)) AS quota FROM hours
), drawn AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY dh ORDER BY md5('visitlens' || session_id), session_id) AS place FROM keyed) JOIN quotas USING (dh) WHERE place <= quota
)"""
)


@register(_SAMPLE + " SELECT 1 AS task_id, session_id, strftime(start_time, '%Y-%m-%d %H:%M:%S') AS start_time, array_to_string(kws, ',') AS search_keywords, array_to_string(cats, ',') AS click_category_ids FROM drawn")
def session_random_extract(v: Views) -> DataFrame:
    return sessions.session_random_extract(_sessions(v), SAMPLE, task_id=1)


@register(_SAMPLE + f" SELECT {_OUT} FROM acts WHERE session_id IN (SELECT session_id FROM drawn)")
def session_random_detail(v: Views) -> DataFrame:
    drawn = sessions.session_random_extract(v.shared.save(_sessions(v), "sessions"), SAMPLE)
    return sessions.session_detail(_actions(v), drawn, 1)


_WHO = PARAMS.but(professionals=("BUILDING", "MACHINERY"), cities=tuple(f"NATION_{i}" for i in range(0, 25, 2)), keywords=("kw1", "kw4"), gender=None, category_ids=None)


@register(
    _S
    + f""" SELECT session_id, professional, city, array_to_string(kws, ',') AS search_keywords FROM sess WHERE age BETWEEN {PARAMS.start_age} AND {PARAMS.end_age}
  AND professional IN {_WHO.professionals} AND city IN {_WHO.cities} AND list_has_any(kws, {list(_WHO.keywords)})"""
)
def session_filter_who(v: Views) -> DataFrame:
    """By profession, city and search word."""
    return _printed(sessions.filter_sessions(_sessions(v), _WHO)).select("session_id", "professional", "city", "search_keywords")


# ---- categories

_CATS = (
    _D
    + """, cat_events AS (
  SELECT 'click' AS kind, click_category_id AS category_id FROM det WHERE click_category_id IS NOT NULL
  UNION ALL SELECT 'order', CAST(c AS BIGINT) FROM (SELECT unnest(string_split(order_category_ids, ',')) AS c FROM det WHERE order_category_ids IS NOT NULL) WHERE c <> ''
  UNION ALL SELECT 'pay', CAST(c AS BIGINT) FROM (SELECT unnest(string_split(pay_category_ids, ',')) AS c FROM det WHERE pay_category_ids IS NOT NULL) WHERE c <> ''
), cat_counts AS (
  SELECT category_id, count(*) FILTER (WHERE kind = 'click') AS click_count, count(*) FILTER (WHERE kind = 'order') AS order_count, count(*) FILTER (WHERE kind = 'pay') AS pay_count
  FROM cat_events GROUP BY category_id
), top_cats AS (SELECT * FROM cat_counts ORDER BY click_count DESC, order_count DESC, pay_count DESC, category_id LIMIT 10
), cat_sess AS (SELECT click_category_id AS category_id, session_id, count(*) AS click_count FROM det WHERE click_category_id IS NOT NULL GROUP BY 1, 2
), top_sess AS (
  SELECT category_id, session_id, click_count FROM (
    SELECT cat_sess.*, row_number() OVER (PARTITION BY category_id ORDER BY click_count DESC, session_id) AS place FROM cat_sess WHERE category_id IN (SELECT category_id FROM top_cats)
  ) WHERE place <= 10
)"""
)


@register(_CATS + " SELECT category_id, click_count, order_count, pay_count FROM cat_counts")
def category_counts(v: Views) -> DataFrame:
    return categories.category_counts(_detail(v))


@register(_CATS + " SELECT DISTINCT category_id FROM cat_events")
def category_distinct(v: Views) -> DataFrame:
    return categories.category_distinct(_detail(v))


@register(_CATS + " SELECT 1 AS task_id, category_id, click_count, order_count, pay_count FROM top_cats")
def top10_category(v: Views) -> DataFrame:
    return categories.top_categories(_detail(v), task_id=1)


@register(_CATS + " SELECT category_id, session_id, click_count FROM cat_sess")
def category_session_count(v: Views) -> DataFrame:
    return categories.category_session_count(_detail(v))


def _top_sessions(detail: DataFrame) -> DataFrame:
    return categories.top_sessions(detail, categories.top_categories(detail), task_id=1)


@register(_CATS + " SELECT 1 AS task_id, category_id, session_id, click_count FROM top_sess")
def top10_session(v: Views) -> DataFrame:
    return _top_sessions(v.shared.save(_detail(v), "detail"))


@register(_CATS + f" SELECT {_OUT} FROM det JOIN (SELECT session_id FROM top_sess) t USING (session_id)")
def top10_session_detail(v: Views) -> DataFrame:
    detail = v.shared.save(_detail(v), "detail")
    return sessions.session_detail_repeated(detail, _top_sessions(detail), 1)


# ---- page flow

_FLOW = PARAMS.target_page_flow
_PAGES = (
    _A
    + """, moves AS (
  SELECT page_id, lag(page_id) OVER (PARTITION BY session_id ORDER BY action_time, event_id) || '_' || page_id AS page_split FROM acts
), targets(idx, page_split) AS (VALUES """
    + ", ".join(f"({i}, '{a}_{b}')" for i, (a, b) in enumerate(zip(_FLOW, _FLOW[1:], strict=False), 1))
    + f"""), start_pv AS (SELECT count(*) AS start_pv FROM acts WHERE page_id = {_FLOW[0]}
), pvs AS (SELECT idx, t.page_split, count(m.page_split) AS pv FROM targets t LEFT JOIN moves m ON t.page_split = m.page_split GROUP BY 1, 2
), rates AS (SELECT idx, page_split, pv, coalesce(lag(pv) OVER (ORDER BY idx), (SELECT start_pv FROM start_pv)) AS prev FROM pvs
), final AS (SELECT idx, page_split, pv, {_ratio("pv", "prev")} AS convert_rate FROM rates)"""
)


@register(_PAGES + " SELECT page_split, pv FROM pvs WHERE pv > 0")
def page_split_pv(v: Views) -> DataFrame:
    return pages.page_split_pv(_actions(v), _FLOW)


@register(_PAGES + " SELECT start_pv FROM start_pv")
def start_page_pv(v: Views) -> DataFrame:
    return pages.start_page_pv(_actions(v), _FLOW)


@register(_PAGES + " SELECT idx, page_split, pv, convert_rate FROM final")
def page_convert_rate(v: Views) -> DataFrame:
    return pages.page_convert_rate(_actions(v), _FLOW)


@register(_PAGES + " SELECT 1 AS task_id, string_agg(page_split || '=' || coalesce(CAST(CAST(convert_rate AS DOUBLE) AS VARCHAR), 'null'), '|' ORDER BY idx) AS convert_rate FROM final")
def page_convert_rate_string(v: Views) -> DataFrame:
    return pages.page_convert_rate_string(_actions(v), _FLOW, 1)


# ---- ads

_ADS = f""", ucc AS (SELECT strftime(ts, '%Y-%m-%d') AS date, user_id, ad_id, count(*) AS click_count FROM ad_log GROUP BY 1, 2, 3
), bl AS (SELECT DISTINCT user_id FROM ucc WHERE click_count >= {CLICKS}
), fl AS (SELECT * FROM ad_log WHERE user_id NOT IN (SELECT user_id FROM bl)
), st AS (SELECT strftime(ts, '%Y%m%d') AS date, province, city, ad_id, count(*) AS click_count FROM fl GROUP BY 1, 2, 3, 4
), pc AS (SELECT substr(date, 1, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) AS date, province, ad_id, CAST(sum(click_count) AS BIGINT) AS click_count FROM st GROUP BY 1, 2, 3)"""


def _filtered(v: Views) -> DataFrame:
    return ads.filtered_log(v.ad_log, ads.black_list(ads.user_click_count(v.ad_log), CLICKS))


@register(_ADS + " SELECT date, user_id, ad_id, click_count FROM ucc")
def ad_user_click_count(v: Views) -> DataFrame:
    return ads.user_click_count(v.ad_log)


@register(_ADS + " SELECT user_id FROM bl")
def ad_black_list(v: Views) -> DataFrame:
    return ads.black_list(ads.user_click_count(v.ad_log), CLICKS)


@register(_ADS + " SELECT CAST(epoch_us(ts) // 1000 AS VARCHAR) || ' ' || province || ' ' || city || ' ' || user_id || ' ' || ad_id AS value FROM fl")
def ad_filtered_log(v: Views) -> DataFrame:
    return ads.log_lines(_filtered(v))


@register(_ADS + " SELECT epoch_us(ts) // 1000 AS epoch_ms, province, city, user_id, ad_id FROM ad_log")
def ad_log_parsed(v: Views) -> DataFrame:
    parsed = ads.parse_log(ads.log_lines(v.ad_log))
    return parsed.select(F.unix_millis("ts").alias("epoch_ms"), "province", "city", "user_id", "ad_id")


@register(_ADS + " SELECT date, province, city, ad_id, click_count FROM st")
def ad_stat(v: Views) -> DataFrame:
    return ads.ad_stat(_filtered(v))


@register(_ADS + " SELECT date, province, ad_id, click_count FROM pc")
def ad_province_count(v: Views) -> DataFrame:
    return ads.province_count(ads.ad_stat(_filtered(v)))


@register(_ADS + " SELECT date, province, ad_id, click_count FROM (SELECT *, row_number() OVER (PARTITION BY date, province ORDER BY click_count DESC, ad_id) AS place FROM pc) WHERE place <= 3")
def ad_province_top3(v: Views) -> DataFrame:
    return ads.province_top(ads.ad_stat(_filtered(v)))


_TREND = "SELECT strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%H') AS hour, strftime(ts, '%M') AS minute, ad_id, count(*) AS click_count FROM fl"


@register(_ADS + " " + _TREND + " WHERE ts > (SELECT max(ts) FROM fl) - INTERVAL 60 MINUTE GROUP BY 1, 2, 3, 4")
def ad_click_trend(v: Views) -> DataFrame:
    return ads.click_trend(v.shared.save(_filtered(v), "filtered"))


@register(_ADS + " " + _TREND + " GROUP BY 1, 2, 3, 4")
def ad_click_trend_all(v: Views) -> DataFrame:
    return ads.click_trend(_filtered(v), None)


@register(
    _ADS
    + """ SELECT strftime(time_bucket(INTERVAL 20 MINUTE, ts) - to_minutes(CAST(20 * i AS BIGINT)), '%Y-%m-%d %H:%M:%S') AS window_start, ad_id, count(*) AS click_count
FROM fl, (VALUES (0), (1), (2)) t(i) GROUP BY 1, 2"""
)
def ad_click_sliding_window(v: Views) -> DataFrame:
    return ads.click_sliding_window(_filtered(v), "60 minutes", "20 minutes")


# ---- scalar functions, each over a whole table


@register("SELECT event_id, strftime(ts, '%Y-%m-%d_%H') AS date_hour, strftime(ts, '%Y-%m-%d') AS date, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, strftime(ts, '%Y%m%d') AS date_key, strftime(ts, '%Y%m%d%H%M') AS minute_key FROM ev")
def fn_format_dates(v: Views) -> DataFrame:
    ts = F.col("ts")
    return v.events.select(
        "event_id", S.date_hour(ts).alias("date_hour"), S.format_date(ts).alias("date"), S.format_time(ts).alias("time"), S.date_key(ts).alias("date_key"), S.minute_key(ts).alias("minute_key")
    )


@register("SELECT event_id, CAST(epoch(date_trunc('second', ts)) AS BIGINT) AS seconds, strftime(ts, '%Y-%m-%d') AS day FROM ev")
def fn_parse_dates(v: Views) -> DataFrame:
    time = F.date_format("ts", "yyyy-MM-dd H:mm:ss")
    return v.events.select("event_id", F.unix_timestamp(S.parse_time(time)).alias("seconds"), S.format_date(S.parse_date_key(S.date_key(F.col("ts")))).alias("day"))


@register("SELECT event_id, ts < TIMESTAMP '2024-01-15 12:00:00' AS before, ts > TIMESTAMP '2024-01-15 12:00:00' AS after, CAST(epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(date_trunc('second', ts)) AS BIGINT) AS seconds FROM ev")
def fn_compare_times(v: Views) -> DataFrame:
    ts, noon, end = F.col("ts").cast("timestamp"), F.lit("2024-01-15 12:00:00").cast("timestamp"), F.lit("2024-02-01 00:00:00").cast("timestamp")
    return v.events.select("event_id", S.before(ts, noon).alias("before"), S.after(ts, noon).alias("after"), S.seconds_between(end, ts).alias("seconds"))


@register("SELECT event_id, regexp_replace(',' || k || ',,' || user_id || ',', '^,|,$', '', 'g') AS trimmed, CASE WHEN length(CAST(k AS VARCHAR)) >= 2 THEN CAST(k AS VARCHAR) ELSE lpad(CAST(k AS VARCHAR), 2, '0') END AS padded, k % 3 = 0 AS empty FROM ev")
def fn_strings(v: Views) -> DataFrame:
    k = F.col("k").cast("string")
    listed = F.concat(F.lit(","), k, F.lit(",,"), F.col("user_id").cast("string"), F.lit(","))
    text = F.when(F.col("k") % 3 != 0, k).otherwise(F.when(F.col("k") % 2 == 0, "").otherwise(F.lit(None)))
    return v.events.select("event_id", S.trim_comma(listed).alias("trimmed"), S.pad_two(k).alias("padded"), S.is_empty(text).alias("empty"))


@register("SELECT event_id, event_type AS kind, CAST(k AS VARCHAR) AS k_text, 'user=' || user_id || '|kind=x|k=' || k AS changed FROM ev")
def fn_fields(v: Views) -> DataFrame:
    record = F.concat(F.lit("user="), F.col("user_id").cast("string"), F.lit("|kind="), F.col("event_type"), F.lit("|k="), F.col("k").cast("string"))
    return v.events.select("event_id", S.field_of(record, "kind").alias("kind"), S.field_of(record, "k").alias("k_text"), S.with_field(record, "kind", F.lit("x")).alias("changed"))


@register("SELECT event_id, " + _ratio("k", "user_id % 7") + " AS rate FROM ev")
def fn_ratio(v: Views) -> DataFrame:
    return v.events.select("event_id", S.ratio2(F.col("k"), F.col("user_id") % 7).alias("rate"))


@register("SELECT product_id, json_extract_string(extend_info, '$.product_status') AS status, product_id || ':' || product_name AS label FROM product_info")
def fn_json_concat(v: Views) -> DataFrame:
    p = v.product_info
    return p.select("product_id", S.json_field(F.col("extend_info"), "product_status").alias("status"), S.concat2(F.col("product_id"), F.col("product_name"), ":").alias("label"))


@register("SELECT area, string_agg(DISTINCT city_name, ',' ORDER BY city_name) AS cities FROM city_info GROUP BY area")
def fn_group_concat_distinct(v: Views) -> DataFrame:
    return v.city_info.groupBy("area").agg(S.group_concat_distinct(F.col("city_name")).alias("cities"))


@register("SELECT product_id, product_id || '-' || product_name AS a, json_extract_string(extend_info, '$.product_status') AS b FROM product_info")
def fn_sql_surface(v: Views) -> DataFrame:
    S.register_sql_functions(v.spark)
    return v.product_info.selectExpr("product_id", "concat2(CAST(product_id AS STRING), product_name, '-') AS a", "get_json_obj(extend_info, 'product_status') AS b")


@register("SELECT area, string_agg(DISTINCT city_id || ':' || city_name, ',' ORDER BY city_id || ':' || city_name) AS cities FROM city_info GROUP BY area")
def fn_sql_group_concat(v: Views) -> DataFrame:
    S.register_sql_functions(v.spark)
    v.create_views()
    return v.spark.sql("SELECT area, group_concat_distinct(concat2(CAST(city_id AS STRING), city_name, ':')) AS cities FROM city_info GROUP BY area")


@register("SELECT event_id, round(k / 8.0, 2) AS two, round(k / 8.0, 1) AS one FROM ev")
def fn_round_to(v: Views) -> DataFrame:
    eighth = F.col("k") / F.lit(8)
    return v.events.select("event_id", S.round_to(eighth, 2).alias("two"), S.round_to(eighth, 1).alias("one"))


# ---- jobs: a task is looked up, the job writes its tables, the query reads one of them back


@dataclass(frozen=True)
class _ViewInputs:
    views: Views
    task: dict

    def table(self, name: str) -> DataFrame:
        if name == "task":
            return self.views.spark.createDataFrame([(1, None, None, None, None, None, None, json.dumps(self.task))], TASK)
        return getattr(self.views, name)


def _job(v: Views, name: str, table: str, task: dict) -> DataFrame:
    out = f"{v.shared.base}/results"
    jobs.run_task(name, 1, _ViewInputs(v, task), jobs.FolderResults(out))
    return v.spark.read.parquet(f"{out}/{table}").withColumn("task_id", F.col("task_id").cast("long"))


_TASK = {
    "startDate": [PARAMS.start_date],
    "endDate": [PARAMS.end_date],
    "startAge": [str(PARAMS.start_age)],
    "endAge": [str(PARAMS.end_age)],
    "gender": [PARAMS.gender],
    "categoryIds": [",".join(map(str, PARAMS.category_ids or ()))],
    "targetPageFlow": [",".join(map(str, _FLOW))],
}


@register(_P + " " + _histogram_sql("passing"))
def job_session_aggr_stat(v: Views) -> DataFrame:
    return _job(v, "session", "session_aggr_stat", _TASK)


@register(_CATS + " SELECT 1 AS task_id, category_id, session_id, click_count FROM top_sess")
def job_session_top10(v: Views) -> DataFrame:
    return _job(v, "session", "top10_session", _TASK)


@register(_PAGES + " SELECT 1 AS task_id, string_agg(page_split || '=' || coalesce(CAST(CAST(convert_rate AS DOUBLE) AS VARCHAR), 'null'), '|' ORDER BY idx) AS convert_rate FROM final")
def job_page(v: Views) -> DataFrame:
    return _job(v, "page", "page_split_convert_rate", _TASK)


@register(
    _AREA
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY area ORDER BY click_count DESC, product_id) AS place FROM apc JOIN product_info USING (product_id))
SELECT 1 AS task_id, area, 'D级' AS area_level, product_id, city_infos, click_count, product_name, json_extract_string(extend_info, '$.product_status') AS product_status FROM r WHERE place <= 3"""
)
def job_product(v: Views) -> DataFrame:
    """The levels are those of the original regions, so these areas have the last one."""
    return _job(v, "product", "area_top3_product", {"startDate": ["2024-01-02 00:00:00"], "endDate": ["2024-01-29 12:00:00"]})


def _stream(v: Views, table: str) -> DataFrame:
    """The streaming job over the log as text files, in one batch; a second start finds nothing new."""
    log, out = f"{v.shared.base}/log", f"{v.shared.base}/stream"
    ads.log_lines(v.ad_log).write.text(log)
    job = AdClickJob(v.spark, out, CLICKS)
    for _ in range(2):
        job.start(file_log(v.spark, log), f"{out}/_checkpoint", available_now=True).awaitTermination()
    return job.table(table).read()


@register(_ADS + " SELECT date, user_id, ad_id, click_count FROM ucc")
def stream_user_click_count(v: Views) -> DataFrame:
    return _stream(v, "ad_user_click_count")


@register(_ADS + " SELECT user_id FROM bl")
def stream_black_list(v: Views) -> DataFrame:
    return _stream(v, "ad_black_list")


@register(_ADS + " SELECT strftime(ts, '%Y%m%d') AS date, province, city, ad_id, count(*) AS click_count FROM ad_log GROUP BY 1, 2, 3, 4")
def stream_ad_stat(v: Views) -> DataFrame:
    """The first batch meets an empty blacklist."""
    return _stream(v, "ad_stat")
