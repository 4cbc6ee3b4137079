"""Hand-made sessions and logs with results worked out by hand."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from visitlens.functions import scalars as S
from visitlens.operators import ads, categories, pages, products, sessions
from visitlens.params import Properties, TaskParams, find_task, task_id_from_args
from visitlens.schemas import CITY_INFO, PRODUCT_INFO, TASK, USER_INFO, USER_VISIT_ACTION


def at(text):
    return dt.datetime.strptime(text, "%Y-%m-%d %H:%M:%S")


def action(user, session, time, page, word=None, cat=None, product=None, orders=None, pays=None, city=0):
    return (time[:10], user, session, page, at(time), word, cat, product, orders, None, pays, None, city)


@pytest.fixture(scope="module")
def acts(spark):
    rows = [
        action(1, "s1", "2017-07-23 10:00:00", 1, word="火锅"),
        action(1, "s1", "2017-07-23 10:00:03", 2, cat=12, product=5),
        action(1, "s1", "2017-07-23 10:00:30", 3, cat=1, product=6),
        action(2, "s2", "2017-07-23 23:59:59", 1, orders="3,4,"),
        action(1, "s3", "2017-07-23 05:03:04", 1),
        action(1, "s3", "2017-07-23 05:04:04", 2, pays="3"),
    ]
    return spark.createDataFrame(rows, USER_VISIT_ACTION).cache()


@pytest.fixture(scope="module")
def users(spark):
    return spark.createDataFrame([(1, "a", "a", 25, "p1", "c1", "male"), (2, "b", "b", 40, "p2", "c2", "female")], USER_INFO)


@pytest.fixture(scope="module")
def full(acts, users):
    return sessions.session_full_info(acts, users).cache()


def test_sessions(full):
    got = {r.session_id: (r.step_length, r.visit_length, r.click_category_ids) for r in full.collect()}
    assert got == {"s1": (3, 30, [1, 12]), "s2": (1, 0, []), "s3": (2, 60, [])}


def test_histogram(full):
    row = sessions.session_aggr_stat(full).first().asDict()
    want = {"task_id": 0, "session_count": 3, "10s_30s": 0.33, "30s_60s": 0.67, "1m_3m": 0.33, "1_3": 1.0}
    assert row == {k: want.get(k, 0.0) for k in row}
    young = sessions.session_aggr_stat(sessions.filter_sessions(full, TaskParams(start_age=20, end_age=30))).first()
    assert (young.session_count, young["10s_30s"], young["30s_60s"], young["1m_3m"], young["1_3"]) == (2, 0.5, 1.0, 0.5, 1.0)
    none = sessions.session_aggr_stat(full.where("false")).first()
    assert none.session_count == 0 and none["1_3"] is None


@pytest.mark.parametrize(
    "params, want",
    [
        (TaskParams(), {"s1", "s2", "s3"}),
        (TaskParams(start_age=30), {"s1", "s2", "s3"}),
        (TaskParams(category_ids=[1, 9]), {"s1"}),
        (TaskParams(keywords=["火锅"]), {"s1"}),
        (TaskParams(gender="female"), {"s2"}),
        (TaskParams(cities=["c1"], professionals=["p2"]), set()),
    ],
)
def test_filter(full, params, want):
    assert {r.session_id for r in sessions.filter_sessions(full, params).collect()} == want


@pytest.mark.parametrize("value, names", [(0, []), (1, ["1s_3s"]), (3, ["1s_3s"]), (30, ["10s_30s", "30s_60s"]), (60, ["30s_60s", "1m_3m"]), (180, ["1m_3m", "3m_10m"]), (600, ["3m_10m", "10m_30m"]), (1800, ["10m_30m", "30m"])])
def test_length_edges(spark, value, names):
    row = sessions.session_aggr_stat(spark.createDataFrame([(value, 0)], "visit_length long, step_length long")).first()
    assert [n for n, *_ in sessions.LENGTH_BUCKETS if row[n]] == names


@pytest.mark.parametrize("value, names", [(0, []), (1, ["1_3"]), (4, ["4_6"]), (10, ["10_30"]), (30, ["10_30", "30_60"]), (60, ["30_60", "60"]), (61, ["60"])])
def test_step_edges(spark, value, names):
    row = sessions.session_aggr_stat(spark.createDataFrame([(0, value)], "visit_length long, step_length long")).first()
    assert [n for n, *_ in sessions.STEP_BUCKETS if row[n]] == names


def test_categories(acts):
    top = categories.top_categories(acts)
    assert [tuple(r)[1:] for r in top.collect()] == [(1, 1, 0, 0), (12, 1, 0, 0), (3, 0, 1, 1), (4, 0, 1, 0)]
    best = categories.top_sessions(acts, top)
    assert {tuple(r)[1:] for r in best.collect()} == {(1, "s1", 1), (12, "s1", 1)}
    assert sessions.session_detail_repeated(acts, best).count() == 6
    assert {r.category_id for r in categories.category_distinct(acts).collect()} == {1, 3, 4, 12}


def test_detail_reads_zero(acts, full):
    rows = sessions.session_detail(acts, full.where("session_id = 's3'"), 7).collect()
    assert len(rows) == 2 and all(r.click_category_id == 0 and r.task_id == 7 for r in rows)


def test_pages(acts):
    def rates(flow):
        return {r.page_split: r.convert_rate for r in pages.page_convert_rate(acts, flow).collect()}

    assert rates((1, 2, 3)) == {"1_2": 0.67, "2_3": 0.5}
    assert rates((1, 2, 9)) == {"1_2": 0.67, "2_9": 0.0}
    assert rates((7, 8)) == {"7_8": None}
    assert pages.page_convert_rate_string(acts, (1, 2, 3)).first().convert_rate == "1_2=0.67|2_3=0.5"
    assert pages.page_convert_rate(acts, (1, 2, 1, 2)).count() == 3


def test_areas(spark):
    cities = spark.createDataFrame([(0, "北京", "华北"), (3, "广州", "华南"), (7, "西安", "西北"), (9, "哈尔滨", "东北")], CITY_INFO)
    clicks = spark.createDataFrame([(c, p) for c in (0, 3, 7, 9) for p in (1, 2, 3, 4)] + [(0, 4), (99, 1)], "city_id int, product_id long")
    known = spark.createDataFrame([(1, "a", '{"product_status": 1}'), (2, "b", "{broken"), (3, "c", None), (4, "d", '{"product_status": 0}')], PRODUCT_INFO)
    got = {(r.area, r.product_id): r for r in products.area_top_products(clicks, cities, known).collect()}
    assert {p for a, p in got if a == "华北"} == {4, 1, 2} and {p for a, p in got if a == "华南"} == {1, 2, 3}
    assert {a: got[a, 1].area_level for a in ("华北", "华南", "西北", "东北")} == {"华北": "A级", "华南": "B级", "西北": "C级", "东北": "D级"}
    assert got["华北", 2].product_status is None and got["华北", 1].city_infos == "0:北京"


def test_sample_quota(full):
    got = sessions.session_random_extract(full, 3)
    assert got.count() == 3
    assert sorted(got.collect()) == sorted(sessions.session_random_extract(full, 3).collect())
    assert sessions.session_random_extract(full.where("false"), 3).count() == 0


LINES = ["1500000000000 P1 C1 1 7"] * 3 + ["1500000000000 P1 C2 2 7", "1500000000000 P1 C2 2 8"]


def test_ad_log(spark):
    log = ads.parse_log(spark.createDataFrame([(x,) for x in [*LINES, "broken", "x P C 1 2", "1 P C y 2"]], "value string"))
    assert log.count() == 5
    counts = ads.user_click_count(log)
    assert {(r.user_id, r.ad_id): r.click_count for r in counts.collect()} == {(1, 7): 3, (2, 7): 1, (2, 8): 1}
    blocked = ads.black_list(counts, 3)
    assert [r.user_id for r in blocked.collect()] == [1]
    assert {(r.city, r.ad_id): r.click_count for r in ads.ad_stat(ads.filtered_log(log, blocked)).collect()} == {("C2", 7): 1, ("C2", 8): 1}
    assert {tuple(r) for r in ads.click_trend(log).collect()} == {("2017-07-14", "02", "40", 7, 4), ("2017-07-14", "02", "40", 8, 1)}


def test_params(spark, tmp_path):
    text = '{"startAge":["10"],"endAge":["50"],"startDate":["2017-07-23"],"endDate":["2017-07-24"],"cities":["a,b,"],"categoryIds":["1,2"],"gender":[""]}'
    p = TaskParams.from_json(text, 1)
    assert (p.start_age, p.end_age, list(p.cities), list(p.category_ids), p.gender, p.keywords) == (10, 50, ["a", "b"], [1, 2], None, None)
    tasks = spark.createDataFrame([(1, "t", "", "", "", "", "", text)], TASK)
    assert find_task(tasks, 1) == p
    with pytest.raises(LookupError):
        find_task(tasks, 2)
    assert task_id_from_args(["3"]) == 3 and task_id_from_args(["3"], 9, local=True) == 9 and task_id_from_args([]) is None
    (tmp_path / "x.properties").write_text("# note\nsize = 10\nlocal=true\nname=a=b\n")
    props = Properties.load(tmp_path / "x.properties")
    assert (props.integer("size"), props.boolean("local"), props.string("name"), props.integer("none", 4)) == (10, True, "a=b", 4)


def test_scalars(spark):
    row = spark.createDataFrame([("a=1|b=|c=x=y", "2017-07-23 5:03:04")], "r string, t string").select(
        S.field_of(F.col("r"), "a").alias("a"),
        S.field_of(F.col("r"), "b").alias("b"),
        S.field_of(F.col("r"), "d").alias("d"),
        S.with_field(F.col("r"), "b", F.lit("9")).alias("w"),
        S.with_field(F.col("r"), "z", F.lit("9")).alias("z"),
        S.date_hour(S.parse_time(F.col("t"))).alias("h"),
        S.ids_of(F.lit("1,2,")).alias("ids"),
        S.concat2(F.lit(None), F.lit("x"), ":").alias("n"),
        S.ratio2(F.lit(1), F.lit(0)).alias("zero"),
    ).first()
    assert (row.a, row.b, row.d, row.w, row.z, row.h) == ("1", None, None, "a=1|b=9|c=x=y", "a=1|b=|c=x=y", "2017-07-23_05")
    assert row.ids == ["1", "2"] and row.n == "null:x" and row.zero is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(ages=st.one_of(st.none(), st.tuples(st.integers(0, 50), st.integers(0, 50))), cats=st.one_of(st.none(), st.lists(st.integers(0, 5), min_size=1, max_size=3)))
def test_filter_is_brute_force(spark, ages, cats):
    rows = [(i, i * 7 % 50, [c for c in range(6) if (i >> c) & 1] or None) for i in range(40)]
    df = spark.createDataFrame(rows, "session_id int, age int, click_category_ids array<bigint>")
    p = TaskParams(start_age=ages and ages[0], end_age=ages and ages[1], category_ids=cats)
    want = {i for i, a, c in rows if (not ages or ages[0] <= a <= ages[1]) and (not cats or set(c or ()) & set(cats))}
    assert {r.session_id for r in sessions.filter_sessions(df, p).collect()} == want
