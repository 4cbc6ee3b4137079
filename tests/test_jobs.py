"""Jobs from task rows to result tables, updates of database tables, pushed bounds and superseded folders."""

import json

import pytest
from pyspark.sql import functions as F

from visitlens import jobs
from visitlens.functions import scalars as S
from visitlens.operators import sessions
from visitlens.schemas import CITY_INFO, KEYS, PRODUCT_INFO, RESULTS, TASK
from visitlens.sources import mock, tables
from visitlens.sources.jdbc import JdbcStore
from visitlens.sources.testdata import Views

DRIVER = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}


@pytest.fixture(scope="module")
def inputs(spark, tmp_path_factory):
    folder = f"file://{tmp_path_factory.mktemp('inputs')}"
    given = {"startAge": ["10"], "endAge": ["60"], "targetPageFlow": ["1,2,3"]}
    rows = {
        "user_visit_action": mock.mock_actions(spark, 200),
        "user_info": mock.mock_users(spark),
        "product_info": spark.createDataFrame([(i, f"p{i}", '{"product_status": 1}') for i in range(100)], PRODUCT_INFO),
        "city_info": spark.createDataFrame([(i, f"c{i}", "华北") for i in range(10)], CITY_INFO),
        "task": spark.createDataFrame([(7, None, None, None, None, None, None, json.dumps(given))], TASK),
    }
    for name, df in rows.items():
        df.write.parquet(f"{folder}/{name}")
    return jobs.TableInputs(spark, folder)


@pytest.mark.parametrize("to", ["folder", "database"])
def test_jobs(spark, inputs, tmp_path, to):
    store = JdbcStore(spark, "jdbc:derby:memory:jobs;create=true", DRIVER)
    out = f"file://{tmp_path}/out"
    results = jobs.FolderResults(out) if to == "folder" else jobs.JdbcResults(store)
    read = (lambda n: spark.read.parquet(f"{out}/{n}")) if to == "folder" else store.read
    for name in jobs.JOBS:
        for _ in range(2):  # the second run replaces the rows of the first
            params = jobs.run_task(name, 7, inputs, results)
    passing = sessions.filter_sessions(sessions.session_full_info(inputs.table("user_visit_action"), inputs.table("user_info")), params)
    assert read("session_aggr_stat").first()["session_count"] == passing.count() > 0
    for name in ("session_aggr_stat", "session_random_extract", "session_detail", "top10_category", "top10_session", "page_split_convert_rate", "area_top3_product"):
        got = read(name)
        assert {c.lower() for c in got.columns} == {c.lower() for c in RESULTS[name].names}
        assert {r[0] for r in got.select("task_id").distinct().collect()} == {7}
    assert read("top10_category").count() == 10 and read("page_split_convert_rate").count() == 1
    with pytest.raises(LookupError):
        jobs.run_task("page", 8, inputs, results)


def test_command(spark, inputs, tmp_path, monkeypatch):
    monkeypatch.setattr(jobs, "build_session", lambda *_: spark)
    jobs.main(["page", "7", "--inputs", inputs.folder, "--out", f"file://{tmp_path}/out"])
    assert spark.read.parquet(f"file://{tmp_path}/out/page_split_convert_rate").count() == 1
    with pytest.raises(SystemExit):
        jobs.main(["page", "--inputs", inputs.folder, "--out", "x"])


def test_database_updates(spark):
    store, keys = JdbcStore(spark, "jdbc:derby:memory:updates;create=true", DRIVER), KEYS["ad_user_click_count"]
    rows = lambda *x: spark.createDataFrame([("d", u, 1, n) for u, n in x], RESULTS["ad_user_click_count"])
    read = lambda: {r["user_id"]: r["click_count"] for r in store.read("clicks").collect()}
    store.add(rows((1, 5), (2, 6)), "clicks", keys, "click_count")
    store.add(rows((2, 1), (3, 1)), "clicks", keys, "click_count")
    assert read() == {1: 5, 2: 7, 3: 1}
    store.upsert(rows((3, 9), (4, 4)), "clicks", keys)
    store.insert_missing(rows((4, 99), (5, 1)), "clicks", keys)
    assert read() == {1: 5, 2: 7, 3: 9, 4: 4, 5: 1}
    store.replace_where(rows(), "clicks", {"user_id": 1})
    store.upsert(rows(), "clicks", keys)
    assert read() == {2: 7, 3: 9, 4: 4, 5: 1}


def test_superseded_folders_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "KEEP", 2)
    t = tables.SlicedTable(spark, f"file://{tmp_path}/t", RESULTS["ad_stat"], KEYS["ad_stat"], "date")
    row = lambda day: spark.createDataFrame([(day, "P", "C", 1, 1)], RESULTS["ad_stat"])
    t.add(row("a").union(row("b")), 0, "click_count")
    for batch in range(1, 6):
        t.add(row("a"), batch, "click_count")
    assert {r.date: r.click_count for r in t.read().collect()} == {"a": 6, "b": 1}
    assert {p.name for p in (tmp_path / "t").glob("batch-*")} == {"batch-0", "batch-4", "batch-5"}
    assert {p.name for p in (tmp_path / "t" / "_manifests").glob("*.json")} == {"4.json", "5.json"}
    assert not list((tmp_path / "t" / "batch-0").glob("_slice=a"))


def test_bounds_reach_the_scan(spark, data):
    views = Views(spark, data)
    spark.conf.set("spark.sql.maxMetadataStringLength", "1000")
    for df in (views.actions_on("2024-01-03", "2024-01-05"), views.clicks_in("2024-01-03 00:00:00", "2024-01-05 12:00:00")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        pushed = plan.split("PushedFilters: [")[1].split("]")[0]
        assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert "EqualTo(event_type,click)" in pushed
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_days(spark):
    row = spark.range(1).select(S.today().alias("t"), S.yesterday().alias("y"), F.datediff(S.today().cast("date"), S.yesterday().cast("date")).alias("n")).first()
    assert row.n == 1 and len(row.t) == len(row.y) == 10
