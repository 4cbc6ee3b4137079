"""JDBC, sliced tables, mock data and the streams."""

from pyspark.sql import functions as F

from visitlens.operators import ads, sessions
from visitlens.schemas import CITY_INFO, KEYS, RESULTS
from visitlens.session import DEFAULTS, REQUIRED
from visitlens.sources import mock
from visitlens.sources.jdbc import JdbcStore
from visitlens.sources.logs import file_log
from visitlens.sources.tables import SlicedTable, write_result
from visitlens.streaming import ads as streams

LINES = ["1500000000000 P1 C1 1 7"] * 3 + ["1500000000000 P1 C2 2 7", "1500000000000 P1 C2 2 8"]


def test_jdbc_round_trip(spark):
    store = JdbcStore(spark, "jdbc:derby:memory:visits;create=true", {"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    cities = spark.createDataFrame([(i, f"c{i}", "a") for i in range(10)], CITY_INFO)
    store.replace(cities, "city_info")
    store.append(cities.where("city_id < 3").withColumn("city_id", F.col("city_id") + 10), "city_info", connections=1)
    assert store.read("city_info").count() == 13
    assert store.read("city_info", "CITY_ID", 0, 13, 3).agg(F.sum("CITY_ID")).first()[0] == sum(range(13))


def test_sliced_table(spark, tmp_path):
    t = SlicedTable(spark, f"file://{tmp_path}/t", RESULTS["ad_stat"], KEYS["ad_stat"], "date")
    new = spark.createDataFrame([("20170714", "P", "C", 1, 2), ("20170715", "P", "C", 1, 5)], RESULTS["ad_stat"])
    assert t.read().count() == 0
    assert t.add(new, 0, "click_count") and not t.add(new, 0, "click_count")
    t.add(new.where("date = '20170714'"), 1, "click_count")
    assert {r.date: r.click_count for r in t.read().collect()} == {"20170714": 4, "20170715": 5}
    t.upsert(new.where("date = '20170714'"), 2)
    assert {r.date: r.click_count for r in t.read().collect()} == {"20170714": 2, "20170715": 5}
    t.insert_missing(new.withColumn("click_count", F.lit(99).cast("long")), 3)
    assert {r.date: r.click_count for r in t.read().collect()} == {"20170714": 2, "20170715": 5}
    top = SlicedTable(spark, f"file://{tmp_path}/p", RESULTS["ad_province_top3"], KEYS["ad_province_top3"], "date")
    top.replace_groups(spark.createDataFrame([("d", "P", 1, 5), ("d", "P", 2, 4), ("d", "Q", 1, 1)], RESULTS["ad_province_top3"]), 0)
    top.replace_groups(spark.createDataFrame([("d", "P", 3, 9)], RESULTS["ad_province_top3"]), 1)
    assert {tuple(r) for r in top.read().collect()} == {("d", "P", 3, 9), ("d", "Q", 1, 1)}
    assert top.last_batch == 1


def test_write_result(spark, tmp_path):
    df = spark.range(3).select(F.col("id").alias("category_id"))
    path = f"file://{tmp_path}/r"
    for _ in range(2):
        write_result(df, path, 1)
    write_result(df, path, 2)
    write_result(df, path, 2, append=True)
    assert {r.task_id: r["count"] for r in spark.read.parquet(path).groupBy("task_id").count().collect()} == {1: 3, 2: 6}
    write_result(df.limit(0), path, 1)
    assert {r.task_id: r["count"] for r in spark.read.parquet(path).groupBy("task_id").count().collect()} == {2: 6}


def test_mock(spark):
    acts = mock.mock_actions(spark, 200)
    assert acts.count() == mock.mock_actions(spark, 200).count() > 1000
    assert acts.exceptAll(mock.mock_actions(spark, 200)).isEmpty()
    assert sessions.session_full_info(acts, mock.mock_users(spark)).count() == 200
    assert mock.mock_products(spark).count() == 100


def test_ad_job(spark, tmp_path):
    """Two equal batches: the first makes the blacklist, the second is filtered by it; replays change nothing."""
    job = streams.AdClickJob(spark, f"file://{tmp_path}/job", threshold=3)
    log = ads.parse_log(spark.createDataFrame([(x,) for x in LINES], "value string"))
    for batch in (0, 0, 1, 1):
        job.apply(log, batch)
    read = lambda n: {tuple(r) for r in job.table(n).read().collect()}
    assert read("ad_user_click_count") == {("2017-07-14", 1, 7, 6), ("2017-07-14", 2, 7, 2), ("2017-07-14", 2, 8, 2)}
    assert read("ad_black_list") == {(1,)}
    assert read("ad_stat") == {("20170714", "P1", "C1", 7, 3), ("20170714", "P1", "C2", 7, 2), ("20170714", "P1", "C2", 8, 2)}
    assert read("ad_province_top3") == {("2017-07-14", "P1", 7, 5), ("2017-07-14", "P1", 8, 2)}
    assert read("ad_click_trend") == {("2017-07-14", "02", "40", 7, 5), ("2017-07-14", "02", "40", 8, 2)}


def test_ad_stream_from_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(2):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(LINES) + "\n")
    job = streams.AdClickJob(spark, f"file://{tmp_path}/job", threshold=3)
    job.start(file_log(spark, f"{tmp_path}/in", 1), f"{tmp_path}/ck", available_now=True).awaitTermination(120)
    assert {tuple(r) for r in job.table("ad_stat").read().collect()} == {("20170714", "P1", "C1", 7, 3), ("20170714", "P1", "C2", 7, 2), ("20170714", "P1", "C2", 8, 2)}


def _run(spark, frame, name, tmp_path):
    query = frame.writeStream.format("memory").queryName(name).outputMode("update").option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name)


def test_streams_equal_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    lines = [f"{1500000000000 + i * 7000} P{i % 2} C{i % 3} {i % 5} {i % 4}" for i in range(200)]
    for i in range(4):
        (tmp_path / "in" / f"{i}.txt").write_text("\n".join(lines[50 * i : 50 * i + 50]) + "\n")
    batch = ads.parse_log(spark.createDataFrame([(x,) for x in lines], "value string"))
    log = file_log(spark, f"{tmp_path}/in", 1)
    blocked = spark.createDataFrame([(3,)], "user_id long")
    cases = {
        "users": (streams.user_click_counts(log), ads.user_click_count(batch)),
        "stats": (streams.ad_stats(log, blocked), ads.ad_stat(ads.filtered_log(batch, blocked))),
        "trends": (streams.click_trends(log), ads.click_trend(batch, None)),
        "sliding": (streams.sliding_clicks(log, "20 minutes", "10 minutes"), ads.click_sliding_window(batch, "20 minutes", "10 minutes")),
    }
    for name, (stream, want) in cases.items():
        out = _run(spark, stream, name, tmp_path)
        keys = [c for c in out.columns if c != "click_count"]
        assert sorted(out.groupBy(*keys).agg(F.max("click_count").alias("click_count")).collect()) == sorted(want.select(*out.columns).collect()), name


def test_session_settings():
    assert REQUIRED["spark.sql.session.timeZone"] == "UTC" and DEFAULTS["spark.sql.adaptive.enabled"] == "true"
