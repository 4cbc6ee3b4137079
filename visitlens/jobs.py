"""The four jobs.  ``python -m visitlens.jobs session 7 --inputs FOLDER --out FOLDER`` runs one for a task.

A job looks up its task, writes what its results share once, and puts every result into its table.
Running a task again replaces its rows.
"""

from __future__ import annotations

import argparse
import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from visitlens.operators import categories, pages, products, sessions
from visitlens.params import Properties, TaskParams, find_task, task_id_from_args
from visitlens.session import build_session, pin
from visitlens.sources.jdbc import JdbcStore
from visitlens.sources.logs import file_log, kafka_log
from visitlens.sources.shared import Shared
from visitlens.sources.tables import write_result
from visitlens.streaming.ads import AdClickJob


class Inputs(Protocol):
    def table(self, name: str) -> DataFrame: ...


class Results(Protocol):
    def write(self, df: DataFrame, name: str, task_id: int) -> None: ...


@dataclass(frozen=True)
class TableInputs:
    """Tables by name: Parquet folders below ``folder``, or those of the session's catalog."""

    spark: SparkSession
    folder: str | None = None

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}") if self.folder else self.spark.table(name)


@dataclass(frozen=True)
class JdbcInputs:
    """Tasks and dimensions that ``names`` lists come from a database, the rest from ``others``."""

    store: JdbcStore
    others: Inputs
    names: tuple[str, ...] = ("task", "city_info")

    def table(self, name: str) -> DataFrame:
        return self.store.read(name) if name in self.names else self.others.table(name)


@dataclass(frozen=True)
class FolderResults:
    """Result tables as Parquet folders, cut by task."""

    path: str

    def write(self, df: DataFrame, name: str, task_id: int) -> None:
        write_result(df, f"{self.path}/{name}", task_id)


@dataclass(frozen=True)
class JdbcResults:
    """Result tables of a database; the rows of the task are replaced in one transaction."""

    store: JdbcStore

    def write(self, df: DataFrame, name: str, task_id: int) -> None:
        self.store.replace_where(df, name, {"task_id": task_id})


def session_job(inputs: Inputs, params: TaskParams, results: Results, total: int = sessions.SAMPLE_SIZE) -> None:
    """Histogram, sample, categories and their sessions.

    The actions are scanned twice, for the sessions that pass and for their detail rows; the results read those two.
    """
    actions = sessions.actions_between(inputs.table("user_visit_action"), params)
    users = inputs.table("user_info")
    with Shared(actions.sparkSession, "session-job") as shared:
        passing = shared.save(sessions.filter_sessions(sessions.session_full_info(actions, users), params), "sessions")
        detail = shared.save(sessions.actions_of(actions, passing), "detail")
        sample = shared.save(sessions.session_random_extract(passing, total, task_id=params.task_id), "sample")
        top = shared.save(categories.top_categories(detail, task_id=params.task_id), "categories")
        busiest = shared.save(categories.top_sessions(detail, top, task_id=params.task_id), "busiest")
        details = sessions.session_detail(detail, sample, params.task_id).unionByName(sessions.session_detail_repeated(detail, busiest, params.task_id))
        for name, df in (
            ("session_aggr_stat", sessions.session_aggr_stat(passing, params.task_id)),
            ("session_random_extract", sample),
            ("session_detail", details),
            ("top10_category", top),
            ("top10_session", busiest),
        ):
            results.write(df, name, params.task_id)


def page_job(inputs: Inputs, params: TaskParams, results: Results) -> None:
    actions = sessions.actions_between(inputs.table("user_visit_action"), params)
    rates = pages.page_convert_rate_string(actions, params.target_page_flow, params.task_id)
    results.write(rates, "page_split_convert_rate", params.task_id)


def product_job(inputs: Inputs, params: TaskParams, results: Results, levels: Mapping = products.AREA_LEVELS) -> None:
    """The task's dates are points in time here, both included."""
    clicks = products.click_actions(inputs.table("user_visit_action"), params.start_date, params.end_date)
    top = products.area_top_products(clicks, inputs.table("city_info"), inputs.table("product_info"), levels, task_id=params.task_id)
    results.write(top, "area_top3_product", params.task_id)


JOBS: dict[str, Callable[[Inputs, TaskParams, Results], None]] = {"session": session_job, "page": page_job, "product": product_job}


def run_task(name: str, task_id: int, inputs: Inputs, results: Results) -> TaskParams:
    """Look up the task, which must exist, and run the job with its parameters."""
    params = find_task(inputs.table("task"), task_id)
    JOBS[name](inputs, params, results)
    return params


@dataclass
class AdSource:
    """Where the ad log comes from: a folder of text files, or topics of a broker."""

    folder: str | None = None
    brokers: str | None = None
    topics: str = ""
    options: dict[str, str] = field(default_factory=dict)

    def read(self, spark: SparkSession) -> DataFrame:
        return kafka_log(spark, self.brokers, self.topics, **self.options) if self.brokers else file_log(spark, self.folder or "")


def main(args: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="visitlens.jobs", description=__doc__)
    parser.add_argument("job", choices=[*JOBS, "ad"])
    parser.add_argument("task", nargs="?", help="task id; --properties may hold one for local runs")
    parser.add_argument("--inputs", help="folder of input tables; without it, those of the catalog")
    parser.add_argument("--out", required=True, help="folder of result tables")
    parser.add_argument("--properties", help="file of key=value lines: local, task.session, task.page, task.product, jdbc.url, jdbc.user, jdbc.password, kafka.brokers, kafka.topics")
    parser.add_argument("--log", help="folder of ad log files, for the ad job without a broker")
    parser.add_argument("--once", action="store_true", help="the ad job ends when it has read what is there")
    given = parser.parse_args(args)
    conf = Properties.load(given.properties) if given.properties else Properties({})
    local = conf.boolean("local")
    spark = pin(build_session(f"visitlens-{given.job}", "local[*]" if local else None))
    if given.job == "ad":
        source = AdSource(given.log, conf.string("kafka.brokers"), conf.string("kafka.topics") or "")
        AdClickJob(spark, given.out).start(source.read(spark), f"{given.out}/_checkpoint", given.once).awaitTermination()
        return
    key = f"task.{given.job}"
    task_id = task_id_from_args([given.task] if given.task else [], conf.integer(key) if conf.string(key) else None, local)
    if task_id is None:
        parser.error("no task id")
    inputs: Inputs = TableInputs(spark, given.inputs)
    results: Results = FolderResults(given.out)
    if conf.string("jdbc.url"):
        login = {k: v for k in ("user", "password", "driver") if (v := conf.string(f"jdbc.{k}") or os.environ.get(f"JDBC_{k.upper()}"))}
        store = JdbcStore(spark, conf.string("jdbc.url") or "", login)
        inputs, results = JdbcInputs(store, inputs), JdbcResults(store)
    run_task(given.job, task_id, inputs, results)


if __name__ == "__main__":
    main()
