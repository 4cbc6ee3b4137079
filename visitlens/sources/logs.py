"""Ad log lines as a stream: from Kafka where the connector is there, or from text files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from visitlens.operators.ads import parse_log


def kafka_log(spark: SparkSession, brokers: str, topics: str, **options: str) -> DataFrame:
    """Parsed log from a comma list of topics."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", brokers).option("subscribe", topics)
    for key, value in options.items():
        reader = reader.option(key, value)
    return parse_log(reader.load().selectExpr("CAST(value AS STRING) AS value"))


def file_log(spark: SparkSession, folder: str, files_per_trigger: int | None = None) -> DataFrame:
    """Parsed log from text files that appear in a folder."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return parse_log(reader.load(folder))
