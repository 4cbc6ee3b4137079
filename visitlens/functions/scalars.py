"""Scalar and aggregate helpers as Column expressions; nothing here leaves the JVM."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: One or two digits of the hour are read.
TIME = "yyyy-MM-dd H:mm:ss"


def is_empty(c: Column) -> Column:
    return c.isNull() | (c == "")


def not_empty(c: Column) -> Column:
    return ~is_empty(c)


def trim_comma(c: Column) -> Column:
    """Without one leading and one trailing comma."""
    return F.regexp_replace(c, "^,|,$", "")


def pad_two(c: Column) -> Column:
    return F.when(F.length(c) >= 2, c).otherwise(F.lpad(c, 2, "0"))


def field_of(record: Column, name: str, delimiter: str = "|") -> Column:
    """Value of ``name`` in a ``k=v|k=v`` record; null if it is missing or empty."""
    parts = F.filter(F.split(record, rf"\Q{delimiter}\E"), lambda p: F.substring_index(p, "=", 1) == name)
    value = F.element_at(F.split(F.try_element_at(parts, F.lit(1)), "=", 2), -1)
    return F.when(value != "", value)


def with_field(record: Column, name: str, value: Column, delimiter: str = "|") -> Column:
    """The record with the value of ``name`` replaced; unchanged if there is no such field."""
    new = F.concat(F.lit(name + "="), value)
    return F.array_join(F.transform(F.split(record, rf"\Q{delimiter}\E"), lambda p: F.when(F.substring_index(p, "=", 1) == name, new).otherwise(p)), delimiter)


def parse_time(c: Column) -> Column:
    return F.try_to_timestamp(c, F.lit(TIME))


def format_time(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def format_date(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


def date_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMdd")


def parse_date_key(c: Column) -> Column:
    return F.to_date(c, "yyyyMMdd")


def minute_key(c: Column) -> Column:
    return F.date_format(c, "yyyyMMddHHmm")


def date_hour(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd_HH")


def before(a: Column, b: Column) -> Column:
    return a < b


def after(a: Column, b: Column) -> Column:
    return a > b


def seconds_between(later: Column, earlier: Column) -> Column:
    """Whole seconds; sub-second parts of either side are cut first."""
    return F.unix_timestamp(later) - F.unix_timestamp(earlier)


def today() -> Column:
    return F.date_format(F.current_date(), "yyyy-MM-dd")


def yesterday() -> Column:
    return F.date_format(F.date_sub(F.current_date(), 1), "yyyy-MM-dd")


def ratio2(part: Column, whole: Column) -> Column:
    """``part / whole`` to two places, halves up, by integer arithmetic; null if ``whole`` is 0."""
    part, whole = part.cast("long"), whole.cast("long")
    up = F.floor((part * 200 + whole).cast("decimal(38,0)") / F.nullif(whole * 2, F.lit(0)))
    return up.cast("long") / F.lit(100.0)


def round_to(num: Column, scale: int) -> Column:
    """``num`` to ``scale`` places, halves up, by the digits that the number prints."""
    return F.round(num.cast("double"), scale)


def ids_of(c: Column) -> Column:
    """Elements of a comma list, without empty ones; an empty array for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), ","), lambda x: x != "")


def json_field(json: Column, name: str) -> Column:
    """A top-level field as text; null for malformed JSON."""
    return F.get_json_object(json, f"$.{name}")


def concat2(a: Column, b: Column, delimiter: str) -> Column:
    """``a`` and ``b`` with a delimiter between; null prints as ``null``."""
    return F.concat(F.coalesce(a.cast("string"), F.lit("null")), F.lit(delimiter), F.coalesce(b.cast("string"), F.lit("null")))


def group_concat_distinct(c: Column, delimiter: str = ",") -> Column:
    """Sorted distinct values, joined."""
    return F.array_join(F.array_sort(F.collect_set(c)), delimiter)


def or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0).cast("long"))


def _group_concat_distinct():
    """The aggregate by its name in SQL text.  SQL functions can't aggregate, so this one takes a group's values
    to Python; plans of this package use the Column above, which combines before the shuffle."""

    @F.pandas_udf("string")
    def group_concat_distinct(values: pd.Series) -> str:
        return ",".join(sorted(values.dropna().unique(), key=lambda x: x.encode()))

    return group_concat_distinct


def register_sql_functions(spark: SparkSession) -> None:
    """The named functions for SQL text; the scalar ones are SQL functions that Catalyst inlines."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION concat2(a STRING, b STRING, split STRING) RETURNS STRING RETURN concat(coalesce(a, 'null'), split, coalesce(b, 'null'))")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION get_json_obj(json STRING, field STRING) RETURNS STRING RETURN get_json_object(json, concat('$.', field))")
    spark.udf.register("group_concat_distinct", _group_concat_distinct())
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION trim_comma(s STRING) RETURNS STRING RETURN regexp_replace(s, '^,|,$', '')")
