"""Task parameters: JSON with an array of one string for each key."""

from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from pathlib import Path

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class TaskParams:
    """A parameter that is None sets no condition."""

    task_id: int = 0
    start_date: str | None = None
    end_date: str | None = None
    start_age: int | None = None
    end_age: int | None = None
    professionals: Sequence[str] | None = None
    cities: Sequence[str] | None = None
    gender: str | None = None
    keywords: Sequence[str] | None = None
    category_ids: Sequence[int] | None = None
    target_page_flow: Sequence[int] = field(default_factory=tuple)

    @classmethod
    def from_json(cls, text: str, task_id: int = 0) -> TaskParams:
        given = json.loads(text) if text else {}

        def one(key: str) -> str | None:
            value = first_param(given, key)
            return value if value else None

        def many(key: str) -> list[str] | None:
            value = one(key)
            return [x for x in value.split(",") if x] if value else None

        def number(key: str) -> int | None:
            value = one(key)
            return int(value) if value else None

        categories = many("categoryIds")
        return cls(
            task_id,
            one("startDate"),
            one("endDate"),
            number("startAge"),
            number("endAge"),
            many("professionals"),
            many("cities"),
            one("gender"),
            many("keywords"),
            [int(x) for x in categories] if categories else None,
            tuple(int(x) for x in many("targetPageFlow") or ()),
        )

    def but(self, **changes) -> TaskParams:
        return replace(self, **changes)


def first_param(given: dict, key: str) -> str | None:
    """First element of the array under ``key``, or None."""
    value = given.get(key)
    if isinstance(value, list):
        return value[0] if value else None
    return value


def find_task(tasks: DataFrame, task_id: int) -> TaskParams:
    """Point lookup of a task; a missing one is an error."""
    row = tasks.where(tasks["task_id"] == task_id).select("task_param").first()
    if row is None:
        raise LookupError(f"no task {task_id}")
    return TaskParams.from_json(row[0], task_id)


def task_id_from_args(args: Sequence[str], configured: int | None = None, local: bool = False) -> int | None:
    """The configured id in local mode, else the first argument; None if there is neither."""
    if local and configured is not None:
        return configured
    try:
        return int(args[0])
    except (IndexError, ValueError):
        return configured


@dataclass(frozen=True)
class Properties:
    """Reader of ``key=value`` files with typed getters."""

    values: dict[str, str]

    @classmethod
    def load(cls, path: str | Path) -> Properties:
        out = {}
        for line in Path(path).read_text(encoding="utf-8").splitlines():
            line = line.strip()
            if line and line[0] not in "#!":
                key, _, value = line.partition("=")
                out[key.strip()] = value.strip()
        return cls(out)

    def string(self, key: str) -> str | None:
        return self.values.get(key)

    def integer(self, key: str, default: int = 0) -> int:
        try:
            return int(self.values[key])
        except (KeyError, ValueError):
            return default

    def boolean(self, key: str, default: bool = False) -> bool:
        value = self.values.get(key)
        return default if value is None else value.lower() == "true"
