"""Folders of histories by profile: the agent's own, and others that belong to named profiles."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from functools import reduce

from pyspark.sql import SparkSession

from ..schema import Tables

DEFAULT = "default"


def roots(own: str, named: Mapping[str, str] | None = None) -> list[tuple[str, str]]:
    """(profile, folder): the default profile's first, its own unless another is named for it, then the others in the order of their names."""
    named = dict(named or {})
    if not all(name.strip() for name in named):
        raise ValueError("a profile without a name")
    return [(DEFAULT, named.pop(DEFAULT, own)), *sorted(named.items())]


def read_all(spark: SparkSession, importer: Callable[..., Tables], folders: list[tuple[str, str]]) -> Tables:
    """What an importer reads from each profile's folder, put together; each session has its profile's name."""
    return reduce(Tables.union, [importer(spark, path, profile=name) for name, path in folders])
