"""Importers by agent: what reads an agent's histories, and which files they are. Others can be added to them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Tables
from . import hermes, jsonl, sqlite
from .histories import HistorySource


@dataclass(frozen=True)
class Importer:
    """read(spark, folder or names of files, profile=...) gives the canonical tables; glob: the names of the files that a history changes with."""

    agent: str
    read: Callable[..., Tables]
    glob: str


_KNOWN: dict[str, Importer] = {}


def register(agent: str, read: Callable[..., Tables], glob: str, replace: bool = False) -> Importer:
    """Adds an importer; an agent has one, and another takes its place only if that is asked for."""
    if not agent.strip():
        raise ValueError("an importer without an agent")
    if agent in _KNOWN and not replace:
        raise ValueError(f"{agent} has an importer")
    _KNOWN[agent] = Importer(agent, read, glob)
    return _KNOWN[agent]


def of(agent: str) -> Importer:
    if agent not in _KNOWN:
        raise ValueError(f"no importer for {agent}; there are {', '.join(agents())}")
    return _KNOWN[agent]


def agents() -> list[str]:
    return sorted(_KNOWN)


register("claude-code", jsonl.claude_code, "*.jsonl")
register("codex", jsonl.codex, "*.jsonl")
register("gemini", jsonl.gemini, "*.json")
register("grok-build", jsonl.grok_build, "*.json*")
register("hermes", hermes.hermes, "*")
register("cursor", sqlite.cursor, "store.db")
register("antigravity", sqlite.antigravity, "*.db")


def read(spark: SparkSession, folders: Mapping[str, Iterable[tuple[str, str]]]) -> Tables:
    """What the importers of some agents read, put together. folders: of each agent (profile, folder), as `profiles.roots` gives them."""
    parts = [of(agent).read(spark, path, profile=profile) for agent, places in folders.items() for profile, path in places]
    if not parts:
        raise ValueError("no folders to read")
    return reduce(Tables.union, parts)


def files(spark: SparkSession, folders: Mapping[str, Iterable[tuple[str, str]]]) -> DataFrame:
    """(agent, profile, file, size, raw_hash) of the files of these folders that the agents' histories are in."""
    spark.dataSource.register(HistorySource)
    parts = []
    for agent, places in folders.items():
        for profile, path in places:
            rows = spark.read.format(HistorySource.name()).options(path=path, glob=of(agent).glob).load()
            parts.append(rows.select(F.lit(agent).alias("agent"), F.lit(profile).alias("profile"), "file", "size", "raw_hash"))
    if not parts:
        return spark.createDataFrame([], "agent string, profile string, file string, size long, raw_hash string")
    return reduce(DataFrame.unionByName, parts)
