"""Canonical tables: a star around sessions, with a parent edge among them."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SESSIONS = (
    "id string, agent string, device_id string, project_path string, project_remote string, project_marker string, started_at timestamp, "
    "last_activity_at timestamp, first_prompt string, model string, raw_uri string, raw_hash string, raw_size long, parent_session_id string, profile string"
)
TURNS = "id long, session_id string, role string, content string, ts timestamp, kind string, tool_name string"
TOOLS = "session_id string, name string, count long"
TOKENS = ("total_tokens", "input_tokens", "output_tokens", "cached_tokens", "cache_read_tokens", "cache_creation_tokens")
USAGE = "session_id string, " + ", ".join(f"{t} long" for t in TOKENS)
KINDS = "session_id string, kind string"
DEVICES = "id string, friendly_name string"
LEDGER = "session_id string, raw_hash string, projection_version int"

#: Agents whose histories are read, and the kinds of session.
AGENTS = ("claude-code", "codex", "cursor", "gemini", "antigravity", "hermes", "grok-build")
SESSION_KINDS = ("goal", "workflow", "ralph-loop", "orchestrator")


@dataclass(frozen=True)
class Tables:
    """The canonical tables. usage has no row for a session that was not measured, which isn't the same as zeros."""

    sessions: DataFrame
    turns: DataFrame
    tools: DataFrame
    usage: DataFrame
    kinds: DataFrame
    devices: DataFrame
    ledger: DataFrame | None = None

    def write(self, path: str) -> None:
        """Parquet, sessions by day, so that a time window prunes folders."""
        for f in fields(self):
            df = getattr(self, f.name)
            if df is not None and f.name != "sessions":
                df.write.mode("overwrite").parquet(f"{path}/{f.name}")
        self.sessions.withColumn("day", F.to_date("started_at")).write.mode("overwrite").partitionBy("day").parquet(f"{path}/sessions")

    def union(self, other: Tables) -> Tables:
        """The rows of both; a device once."""
        both = {f.name: getattr(self, f.name).unionByName(getattr(other, f.name), allowMissingColumns=True) for f in fields(self) if getattr(self, f.name) is not None and getattr(other, f.name) is not None}
        return Tables(**both | {"devices": both["devices"].distinct()})

    @classmethod
    def read(cls, spark, path: str) -> Tables:
        return cls(**{f.name: spark.read.parquet(f"{path}/{f.name}") for f in fields(cls) if f.name != "ledger"})


def valid_id(c: Column) -> Column:
    """1 to 128 of letters, digits, dot, underscore and hyphen, without two dots in a row."""
    return F.coalesce(c.rlike(r"^[A-Za-z0-9._-]{1,128}$") & ~c.contains(".."), F.lit(False))


def validated(sessions: DataFrame, agents=AGENTS) -> tuple[DataFrame, DataFrame]:
    """(rows to take in, rejected rows with a reason)."""
    reason = (
        F.when(~valid_id(F.col("id")), "bad id").when(~F.coalesce(F.col("agent").isin(*agents), F.lit(False)), "unknown agent")
        .when(F.col("parent_session_id").isNotNull() & ~valid_id(F.col("parent_session_id")), "bad parent id")
    )
    marked = sessions.withColumn("_reason", reason)
    return marked.where("_reason is null").drop("_reason"), marked.where("_reason is not null").withColumnRenamed("_reason", "reason")


def without_nul(df: DataFrame) -> DataFrame:
    """NUL bytes in strings become spaces."""
    return df.withColumns({c: F.translate(c, "\0", " ") for c, t in df.dtypes if t == "string"})
