"""Bundles of an older layout: a catalogue in SQLite, and files packed by their content's digest under raw/sources."""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import closing

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tools of which a bundle's files can be read again.
TOOLS = ("claude", "codex", "cursor", "gemini")
_FILES = "tool string, path string, object string, size long"


def _catalogue(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    from .sqlite import opened

    for pdf in batches:
        for data in pdf["content"]:
            with closing(opened(bytes(data))) as con:
                rows = con.execute("SELECT source_tool, path, substr(object_id, 8), size_bytes FROM source_files WHERE object_id LIKE 'blake3:_%'").fetchall()
            yield pd.DataFrame([r for r in rows if r[0] in TOOLS], columns=[c.split()[0] for c in _FILES.split(", ")])


def source_files(spark: SparkSession, path: str, catalogue: str = "*.sqlite") -> DataFrame:
    """(tool, path, object, size): the files that can be read again, with the paths that they once had."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", catalogue).load(path).select("content")
    return f.mapInPandas(_catalogue, _FILES)


def _unpacked(name: str, data: bytes) -> bytes:
    if not name.endswith(".zst"):
        return data
    import io

    import zstandard  # optional: only packed files need it

    return zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data)).read()


def restored(spark: SparkSession, path: str, catalogue: str = "*.sqlite") -> DataFrame:
    """(tool, path, object, body): each file's bytes, unpacked; of a digest's .zst and .bin the first. Files that are gone are left out."""
    packed = spark.read.format("binaryFile").option("pathGlobFilter", "*.{zst,bin}").load(f"{path}/raw/sources")
    packed = packed.select(F.regexp_extract("path", r"([^/]+)\.[^/.]+$", 1).alias("object"), F.regexp_extract("path", "([^/]+)$", 1).alias("name"), "content")
    joined = source_files(spark, path, catalogue).join(packed, "object")
    best = joined.groupBy("tool", "path", "object").agg(F.max(F.struct("name", "content")).alias("f"))  # .zst comes after .bin
    unpack = F.udf(lambda name, data: _unpacked(name, bytes(data)), "binary")
    return best.select("tool", "path", "object", unpack("f.name", "f.content").alias("body"))


def restore(files: DataFrame, to: str) -> DataFrame:
    """(tool, file): files written as to/<tool>/<object>/<name that they once had>, for the importers to read; `to` is a folder that all executors share."""

    def write(batches):
        for pdf in batches:
            out = []
            for tool, path, object_, body in zip(pdf["tool"], pdf["path"], pdf["object"], pdf["body"], strict=True):
                name = f"{to}/{tool}/{object_}/{os.path.basename(path)}"
                os.makedirs(os.path.dirname(name), exist_ok=True)
                with open(f"{name}.{os.getpid()}", "wb") as f:
                    f.write(bytes(body))
                os.replace(f.name, name)  # a task that runs again replaces what it wrote
                out.append((tool, name))
            yield pd.DataFrame(out, columns=["tool", "file"])

    return files.mapInPandas(write, "tool string, file string")
