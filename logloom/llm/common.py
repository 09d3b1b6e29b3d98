"""Helpers shared by the corpus operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's spark.checkpoint.dir; make a folder of this machine only in local mode, where none is set."""
    if not spark.conf.get("spark.checkpoint.dir", "") and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="ckpt-"))


def stored(df: DataFrame, integers: bool = False) -> DataFrame:
    """df written as Parquet in the shared checkpoint folder and read again: cuts its lineage, and what uses it twice computes it once.

    All that an application stores stands in one folder, logloom-<application id>, to be removed when it has ended: results are read from it until then.
    integers: the columns are integers, which are written as differences; best where they are sorted.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    top = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir()
    path = f"{top.rstrip('/')}/logloom-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if integers:
        writer = writer.option("parquet.writer.version", "PARQUET_2_0").option("parquet.enable.dictionary", "false")
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def quoted(name: str) -> Column:
    """A top-level column, whatever its name."""
    return F.col("`" + name.replace("`", "``") + "`")


def with_fields(rows: DataFrame, result: Column, fields: list[str], without: tuple[str, ...] = ()) -> DataFrame:
    """rows with the fields of the struct `result`, in place of columns of their names and of `without`; no other column's name can clash."""
    kept = [c for c in rows.columns if c not in fields and c not in without]
    packed = rows.select(F.struct(F.lit(0).alias("_"), *map(quoted, kept)).alias("_row"), result.alias("_new"))
    return packed.select(*[F.col("_row")[c].alias(c) for c in kept], *[F.col("_new")[f].alias(f) for f in fields])


def crc_mod(col: str | Column, m: int) -> Column:
    """crc32 of a value as text, modulo m; null for null."""
    c = F.col(col) if isinstance(col, str) else col
    return F.pmod(F.crc32(c.cast("string").cast("binary")), F.lit(m))


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, component): smallest node reachable, for every node of the edges (a, b: long).

    Alternating large-star and small-star contraction; each round is two shuffles of
    the edge list and is cut with checkpoint(). Nothing is collected but a count and a hash.
    """
    spark = edges.sparkSession
    ensure_checkpoint_dir(spark)
    e = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct().checkpoint()
    seen = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        e = (
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(low.select("u", F.col("m").alias("v"))).distinct().checkpoint()
        )
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)


def spanning_links(n: int, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For links i-j among n items, one link from each item to the smallest item of its group."""
    label = np.arange(n)
    while len(i):
        a, b = label[i], label[j]
        low = np.minimum(a, b)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        while True:
            nxt = label[label]
            if (nxt == label).all():
                break
            label = nxt
        keep = label[i] != label[j]
        i, j = i[keep], j[keep]
    k = np.flatnonzero(label != np.arange(n))
    return k, label[k]


# -- a Bloom filter sized by its keys, tested in numpy --------------------------------------------

#: At most 2^27 bits (16 MB): enough for 4 million keys at 32 bits a key. More keys mean more false hits, never a miss, and no larger filter.
BLOOM_BITS = 27
_BLOOM_LEAST = 12
_BLOOM_FULL = 1 / 16  # share of set bits up to which a filter may be halved


class Bloom:
    """Words of 64 bits; two bits for each key."""

    def __init__(self, words: np.ndarray, bits: int):
        while bits > _BLOOM_LEAST and 2 * int(np.bitwise_count(words).sum(dtype=np.int64)) <= _BLOOM_FULL * len(words) * 64:
            words, bits = words[: len(words) // 2] | words[len(words) // 2 :], bits - 1
        self.words, self.mask = words, np.uint64((1 << bits) - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Whether each of the hashes (any 64-bit integers) may be a key; False is sure."""
        h = h.view(np.uint64) if h.dtype == np.int64 else h.astype(np.uint64)
        ok = np.ones(len(h), bool)
        for p in (h & self.mask, (h >> np.uint64(64 - BLOOM_BITS)) & self.mask):
            ok &= (self.words[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return ok


def build_bloom(keys: DataFrame, col: str) -> Bloom:
    """Filter over the long hashes in `col`, made in one pass; at most 2^21 words of 16 bytes reach the driver, fewer than two a key.

    Keys may repeat and may be any number; null keys are left out.
    """
    k, m = F.col(col), (1 << BLOOM_BITS) - 1
    pos = keys.where(k.isNotNull()).select(F.explode(F.array(k.bitwiseAND(F.lit(m)), F.shiftrightunsigned(k, 64 - BLOOM_BITS).bitwiseAND(F.lit(m)))).alias("p"))
    words = (
        pos.select(F.shiftright("p", 6).alias("w"), F.expr("shiftleft(1L, cast(p & 63 as int))").alias("b"))
        .groupBy("w").agg(F.bit_or("b").alias("b"))
    )
    out = np.zeros(1 << (BLOOM_BITS - 6), np.int64)
    got = words.toArrow()
    out[got["w"].to_numpy()] = got["b"].to_numpy()
    return Bloom(out.view(np.uint64), BLOOM_BITS)


def release_memory() -> None:
    """Gives back to the system what earlier tasks of this Python worker have freed: workers live on from stage to stage, and C's and Arrow's allocators keep it."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc's; other C libraries have their own ways
    if trim:
        trim(0)


# -- hashes of many slices of a buffer -------------------------------------------------------------

#: The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261))
SHORT = 32  # slices of fewer bytes are hashed and compared by eights in numpy


def _rotated(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def eights(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes i to i + 7 as a number, for each i; bytes i to i + 3); what stands beyond the end is zero."""
    more = np.concatenate([buf, np.zeros(SHORT, np.uint8)])
    n = len(buf) + SHORT - 7
    return np.ndarray((n,), "<u8", more, 0, (1,)), np.ndarray((n,), "<u4", more, 0, (1,))


def slice_hashes(data: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """XXH64 (seed 0) of each slice of data, which buf holds too: short ones of equal length together, in numpy, the others by the library."""
    out, size = np.empty(len(start), np.uint64), end - start
    eight, four = eights(buf)
    order = np.argsort(size, kind="stable")
    cut = np.searchsorted(size[order], np.arange(SHORT + 1))
    for n in range(1, SHORT):
        k = order[cut[n] : cut[n + 1]]
        if not len(k):
            continue
        at, h = start[k], np.full(len(k), _P5 + np.uint64(n))
        left = n
        while left >= 8:
            h = _rotated(h ^ (_rotated(eight[at] * _P2, 31) * _P1), 27) * _P1 + _P4
            at, left = at + 8, left - 8
        if left >= 4:
            h = _rotated(h ^ (four[at].astype(np.uint64) * _P1), 23) * _P2 + _P3
            at, left = at + 4, left - 4
        for i in range(left):
            h = _rotated(h ^ (buf[at + i].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        out[k] = h ^ (h >> np.uint64(32))
    for i in order[cut[SHORT] :].tolist():
        out[i] = xxhash.xxh64_intdigest(data[start[i] : end[i]])
    return out


def utf8(texts: pd.Series) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    return [t.encode("utf-8", "replace") if isinstance(t, str) else b"" for t in texts]


def split_by_bloom(df: DataFrame, key: str, keys: DataFrame, beside: tuple[str, Callable[[pd.Series], pd.Series], str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is surely not among `keys`, the other rows); keys has the one column `key`.

    So that few rows, not all, are shuffled to an exact join. The filter is of 16 MB at most (see Bloom).
    beside: (column, function, type) of what the first rows also get as `_beside`, made in the same pass, so that a task needs one Python worker and not two.
    """
    bloom = df.sparkSession.sparkContext.broadcast(build_bloom(keys.select(F.xxhash64(key).alias("h")), "h"))

    @F.pandas_udf("boolean")
    def maybe(h: pd.Series) -> pd.Series:
        return pd.Series(bloom.value.has(h.to_numpy(np.int64)))

    m = maybe(F.xxhash64(key))
    if beside is None:
        return df.where(~m), df.where(m)
    column, make, kind = beside

    @F.pandas_udf(f"maybe boolean, made {kind}")
    def both(h: pd.Series, c: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"maybe": bloom.value.has(h.to_numpy(np.int64)), "made": make(c)})

    # not to be evaluated once for the condition and once for the column
    rest = df.withColumn("_b", both.asNondeterministic()(F.xxhash64(key), quoted(column))).where("not _b.maybe")
    return rest.select(*map(quoted, df.columns), F.col("_b.made").alias("_beside")), df.where(m)


def drop_keys(df: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """df without the rows whose key is among `keys`; null keys stay."""
    rows = df.select(F.struct(*map(quoted, df.columns)).alias("_doc"), quoted(key).alias("_of"))
    rest, maybe = split_by_bloom(rows, "_of", keys.select(F.col(key).alias("_of")))
    return rest.union(maybe.join(keys.select(F.col(key).alias("_gone")), F.col("_of") == F.col("_gone"), "left_anti")).select("_doc.*")
