"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

The sets differ greatly in size, an item's few shingles and a long document's many, so that their resemblance says
nothing; the sketch is one of containment: the MinHash values of the item alone, its smallest shingle hashes, looked up in each
document. Items are partitioned by size, their number of distinct shingles, from each power of two to the next; `sketch_size` says how many hashes a partition's
sketches have. Shingles that many items share, such as a common preamble, come last: they would have every document that has them asked for all these items. A document that holds the threshold's share of an item lacks so few shingles that one of the sketch is surely
met, or, in partitions of large items, is met but for a probability of MISS. Documents are asked only for items
of partitions that their own number of shingles can hold. A pass over all texts finds which documents meet which sketches; these
documents alone are read again, and the shingles themselves decide on these items alone.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import build_bloom, drop_keys, ensure_checkpoint_dir, release_memory, table, utf8

WORDS = 5
THRESHOLD = 0.8
COMMON = 8  # items of different texts that may have a shingle before it counts as a common one
MISS = 1e-9  # probability that a document that holds an item at the threshold meets none of its sketch
_MIX = np.uint64(0x9E3779B97F4A7C15)


def sketch_size(total: Column, rare: Column, threshold: float = THRESHOLD, miss: float = MISS) -> Column:
    """Hashes in the sketch of an item of `total` distinct shingles, `rare` of them in COMMON items at most, where those come first.

    Whoever holds the threshold's share of N shingles lacks N - ceil(threshold N) at most, N being the largest of the size partition: one hash more
    suffices, whichever they are. What is lacking is (1 - threshold) total / rare of the rare ones at most, so k of these, taken at random, are all lacking with that
    share's k-th power as probability at most.
    """
    largest = F.pow(F.lit(2), F.length(F.bin(total))) - 1
    lacks = largest - F.ceil(largest * threshold - 1e-9)
    share = F.try_divide(total * (1 - threshold), rare)
    enough = F.when(share <= 0, 1).when(share < 1, F.greatest(F.lit(1), F.ceil(math.log(miss) / F.ln(share))))
    return F.least(lacks + 1, enough)


def _run_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n words, by place, from the words' hashes."""
    out = np.full(max(len(h) - n + 1, 0), n, np.uint64)
    for i in range(n if len(out) else 0):
        out = (out ^ h[i : len(h) - n + 1 + i]) * _MIX
        out ^= out >> np.uint64(29)
    return out


def _word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def item_shingles(items: DataFrame, id_col: str = "item_id", text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(item, item_id, n, run, h, sketched, total): the distinct shingles of each different item that has a word.

    item: hash of id and text; n: number of words of a shingle, `words` or all the words of a shorter item.
    """
    ensure_checkpoint_dir(items.sparkSession)
    kind = dict(items.dtypes)[id_col]

    def run(batches):
        for pdf in batches:
            out = []
            for i, j, x, t in zip(pdf["item"].tolist(), pdf["item_id"].tolist(), pdf["body"].tolist(), utf8(pdf["text"]), strict=True):
                w = t.lower().split()
                n = min(len(w), words)
                h = _run_hashes(_word_hashes(w), n) if n else ()
                found = {b" ".join(w[k : k + n]): x for k, x in enumerate(h)}
                out += [(i, j, x, n, s, int(v.view(np.int64)), len(found)) for s, v in found.items()]
            yield pd.DataFrame(out, columns=["item", "item_id", "body", "n", "run", "h", "total"])

    rows = items.select(F.xxhash64(id_col, text_col).alias("item"), F.col(id_col).alias("item_id"), F.xxhash64(text_col).alias("body"), F.col(text_col).alias("text")).dropDuplicates(["item", "item_id"])
    rows = rows.mapInPandas(run, f"item long, item_id {kind}, body long, n int, run binary, h long, total int").checkpoint()
    many = rows.select("n", "h", "body").distinct().groupBy("n", "h").agg(F.count("*").alias("_items")).where(F.col("_items") > COMMON)
    rows = rows.join(many, ["n", "h"], "left").na.fill(0, ["_items"])
    own = Window.partitionBy("item", "item_id")
    rare, place = F.count_if(F.col("_items") == 0).over(own), F.row_number().over(own.orderBy("_items", "h"))
    return rows.select("item", "item_id", "n", "run", "h", (place <= sketch_size(F.col("total"), rare, threshold)).alias("sketched"), "total")


def _text_runs(bloom, lengths: list[int], whole: bool, of=None):
    """A pass over (row, doc_id, text): each text's distinct runs of words whose hash the filter may have; as words where `whole`, with the text's number of runs. of: a filter of the rows that are looked at."""

    def search(batches):
        release_memory()
        for pdf in batches:
            if of is not None:
                pdf = pdf[of.value.has(pdf["row"].to_numpy(np.int64))].reset_index(drop=True)
            own, runs, hashes, sizes, held = [], [], [], [], []
            for k, t in enumerate(utf8(pdf["text"])):
                w = t.lower().split()
                wh = _word_hashes(w) if w else np.zeros(0, np.uint64)
                for n in lengths:
                    h = _run_hashes(wh, n)
                    at = np.flatnonzero(bloom.value.has(h))
                    if len(at):
                        found = {b" ".join(w[i : i + n]) if whole else x: x for i, x in zip(at.tolist(), h[at].view(np.int64).tolist(), strict=True)}
                        own += [k] * len(found)
                        runs += found.keys()
                        hashes += found.values()
                        sizes += [n] * len(found)
                        held += [len(h)] * len(found)
            out = {"row": pdf["row"].to_numpy()[own], "doc_id": pdf["doc_id"].iloc[own].reset_index(drop=True), "n": np.array(sizes, np.int32)}
            yield pd.DataFrame(out | ({"run": pd.Series(runs, dtype=object)} if whole else {"h": np.array(hashes, np.int64), "held": np.array(held, np.int64)}))

    return search


def candidates(rows: DataFrame, shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(row, doc_id, item, item_id) of texts (row, doc_id, text) that meet an item's sketch and have shingles enough for it."""
    sketch = shingles.where("sketched").select("item", "item_id", "n", "h", "total")
    lengths = sorted(r[0] for r in sketch.select("n").distinct().collect())  # a few numbers: a shingle's words at most
    bloom = rows.sparkSession.sparkContext.broadcast(build_bloom(sketch, "h"))
    met = rows.mapInPandas(_text_runs(bloom, lengths, False), f"row long, doc_id {dict(rows.dtypes)['doc_id']}, n int, h long, held long")
    return met.join(sketch, ["n", "h"]).where(F.col("held") >= threshold * F.col("total") - 1e-9).select("row", "doc_id", "item", "item_id").distinct()


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", words: int = WORDS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, containment): each document with each item of whose distinct word shingles it holds the share `threshold` or more.

    A-Z are lower-cased and words split at ASCII white space. An item of fewer than `words` words is one shingle,
    a run of words. Null, empty and blank texts hold nothing and are held by nothing, texts of any length are taken whole. Each row is a
    document and an item of its own: rows that repeat an id with other texts are not put together, and those that
    repeat a (doc_id, item_id) give their largest containment once. A null id takes part like any other; other columns are not looked at.

    The filters broadcast are of a bounded size; what the passes over texts pass on are runs of words that some item has.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    shingles = item_shingles(items, item_id_col, item_text_col, words, threshold).checkpoint()
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    pairs = candidates(rows, shingles, threshold).checkpoint()
    asked = shingles.join(pairs.select("item", "item_id").distinct().select(F.col("item").alias("_i"), F.col("item_id").alias("_id")), (F.col("item") == F.col("_i")) & F.col("item_id").eqNullSafe(F.col("_id")), "left_semi").select("item", "item_id", "n", "run", "h", "total").checkpoint()
    lengths = sorted(r[0] for r in asked.select("n").distinct().collect())
    bloom = docs.sparkSession.sparkContext.broadcast(build_bloom(asked, "h"))
    asking = docs.sparkSession.sparkContext.broadcast(build_bloom(pairs, "row"))
    texts = rows.mapInPandas(_text_runs(bloom, lengths, True, asking), f"row long, doc_id {dict(rows.dtypes)['doc_id']}, n int, run binary").distinct()
    held = texts.join(asked.drop("h"), ["n", "run"])
    which = pairs.select(F.col("row").alias("_r"), F.col("doc_id").alias("_d"), F.col("item").alias("_i"), F.col("item_id").alias("_id"))
    same = (F.col("row") == F.col("_r")) & (F.col("item") == F.col("_i")) & F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("item_id").eqNullSafe(F.col("_id"))
    share = held.join(which, same, "left_semi").groupBy("row", "doc_id", "item", "item_id").agg((F.count("*") / F.max("total")).alias("containment"))
    return share.where(F.col("containment") >= threshold).groupBy(F.col("doc_id").alias(id_col), F.col("item_id").alias(item_id_col)).agg(F.max("containment").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """docs without those that hold an item. Rows without an id stay."""
    held = contained(docs, items, id_col, **how).select(id_col).where(F.col(id_col).isNotNull()).distinct()
    return drop_keys(docs, id_col, held)


def op8(spark, sf_dir):
    """(doc_id, item_id, containment) of all documents and benchmark items: five-word shingles, 0.8 or more. Cases as in contained()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return contained(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


_WORDS_SQL = r"list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '')"
OP8_SQL = f"""
WITH i AS (SELECT row_number() OVER () AS k, item_id, w, least(len(w), {WORDS}) AS n FROM (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark) WHERE len(w) > 0),
s AS (SELECT DISTINCT k, item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS run FROM i),
t AS (SELECT k, count(*) AS total FROM s GROUP BY k),
d AS (SELECT row_number() OVER () AS j, doc_id, {_WORDS_SQL} AS w FROM documents),
r AS (SELECT DISTINCT j, doc_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda p: array_to_string(w[p:p + n - 1], ' '))) AS run FROM d, (SELECT DISTINCT n FROM s) WHERE len(w) >= n),
c AS (SELECT doc_id, item_id, count(*) / max(total) AS containment FROM r JOIN s USING (n, run) JOIN t USING (k) GROUP BY j, k, doc_id, item_id)
SELECT doc_id, item_id, max(containment) AS containment FROM c WHERE containment >= {THRESHOLD} GROUP BY doc_id, item_id
"""
