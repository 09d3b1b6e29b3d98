"""SimHash near-duplicates: tiled exact comparison with numpy exclusive-or and bit counts.

Where a similarity is asked for, fingerprints and MinHash bands only propose texts to compare; a link is made
where the shingle sets themselves are that similar.

Every pair of fingerprints within the radius is found. Fingerprints are cut into radius + 1 bit
bands, of which two fingerprints within the radius share one at least; within each band's bucket
they are laid out in tiles by population count, tile pairs whose counts differ by more than the
radius are skipped, and the others are compared whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import connected_components, ensure_checkpoint_dir, quoted, release_memory, spanning_links, split_by_bloom, stored, table, utf8

SEED = 42
TILE = 2048  # fingerprints in a tile, about
_SUB = 256  # rows compared at a time within a tile
_GROUP = 100_000  # fingerprints of small buckets that one task takes, about
_LANES = 1 << 18  # hashes unpacked to bits at a time
#: MinHash bands and the minima in each: a pair of similarity s shares a band with probability 1 - (1 - s^6)^24, 0.9993 for 0.8.
BANDS, ROWS = 24, 6
_FACTORS = np.random.default_rng(SEED).integers(1 << 63, size=BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SETS = 2_000_000  # shingles in a tile of a bucket of candidates, about


def _shingle_hashes(text: bytes, words: int) -> np.ndarray:
    """XXH64 of each shingle of the lower-cased text, repeats included; fewer words: the whole sequence; none: nothing."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    hash_, s = xxhash.xxh64_intdigest, b" ".join(w)
    if len(w) <= words:
        return np.array([hash_(s, SEED)], np.uint64)
    ends = np.append(np.flatnonzero(np.frombuffer(s, np.uint8) == 32), len(s))
    starts = np.concatenate([[0], ends[:-1] + 1])
    return np.fromiter((hash_(s[a:b], SEED) for a, b in zip(starts[: len(w) - words + 1].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, len(w) - words + 1)


def _majority(h: np.ndarray) -> np.uint64:
    if not len(h):
        return np.uint64(0)
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), _LANES):
        part = h[k : k + _LANES]
        ones += np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(ones * 2 > len(h)).view(">u8")[0]


def fingerprints(texts: list[bytes], words: int) -> np.ndarray:
    """Signed 64-bit fingerprint of each text; 0 where there are no words."""
    return np.array([_majority(_shingle_hashes(t, words)) for t in texts], np.uint64).view(np.int64)


def band_values(hashes: list[np.ndarray]) -> np.ndarray:
    """A row of BANDS values (long) for each text's shingle hashes; 0 where there are none."""
    out = np.zeros((len(hashes), BANDS), np.uint64)
    full = np.flatnonzero([len(h) for h in hashes])
    if len(full):
        all_ = np.concatenate([hashes[i] for i in full])
        starts = np.cumsum([0] + [len(hashes[i]) for i in full[:-1]])
        for k, factor in enumerate(_FACTORS):
            v = (out[full, k // ROWS] ^ np.minimum.reduceat(all_ * factor, starts)) * np.uint64(0x9E3779B97F4A7C15)
            out[full, k // ROWS] = v ^ (v >> np.uint64(29))
    return out.view(np.int64)


def fingerprint(text: Column, words: int = 4) -> Column:
    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series(fingerprints(utf8(texts), words))

    return run(text)


def _close(a: np.ndarray, b: np.ndarray, radius: int, same: bool) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs within the radius between a and b, both sorted by population count, compared in tiles."""
    pa, pb = np.bitwise_count(a), np.bitwise_count(b)
    found = [(np.zeros(0, np.int64),) * 2]
    for i in range(0, len(a), _SUB):
        lo, hi = int(pa[i]) - radius, int(pa[min(i + _SUB, len(a)) - 1]) + radius
        for j in range(i if same else 0, len(b), _SUB):
            if int(pb[min(j + _SUB, len(b)) - 1]) < lo or int(pb[j]) > hi:
                continue  # no pair of these tiles can be within the radius
            x, y = np.nonzero(np.bitwise_count(a[i : i + _SUB, None] ^ b[None, j : j + _SUB]) <= radius)
            found.append((x + i, y + j))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def _links(fps: np.ndarray, i: np.ndarray, j: np.ndarray) -> pd.DataFrame:
    x, y = spanning_links(len(fps), i, j)
    return pd.DataFrame({"a": fps[x].view(np.int64), "b": fps[y].view(np.int64)})


def _by_count(fps: np.ndarray) -> np.ndarray:
    return fps[np.argsort(np.bitwise_count(fps), kind="stable")]


def near_pairs(fps: DataFrame, radius: int = 4) -> DataFrame:
    """(a, b): links between distinct fingerprints `fp` (long) whose components are those of all pairs within the radius.

    Each task returns a spanning forest of the pairs it found, never all pairs of a group.
    Memory of a task: about _GROUP fingerprints, or two tiles.
    """
    bands = radius + 1
    cuts = [64 * k // bands for k in range(bands + 1)]
    band = F.array(*[F.shiftrightunsigned("fp", cuts[k]).bitwiseAND(F.lit((1 << (cuts[k + 1] - cuts[k])) - 1)) for k in range(bands)])
    rows = fps.select("fp", F.posexplode(band).alias("band", "value"))
    bucket = ["band", "value"]
    # at most bands * 2^(64 / bands) buckets, whatever the input: 41,000 for radius 4
    sizes = rows.groupBy(*bucket, F.bit_count("fp").alias("ones")).agg(F.count("*").alias("n"))
    sizes = sizes.groupBy(*bucket).agg(
        F.sum("n").alias("size"),
        F.map_from_entries(F.collect_list(F.struct("ones", F.ceil(F.col("n") / TILE).cast("int").alias("tiles")))).alias("tiles"),
    )
    groups = max(1, -(-bands * fps.count() // _GROUP))
    large = F.col("size") > TILE
    sizes = sizes.select(*bucket, large.alias("large"), F.when(large, F.col("tiles")).alias("tiles"))
    rows = rows.join(F.broadcast(sizes) if bands == 5 else sizes, bucket).withColumn("ones", F.bit_count("fp"))

    def small_buckets(pdf: pd.DataFrame) -> pd.DataFrame:
        order = np.lexsort((pdf["value"], pdf["band"]))
        key = (pdf["band"].to_numpy(np.int64)[order] << 32) | pdf["value"].to_numpy(np.int64)[order]
        all_, at = pdf["fp"].to_numpy(np.int64)[order].view(np.uint64), np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
        out = [_links(f, *_close(f, f, radius, True)) for s, e in zip(at[:-1], at[1:], strict=True) if e - s > 1 for f in [_by_count(all_[s:e])]]
        out = [x for x in out if len(x)]
        return pd.concat(out) if out else pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})

    small = (
        rows.where("not large").withColumn("g", F.pmod(F.hash("band", "value"), F.lit(groups)))
        .select("g", "band", "value", "fp").groupBy("g").applyInPandas(small_buckets, "a long, b long")
    )

    # tiles of a large bucket: (ones, part); a tile meets itself and the later tiles within the radius
    tile = F.struct("ones", F.expr("cast(pmod(xxhash64(fp), tiles[ones]) as int)").alias("part"))
    near = F.expr(f"filter(transform(sequence(-{radius}, {radius}), d -> ones + d), o -> map_contains_key(tiles, o))")
    others = F.explode(F.flatten(F.transform(near, lambda o: F.transform(F.sequence(F.lit(0), F.element_at("tiles", o) - 1), lambda p: F.struct(o.alias("ones"), p.alias("part"))))))
    met = rows.where("large").withColumn("tile", tile).withColumn("other", others)
    met = met.select(*bucket, F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y"), "fp", (F.col("tile") > F.col("other")).alias("second"))

    def tile_pair(pdf: pd.DataFrame) -> pd.DataFrame:
        second = pdf["second"].to_numpy(bool)
        f = pdf["fp"].to_numpy(np.int64).view(np.uint64)
        a, b = f[~second], f[second]
        if len(b):
            i, j = _close(_a := _by_count(a), _b := _by_count(b), radius, False)
            return _links(np.concatenate([_a, _b]), i, j + len(_a))
        same = pdf["alone"].iloc[0]
        if not same or len(a) < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        return _links(_a := _by_count(a), *_close(_a, _a, radius, True))

    met = met.select(*bucket, "x", "y", "fp", "second", (F.col("x") == F.col("y")).alias("alone"))
    large = met.groupBy(*bucket, "x", "y").applyInPandas(tile_pair, "a long, b long")
    return small.union(large)


def _linked(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each set of distinct hashes, the first set of its component by all pairs of that Jaccard similarity; empty sets are alike.

    A set is compared with all others unless it is of the largest component already, so a group of copies costs its size.
    """
    n, lens = len(sets), np.array([len(x) for x in sets])
    distinct, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends, mark = np.cumsum(lens), np.zeros(len(distinct), bool)
    label, done = np.arange(n), np.zeros(n, bool)
    while True:
        todo = np.flatnonzero((label != np.bincount(label).argmax()) & ~done)
        if not len(todo):
            return label
        i = todo[0]
        own = at[ends[i] - lens[i] : ends[i]]
        mark[own] = True
        seen = np.append(0, np.cumsum(mark[at]))
        both = seen[ends] - seen[ends - lens]
        mark[own], done[i] = False, True
        either = lens + lens[i] - both
        hit = np.unique(label[np.where(either > 0, both / np.maximum(either, 1), 1.0) >= similarity])
        label[np.isin(label, hit)] = hit[0]


def similar_texts(docs: DataFrame, texts: DataFrame, words: int, radius: int, similarity: float) -> DataFrame:
    """(a, b): links whose components are those of the compared texts of that Jaccard similarity by distinct shingles.

    docs: (key, text); texts: (key, fp, n, bands), a row for each key. Compared are all texts that share a MinHash band, and each
    text with the smallest key that the fingerprints link it to. Memory of a task: the shingles of two tiles of a bucket.
    """
    parts = connected_components(near_pairs(texts.select("fp").distinct(), radius))
    fp = texts.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("key", F.coalesce("component", "fp").alias("component"))
    fp = fp.join(fp.groupBy("component").agg(F.min("key").alias("low")), "component").where("key <> low")
    fp = fp.select(F.lit(-1).alias("band"), F.xxhash64("low", "key").alias("value"), F.lit(1).alias("tiles"), F.explode(F.array("low", "key")).alias("key"))

    rows = texts.select("key", "n", F.posexplode("bands").alias("band", "value"))
    many = rows.groupBy("band", "value").agg(
        F.count("*").alias("size"), F.ceil(F.sum("n") / _SETS).cast("int").alias("tiles"),
        F.bit_xor(F.xxhash64("key")).alias("k1"), F.bit_xor(F.xxhash64("key", F.lit(1))).alias("k2"),
    ).where("size > 1")
    many = many.groupBy("size", "k1", "k2").agg(F.min(F.struct("band", "value", "tiles")).alias("m"))  # buckets of the same texts are one
    many = many.select("m.band", "m.value", F.greatest("m.tiles", F.lit(1)).alias("tiles"))
    members = rows.join(many, ["band", "value"]).select("band", "value", "tiles", "key").union(fp).checkpoint()

    keys = members.select("key").distinct()
    found = split_by_bloom(docs, "key", keys)[1].join(keys, "key").dropDuplicates(["key"])

    def shingles(batches):
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "set": [np.unique(_shingle_hashes(t, words)).tobytes() for t in utf8(pdf["text"])]})

    sets = stored(found.select("key", "text").mapInPandas(shingles, "key long, set binary"))
    tile = F.expr("cast(pmod(xxhash64(key), tiles) as int)")
    members = members.withColumn("p", tile).select("*", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)).alias("q"))
    members = members.select("band", "value", F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "key")

    def links(pdf: pd.DataFrame) -> pd.DataFrame:
        key = pdf["key"].to_numpy(np.int64)
        label = _linked([np.frombuffer(x, np.uint64) for x in pdf["set"]], similarity)
        i = np.flatnonzero(label != np.arange(len(key)))
        return pd.DataFrame({"a": key[i], "b": key[label[i]]})

    return members.join(sets, "key").groupBy("band", "value", "x", "y").applyInPandas(links, "a long, b long")


def text_key(text: Column) -> Column:
    return F.xxhash64(text)


def _told_apart(df: DataFrame, twice: DataFrame) -> DataFrame:
    """df (key, also) with keys of their own for texts that meet another one's key. twice: (key, low), such keys and the second hash of which of their texts keeps it."""
    met = df.join(twice.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    return met.withColumn("key", F.when(F.col("also") != F.col("low"), F.xxhash64("key", "also")).otherwise(F.col("key"))).select(*df.columns)


def _verified(docs: DataFrame, id_col: str, text_col: str, words: int, radius: int, similarity: float) -> DataFrame:
    """A text goes by a hash of 64 bits; a second one tells unlike texts of the same hash apart."""
    text = quoted(text_col)
    rows = docs.select(quoted(id_col).alias("id"), text_key(text).alias("key"), F.xxhash64(F.lit(1), text).alias("also"), text.alias("text"))

    def marks(batches):
        release_memory()
        for pdf in batches:
            h = [_shingle_hashes(t, words) for t in utf8(pdf["text"])]
            fp = np.array([_majority(x) for x in h], np.uint64).view(np.int64)
            yield pd.DataFrame({"id": pdf["id"], "key": pdf["key"], "also": pdf["also"], "fp": fp, "n": [len(x) for x in h], "bands": list(band_values(h))})

    marked = rows.mapInPandas(marks, f"id {dict(rows.dtypes)['id']}, key long, also long, fp long, n long, bands array<long>").checkpoint()  # about 230 bytes a row
    twice = marked.groupBy("key").agg(F.min("also").alias("low"), F.max("also").alias("high")).where("low <> high").select("key", "low").checkpoint()
    if twice.limit(1).count():  # of ten thousand million texts two or three pairs
        rows, marked = _told_apart(rows, twice), _told_apart(marked, twice).checkpoint()
    texts = marked.select("key", "fp", "n", "bands").dropDuplicates(["key"]).checkpoint()
    parts = connected_components(similar_texts(rows.select("key", "text"), texts, words, radius, similarity)).withColumnRenamed("node", "key")
    found = marked.select("id", "key", "fp").join(parts, "key", "left").select("id", "fp", F.coalesce("component", "key").alias("component")).checkpoint()
    lows = found.groupBy("component").agg(F.min("id").alias("component_id"))
    return found.join(lows, "component").select(F.col("id").alias(id_col), "fp", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """(id, fp, component_id), a row for each row of docs; component_id is the smallest id among texts linked,
    directly or through others: within the radius or, where a similarity is given, by that Jaccard similarity of their distinct shingles.

    Null and empty texts have fingerprint 0 and are linked like any other. Repeated rows stay. An id that is
    null counts for no component_id, which is null where no row of the component has an id.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    if similarity is not None:
        return _verified(docs, id_col, text_col, words, radius, similarity)
    rows = docs.select(F.col(id_col).alias("_id"), fingerprint(F.col(text_col), words).alias("fp")).checkpoint()  # 16 bytes a row
    marks = rows.groupBy("fp").agg(F.min("_id").alias("low"))
    parts = connected_components(near_pairs(marks.select("fp"), radius))
    marks = marks.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "low", F.coalesce("component", "fp").alias("component")).checkpoint()
    lows = marks.groupBy("component").agg(F.min("low").alias("component_id"))
    marks = marks.join(lows, "component").select("fp", "component_id")
    return rows.join(marks, "fp").select(F.col("_id").alias(id_col), "fp", "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, radius: int = 4, similarity: float | None = None) -> DataFrame:
    """docs with one row of each component: that of the smallest id. Of rows that repeat an id, the one of the smallest hashes of its text and of the whole row stays; rows without an id stay."""
    found = near_duplicates(docs.where(F.col(id_col).isNotNull()), id_col, text_col, words, radius, similarity)
    keep = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("_keep")).distinct()
    rows = docs.select(F.struct(*map(quoted, docs.columns)).alias("_doc"), quoted(id_col).alias("_of"))  # packed, so that no column's name can clash
    kept = rows.join(keep, F.col("_of") == F.col("_keep")).withColumn("_nth", F.row_number().over(Window.partitionBy("_keep").orderBy(F.xxhash64(F.col("_doc")[text_col]), F.xxhash64("_doc"))))
    return kept.where("_nth = 1").select("_doc.*").union(docs.where(quoted(id_col).isNull()))


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def op2(spark, sf_dir):
    """(doc_id, fingerprint, component_id), a row for each row of documents, repeated rows and null ids included; null and empty texts have the fingerprint of zeros. Whole texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")
