"""LM scoring by prediction by partial matching over bytes.

The trie of byte contexts is a set of tables, one for each depth, made by grouping. Because the
children of a context are children of each of its suffixes, what symbol exclusion removes at an order
depends on the next longer context alone, so the code length of every (context, byte) that occurs is
found by joins on the trie. Texts are scored in blocks of a bounded size: a block sends its distinct keys
to the joins and gets their values back; nothing of the model is ever held whole in one place.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, quoted, release_memory, slice_hashes, split_by_bloom, stored, table, utf8

ORDER = 5
BLOCK_BYTES = 16 << 20  # of texts, about, and
BLOCK_ROWS = 20_000  # rows that are scored together at most, about
COPIES = 16  # rows of one id and text beyond which they are scored once
_SHORT = 2  # contexts of so many bytes are 65,536 at most, whatever the texts: their tables are broadcast
_CHUNK, _CHUNK_TEXTS = 1 << 20, 1 << 16
_START, _END = 0xFE, 0xFF  # bytes that UTF-8 never has
_SYMBOLS = 255
_WORD_FLAG = 1 << 62
_END_KEY = _WORD_FLAG | xxhash.xxh64_intdigest(b"\n") >> 2  # of what no word is
_UNIT = 1e9  # code lengths go from task to task as whole thousand-millionths of a digit


def _grams(texts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """(context, byte) of every place as an integer of order + 1 bytes, the end of a text included; the texts' starts."""
    pad = bytes([_START]) * order
    buf = np.frombuffer(b"".join([x for t in texts for x in (pad, t, b"\xff")]), np.uint8)
    lens = np.array([len(t) + 1 for t in texts], np.int64)
    key = np.zeros(len(buf) - order, np.uint64)
    for i in range(order + 1):
        key = (key << np.uint64(8)) | buf[i : len(buf) - order + i]
    starts = np.cumsum(lens + order) - (lens + order)
    keep = np.ones(len(key), bool)
    for s in range(order):  # places whose byte belongs to the next text's start
        at = starts[1:] - order + s
        keep[at] = False
    return key[keep], np.cumsum(lens) - lens


def _chunks(texts: list[bytes]):
    """(number of its first text, texts) of chunks of about _CHUNK bytes, or of one longer text."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= _CHUNK or i + 1 - at == _CHUNK_TEXTS or i + 1 == len(texts):
            yield at, texts[at : i + 1]
            at, size = i + 1, 0


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.sort(key)
    at = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return key[at], np.diff(np.append(at, len(key)))


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(parts) == 1:
        return parts[0]
    k, n = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[at], np.add.reduceat(n, at)


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of its text) of each word of the texts, A-Z lower-cased: the word's hash, marked as a word's."""
    data = b" ".join(texts).lower()
    buf = np.frombuffer(data, np.uint8)
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = (buf != 0x20) & ((buf < 0x09) | (buf > 0x0D))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    start, end = edge[::2], edge[1::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    h = slice_hashes(data, buf, start, end)
    return ((h >> np.uint64(2)) | np.uint64(_WORD_FLAG)).astype(np.int64), np.searchsorted(ends, start, side="right")


def _packed(texts: pd.Series) -> pd.Series:
    """UTF-8 bytes, packed, as texts go from task to task twice."""
    return pd.Series([zlib.compress(t, 1) for t in utf8(texts)], dtype=object)


def _unpacked(pdf: pd.DataFrame) -> list[bytes]:
    return [zlib.decompress(z) for z in pdf["packed"]]


class _Sums:
    """Numbers by key, gathered part by part; like sizes are merged first, so that few copies are held at a time."""

    def __init__(self):
        self.parts: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, n: np.ndarray) -> None:
        self.parts.append((keys, n))
        while len(self.parts) > 1 and len(self.parts[-2][0]) < 2 * len(self.parts[-1][0]):
            self.parts[-2:] = [_merge(self.parts[-2:])]

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        return _merge(self.parts)


def _block_keys(pdf: pd.DataFrame) -> pd.DataFrame:
    """(block, key, n) of one block: its distinct words and grams with their numbers in training texts, 0 for those that only other texts have."""
    release_memory()
    texts, times = _unpacked(pdf), np.where(pdf["train"].to_numpy(bool), pdf["times"].to_numpy(np.int64), 0)
    words, grams = _Sums(), _Sums()
    words.add(np.array([_END_KEY]), np.array([times.sum()]))
    for at, chunk in _chunks(texts):
        own = times[at : at + len(chunk)]
        key, of = _words(chunk)
        if len(key):
            distinct, same = np.unique(key, return_inverse=True)
            n = np.zeros(len(distinct), np.int64)
            np.add.at(n, same, own[of])
            words.add(distinct, n)
        for k in np.unique(own):
            g, n = _distinct(_grams([t for t, x in zip(chunk, own == k, strict=True) if x], ORDER)[0])
            grams.add(g, n * k)
    (word, word_n), (gram, gram_n) = words.all(), grams.all()
    return pd.DataFrame({"block": np.int32(pdf["block"].iloc[0]), "key": np.r_[word, gram.astype(np.int64)], "n": np.r_[word_n, gram_n]})


def _low(col: str, n: int) -> F.Column:
    return F.col(col).bitwiseAND(F.lit((1 << (8 * n)) - 1))


def code_lengths(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, val): code length of each gram's last byte after the bytes before it, -log10 of its probability in units of 1 / _UNIT.

    counts: (gram, n), grams of order + 1 bytes with their numbers in training texts, 0 where only scored.
    Escapes by method D (half a count for each kind of byte seen) with full exclusion; a context that was never seen costs nothing; under order 0 all
    bytes that are left are equally likely.
    """
    log = lambda a, b: F.log10(a / b)
    level = {order: counts.where("n > 0")}  # depth k + 1 of the trie: grams of a context of k bytes and a byte
    for k in range(order - 1, -1, -1):
        level[k] = stored(level[k + 1].groupBy(_low("gram", k + 1).alias("gram")).agg(F.sum("n").alias("n")), integers=True)
    small = lambda df, k: F.broadcast(df) if k <= _SHORT else df

    def contexts(k: int) -> DataFrame:
        """(context, total, kinds, out) of the contexts of k bytes; out: what their children weigh one order down."""
        below = level[k].withColumn("_m", F.lit(0))
        if k:
            short = level[k - 1].select(F.col("gram").alias("_s"), F.col("n").alias("_m"))
            below = level[k].join(small(short, k), _low("gram", k) == F.col("_s"))  # short: contexts of k bytes
        return below.groupBy(F.shiftrightunsigned("gram", 8).alias("context")).agg(F.sum("n").alias("total"), F.count("*").alias("kinds"), F.sum("_m").alias("out"))

    longest = stored(contexts(order), integers=True)
    known = counts.where("n > 0").join(longest, F.shiftrightunsigned("gram", 8) == F.col("context"))
    known = known.select("gram", log(F.col("n") - 0.5, F.col("total")).alias("val"))
    # the others go down the orders; gone, gone_kinds: weight and number of the bytes excluded at this order
    s = counts.where("n = 0").select("gram", F.lit(0.0).alias("val"), F.lit(False).alias("found"), F.lit(0).cast("long").alias("gone"), F.lit(0).cast("long").alias("gone_kinds"))
    for k in range(order, -1, -1):
        c = longest if k == order else contexts(k)
        s = s.join(small(c, k), F.shiftrightunsigned(_low("gram", k + 1), 8) == F.col("context"), "left")
        hit = F.lit(False)
        if k < order:
            n = level[k].select(F.col("gram").alias("_g"), F.col("n").alias("_n"))
            s = s.join(small(n, k + 1), _low("gram", k + 1) == F.col("_g"), "left")
            hit = F.col("_n").isNotNull()
        seen, mass, kinds = F.col("total").isNotNull(), F.col("total") - F.col("gone"), F.col("kinds") - F.col("gone_kinds")
        step = F.when(hit, log(F.col("_n") - 0.5, mass)) if k < order else F.when(F.lit(False), 0.0)
        step = step.when(seen & (kinds > 0), log(kinds / 2, mass)).otherwise(0.0)
        s = s.select(
            "gram", F.when(F.col("found"), F.col("val")).otherwise(F.col("val") + step).alias("val"), (F.col("found") | hit).alias("found"),
            F.coalesce("out", F.lit(0)).alias("gone"), F.coalesce("kinds", F.lit(0)).alias("gone_kinds"),
        )
    s = s.select("gram", F.when(F.col("found"), F.col("val")).otherwise(F.col("val") - F.log10(F.lit(_SYMBOLS) - F.col("gone_kinds"))).alias("val"))
    return known.union(s).select("gram", F.round(F.col("val") * -_UNIT).cast("long").alias("val"))


def _score_block(docs: pd.DataFrame, keys: pd.DataFrame, total: int) -> pd.DataFrame:
    """Scores of a block's texts. keys: (key, val), a word's number in training texts or a gram's code length; total: what word counts are shares of.

    Places are sorted by what stands there, so that values are met in order and not looked up one by one; a place's text goes along in the lowest bits.
    """
    if not len(docs):
        return pd.DataFrame({"id": [], "train": [], "times": [], "n_tokens": [], "n_known": [], "base_score": [], "score": []})
    release_memory()
    texts = _unpacked(docs)
    order = np.argsort(keys["key"].to_numpy(np.int64))
    key, val = keys["key"].to_numpy(np.int64)[order], keys["val"].to_numpy(np.int64)[order]
    first = np.searchsorted(key, _WORD_FLAG)
    gram, length, word, count = key[:first].astype(np.uint64), val[:first].astype(float), key[first:], val[first:]
    share = np.log10((count + 1) / total)
    end = np.searchsorted(word, _END_KEY)
    n_tokens, n_known, base_score, score = (np.zeros(len(texts), t) for t in (np.int64, np.int64, float, float))
    for at, chunk in _chunks(texts):
        own, m = slice(at, at + len(chunk)), len(chunk)
        k, of = _words(chunk)
        distinct, same = np.unique(k, return_inverse=True)
        place = np.searchsorted(word, distinct)
        n_tokens[own] = np.bincount(of, minlength=m) + 1
        n_known[own] = np.bincount(of, (count[place] > 0)[same], minlength=m) + (count[end] > 0)
        base_score[own] = np.bincount(of, share[place][same], minlength=m) + share[end]
        g, starts = _grams(chunk, ORDER)
        g = (g << np.uint64(16)) | np.repeat(np.arange(m, dtype=np.uint64), np.diff(np.append(starts, len(g))))
        g.sort()
        of, g = (g & np.uint64(0xFFFF)).astype(np.int64), g >> np.uint64(16)
        new = np.r_[True, g[1:] != g[:-1]]
        score[own] = np.bincount(of, length[np.searchsorted(gram, g[new])][np.cumsum(new) - 1], minlength=m) / -_UNIT
    return pd.DataFrame({"id": docs["id"], "train": docs["train"], "times": docs["times"], "n_tokens": n_tokens, "n_known": n_known, "base_score": base_score, "score": score})


def score_documents(docs: DataFrame, train_col: str, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, train, n_tokens, n_known, train_tokens, base_score, score), a row for each row of docs; other columns are not looked at.

    score: log10 probability of the whole text and its end under a model of order ORDER that has learnt all rows
    where train_col is true. base_score: under word counts with add-one smoothing. Null texts are empty, a null train_col is false.
    Repeated rows stay and count each time. Without training rows, all bytes are equally likely.
    """
    rows = docs.select(quoted(id_col).alias("id"), F.coalesce(quoted(train_col), F.lit(False)).alias("train"), quoted(text_col).alias("text"))
    key = F.xxhash64("id", "train", "text")
    sizes = rows.groupBy(key.alias("key")).agg(F.count("*").alias("n"))  # many rows of one key are one block's otherwise
    hot = sizes.where(F.col("n") > COPIES).select("key").checkpoint()
    once, maybe = split_by_bloom(rows.withColumn("key", key), "key", hot, beside=("text", _packed, "binary"))
    some = maybe.groupBy("id", "train", "text").agg(F.count("*").alias("times"))
    size, count = rows.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*")).first()  # with the copies: blocks are rather too small than too large
    blocks = max(size // block_bytes, count // block_rows) + 1
    block = F.pmod(F.xxhash64("id", "text"), F.lit(int(blocks))).cast("int").alias("block")
    pack = F.pandas_udf(lambda texts: _packed(texts), "binary", F.PandasUDFType.SCALAR)
    rows = once.select("id", "train", F.lit(1).cast("long").alias("times"), block, F.col("_beside").alias("packed"))
    rows = rows.union(some.select("id", "train", "times", block, pack("text").alias("packed")))
    keys = stored(rows.groupBy("block").applyInPandas(_block_keys, "block int, key long, n long"), integers=True)
    counts = stored(keys.groupBy("key").agg(F.sum("n").alias("n")), integers=True)
    words = counts.where(F.col("key") >= _WORD_FLAG)
    tokens, vocab = words.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    grams = code_lengths(counts.where(F.col("key") < _WORD_FLAG).select(F.col("key").alias("gram"), "n"))
    vals = words.select("key", F.col("n").alias("val")).union(grams)
    back = keys.select("block", "key").join(vals, "key").select("block", "key", "val")
    out = rows.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(
        lambda d, k: _score_block(d, k, tokens + vocab + 1), f"id {dict(rows.dtypes)['id']}, train boolean, times long, n_tokens long, n_known long, base_score double, score double")
    out = out.withColumn("nth", F.explode(F.expr("sequence(1L, times)")))
    return out.select(F.col("id").alias(id_col), "train", "n_tokens", "n_known", F.lit(tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op1(spark, sf_dir):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), a row for each row of documents, repeated rows included.

    Null and empty texts are their end alone; rows with a null doc_id are learnt from.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.coalesce(crc_mod("doc_id", 7) != 2, F.lit(True)).alias("train"))
    return score_documents(docs, "train").select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
