"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, quoted, table, with_fields

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
#: Languages scored at a time: the matrix, 128 KB a language, is broadcast in slices of so many, however many there are.
SLICE = 8
_CHUNK = 1 << 20  # code points at a time


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.frombuffer(bytes(chr(c).isalpha() for c in range(0x110000)), np.bool_)


def _code_points(text: str) -> np.ndarray:
    """Lower-cased letters; everything else is a blank. A blank at both ends."""
    c = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "replace"), np.uint32)
    return np.where(_letters()[c], c, np.uint32(32))


def buckets(cps: np.ndarray, n: int) -> np.ndarray:
    """Hash bucket of the n-gram that starts at each place."""
    h = cps[: len(cps) - n + 1].astype(np.uint64)
    for i in range(1, n):
        h = h * np.uint64(0x110000) + cps[i : len(cps) - n + 1 + i]
    h = (h + np.uint64(n)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(64 - 15)).astype(np.int64)


def _grams(cps: list[np.ndarray], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that start at each place of the texts laid end to end, and the texts' starts.

    Places whose n-gram would cross the end of its text have bucket BUCKETS.
    """
    ends = np.cumsum([len(c) for c in cps])
    b = buckets(np.concatenate([*cps, np.full(n - 1, 32, np.uint32)]), n)
    for i in range(1, n):
        b[ends - i] = BUCKETS
    return b, ends - [len(c) for c in cps]


def _count(batches):
    """(lang, bucket, n) summed over a partition; bucket -1 counts documents."""
    total: dict[str, np.ndarray] = {}
    docs: dict[str, int] = {}
    for pdf in batches:
        for lang, group in pdf.groupby("lang"):
            got = total.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            docs[lang] = docs.get(lang, 0) + len(group)
            cps, size = [], 0
            for t in [*group["text"], None]:
                if t:
                    cps.append(_code_points(t))
                    size += len(cps[-1])
                if cps and (size > _CHUNK or t is None):
                    for n in ORDERS:
                        got += np.bincount(_grams(cps, n)[0], minlength=BUCKETS + 1)
                    cps, size = [], 0
    for lang, got in total.items():
        k = np.flatnonzero(got[:BUCKETS])
        yield pd.DataFrame({"lang": lang, "bucket": np.r_[-1, k].astype(np.int32), "n": np.r_[docs[lang], got[k]]})


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    """A language's log probabilities with add-one smoothing, BUCKETS of them, as one row."""
    counts, k = np.ones(BUCKETS), pdf["bucket"].to_numpy() >= 0
    counts[pdf["bucket"].to_numpy()[k]] += pdf["n"].to_numpy()[k]
    logp = np.log(counts / counts.sum()).astype(np.float32)
    return pd.DataFrame({"lang": pdf["lang"].iloc[:1], "docs": int(pdf["n"].to_numpy()[~k].sum()), "logp": [logp.tobytes()]})


class Model:
    """langs, slices of the matrix of log probabilities (a row for each bucket and one of zeros, SLICE languages at most), and the prior by documents."""

    def __init__(self, langs: list[str], logp: list[bytes], docs: np.ndarray):
        self.langs, self.slices = langs, []
        for k in range(0, len(langs), SLICE):
            part = np.array([np.frombuffer(x, np.float32) for x in logp[k : k + SLICE]])
            self.slices.append(np.ascontiguousarray(np.pad(part, ((0, 0), (0, 1))).T))
        if langs:
            self.prior = np.log(docs / docs.sum())


def train(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Counts over all rows with a language; null and empty texts count as documents only, repeated rows each time. The driver gets 128 KB a language."""
    rows = docs.select(quoted(text_col).alias("text"), quoted(lang_col).alias("lang")).where("lang is not null")
    sums = rows.mapInPandas(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    got = sums.groupBy("lang").applyInPandas(_pack, "lang string, docs long, logp binary").toArrow().to_pydict()
    order = sorted(range(len(got["lang"])), key=got["lang"].__getitem__)
    return Model([got["lang"][i] for i in order], [got["logp"][i] for i in order], np.array([float(got["docs"][i]) for i in order]))


def predict_texts(model: Model, texts) -> tuple[list[str], np.ndarray]:
    """Language and score of each text; 'und' and 0 without a letter or without a model."""
    out, score = ["und"] * len(texts), np.zeros(len(texts))
    if not model.langs:
        return out, score
    todo: list[tuple[int, np.ndarray]] = []

    def flush():
        if not todo:
            return
        cps = [c for _, c in todo]
        lens = np.array([len(c) for c in cps])
        total, grams = np.zeros((len(todo), len(model.langs))), np.zeros(len(todo))
        for n in ORDERS:
            b, starts = _grams(cps, n)
            for k, logp in enumerate(model.slices):
                total[:, k * SLICE : (k + 1) * SLICE] += np.add.reduceat(logp[b], starts, axis=0)
            grams += np.maximum(lens - n + 1, 0)
        total += model.prior
        best = total.argmax(1)
        # the posterior of a naive model is near 0 or 1 on long texts; it is taken for a text of 64 n-grams at most
        z = (total - total.max(1, keepdims=True)) * (np.minimum(grams, 64) / grams)[:, None]
        p = 1 / np.exp(z).sum(1)
        for (i, _), k, q in zip(todo, best, p, strict=True):
            out[i], score[i] = model.langs[k], q
        todo.clear()

    size = 0
    for i, t in enumerate(texts):
        if not t:
            continue
        c = _code_points(t)
        if (c == 32).all():
            continue
        todo.append((i, c))
        size += len(c)
        if size > _CHUNK:
            flush()
            size = 0
    flush()
    return out, score


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with `lang_pred` and `score`, in place of columns of these names; a row for each row.

    Null, empty and letterless texts: 'und', 0. Only the text is looked at, the whole of it; of equal languages the first in order of names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        lang, score = predict_texts(shared.value, texts.tolist())
        return pd.DataFrame({"lang_pred": lang, "score": score})

    return with_fields(docs, run(quoted(text_col)), ["lang_pred", "score"])


def op5(spark, sf_dir):
    """(doc_id, held_out, lang_pred, score), a row for each row of documents; rows with a null doc_id are learnt from. Cases as in identify()."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.coalesce(crc_mod("doc_id", 5) == 0, F.lit(False)))
    model = train(docs.where("not held_out"))
    return identify(docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
