"""Toxicity by weak supervision.

Many voters each vote toxic, clean, or not at all: words and word beginnings that labelled rows show to go with toxicity, fixed words
of abuse and patterns of writing vote toxic where they stand; a group of them of which a text has none votes clean; and a row's label is one more
voter, as fallible as the others. A generative model of the votes estimates by expectation maximisation, from the votes
alone, how often each voter votes what in either class and, from what the votes share beyond the classes, the voters' correlations,
by which their votes are discounted. Its posterior labels, not the labels, train a linear classifier.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, quoted, release_memory, stored, table

#: Labelled rows that the voters, the label model and the classifier are fitted on: at most so many, those of the smallest hashes.
SAMPLE = 20_000
LEXICON = 512  # terms that the classifier weighs
VOTERS = 160  # of them, the most telling are voters
MIN_TOXIC = 5  # toxic rows that must have a term
GROUPS = 4  # of voting terms; each votes clean where a text has none of it
THRESHOLD = 0.7
PREFIXES = (4, 5, 6, 7)

#: Words of abuse that are voters whatever the labels show.
ABUSE = (
    "bastard", "clown", "cretin", "disgusting", "dumb", "filthy", "fool", "idiot", "imbecile", "jerk",
    "loser", "moron", "pathetic", "pig", "scum", "shut up", "stupid", "trash", "ugly", "vermin", "worthless",
)
_WORD = re.compile(r"[^\W\d_]+")
#: Patterns of writing, each a voter by its number in a text for each 1000 characters.
PATTERNS = {
    "second person insult": re.compile(r"(?i)\byou(?:'re| are)? (?:a |an |such )?(?:" + "|".join(ABUSE) + r")\b"),
    "censored word": re.compile(r"\b[A-Za-z]\*{2,}[a-z]*"),
    "run of marks": re.compile(r"[!?]{3,}"),
}
_DENSE = 3.0  # pattern matches for each 1000 characters that make a vote


def _terms(text: str) -> tuple[Counter, int]:
    """Occurrences of each word, and under '=' and its length of each word beginning; the number of words."""
    words = Counter(_WORD.findall(text.lower()))
    out = Counter()
    for w, n in words.items():
        out[w] += n
        for k in PREFIXES:
            if len(w) > k:
                out[f"{k}={w[:k]}"] += n
    return out, sum(words.values())


def _count(batches):
    for pdf in batches:
        rows: dict[str, list[int]] = {}
        for t, y in zip(pdf["text"], pdf["toxic"], strict=True):
            if t:
                for term in _terms(t)[0]:
                    rows.setdefault(term, [0, 0])[y] += 1
        yield pd.DataFrame({"term": pd.Series([*rows], dtype=object), "clean": pd.Series([r[0] for r in rows.values()], dtype="int64"), "toxic": pd.Series([r[1] for r in rows.values()], dtype="int64")})


class _Features:
    """A text's values for each term of the lexicon (its number of occurrences, dampened, and whether it is dense) and each pattern."""

    def __init__(self, lexicon: list[str]):
        self.at = {t: i for i, t in enumerate(lexicon)}
        self.size = 2 * len(lexicon) + len(PATTERNS) + 1
        self.memo: dict[str, tuple[int, ...]] = {}

    def _ids(self, w: str) -> tuple[int, ...]:
        if w not in self.memo:
            if len(self.memo) > 100_000:
                self.memo.clear()
            self.memo[w] = tuple(self.at[t] for t in (w, *(f"{k}={w[:k]}" for k in PREFIXES if len(w) > k)) if t in self.at)
        return self.memo[w]

    def of(self, text: str | None) -> np.ndarray:
        x, k = np.zeros(self.size, np.float32), len(self.at)
        x[-1] = 1
        if text:
            words = _WORD.findall(text.lower())
            for w in words:
                for i in self._ids(w):
                    x[i] += 1
            n = x[:k].copy()
            hit = np.flatnonzero(n)
            x[hit] = np.minimum(np.log1p(n[hit]), 2.5)
            x[k + hit] = np.minimum(100 * n[hit] / max(len(words), 10), 3.0)
            for j, p in enumerate(PATTERNS.values()):
                x[2 * k + j] = min(sum(1 for _ in p.finditer(text)) * 1000 / max(len(text), 200) / _DENSE, 3.0)
        return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


class LabelModel:
    """Rates of each voter's votes in either class, the prior, and how far the voters say the same thing.

    rates: (class, vote + 1, voter); hit, false: rates of toxic votes in toxic and in clean rows.
    """

    def fit(self, votes: np.ndarray, start: np.ndarray, rounds: int = 50):
        """votes (rows, voters) of -1 (clean), 0 (none) and 1 (toxic); start: first guess of P(toxic) of each row."""
        v, post = votes.astype(np.float32), np.asarray(start, float)
        yes, no = (v > 0).astype(np.float32), (v < 0).astype(np.float32)
        # one row that votes as all rows together do stands for what is not known of a class, so that a voter who never speaks says nothing
        all_ = np.stack([no.sum(0), (v == 0).sum(0), yes.sum(0)]).astype(float) + 1e-3
        all_ /= all_.sum(0)
        for _ in range(rounds):
            w = np.stack([1 - post, post])
            n, clean, toxic = w.sum(1)[:, None], w @ no, w @ yes
            self.rates = (np.stack([clean, n - clean - toxic, toxic], 1) + all_) / (n + 1)[:, None]
            self.prior = float(np.clip(post.mean(), 1e-3, 0.999))
            # correlations: what votes share beyond what the likelier classes explain
            h = np.stack([post < 0.5, post >= 0.5]).astype(np.float32)
            res = v - h.T @ (h @ v / np.maximum(h.sum(1), 1)[:, None])
            sd = np.sqrt((res**2).mean(0)) + 1e-3
            self.correlation = res.T @ res / len(v) / np.outer(sd, sd)
            self.discount = 1 / np.maximum(np.where(self.correlation > 0.1, self.correlation, 0).sum(1), 1)  # a voter's own is 1
            new = self.posterior(v)
            done = np.abs(new - post).max() < 1e-4
            post = new
            if done:
                break
        self.hit, self.false = self.rates[1, 2], self.rates[0, 2]
        return self

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        clean, none, toxic = np.log(self.rates[1] / self.rates[0])
        says = none + (votes > 0) * (toxic - none) + (votes < 0) * (clean - none)
        return _sigmoid(np.log(self.prior / (1 - self.prior)) + says @ self.discount)


def _votes(x: np.ndarray, lexicon: int, voters: int, label: np.ndarray) -> np.ndarray:
    """(rows, voters) of -1, 0 and 1 from rows of feature values: terms, patterns, groups that are absent, and the label last."""
    has = x[:, :voters] * (x[:, lexicon : lexicon + voters] >= 0.1) > 0
    patterns = x[:, 2 * lexicon : 2 * lexicon + len(PATTERNS)] >= 1
    absent = np.stack([has[:, g::GROUPS].any(1) for g in range(GROUPS)], 1)
    return np.concatenate([has, patterns, absent.astype(np.int8) - 1, np.where(label > 0, 1, -1)[:, None]], axis=1).astype(np.int8)


def _distinct(top: list) -> list:
    """Without word beginnings that rows hold just as often as a word, or a longer beginning, listed with the same telling."""
    seen, out = set(), []
    for r in sorted(top, key=lambda r: (-r["telling"], -len(r["term"].partition("=")[2] or r["term"] + "~"), r["term"])):
        whole = r["term"].partition("=")[2] or r["term"]
        if not any((r["telling"], x) in seen for x in [whole]):
            out.append(r)
        seen |= {(r["telling"], whole[:k]) for k in (*PREFIXES, len(whole))}
    return out


def _fit_linear(x: np.ndarray, y: np.ndarray, l2: float = 0.3, rounds: int = 12) -> np.ndarray:
    """Logistic regression on soft labels with a ridge penalty (none on the last, constant feature), by Newton steps."""
    w = np.zeros(x.shape[1])
    ridge = np.r_[np.full(x.shape[1] - 1, l2), 1e-6]
    for _ in range(rounds):
        p = _sigmoid(x @ w)
        h = x.T @ (x * (p * (1 - p)).astype(np.float32)[:, None])
        step = np.linalg.solve(h.astype(float) + np.diag(ridge), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-3:
            break
    return w


class Model:
    def __init__(self, lexicon: list[str], weights: np.ndarray, label_model: LabelModel | None = None):
        self.lexicon, self.weights, self.label_model = lexicon, weights, label_model

    def score(self, texts) -> np.ndarray:
        f = _Features(self.lexicon)
        return np.array([float(_sigmoid(f.of(t) @ self.weights)) for t in texts])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", toxic_col: str = "toxic", sample: int = SAMPLE) -> Model:
    """Fit on at most `sample` rows: labels of the smallest hashes of their ids, each with the one text of docs that has its id.

    Labels that are null are left out; of labels that repeat an id the largest counts, of texts that repeat one that of the smallest
    hash. Null and empty texts count as texts without terms. Without toxic rows or without clean rows every text scores the prior.
    """
    known = labels.where(F.col(toxic_col).isNotNull() & F.col(label_id_col).isNotNull()).groupBy(F.col(label_id_col).alias("_id")).agg(F.max(toxic_col).cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    rows = docs.select(quoted(id_col).alias("_id"), quoted(text_col).alias("text")).join(F.broadcast(known), "_id")
    rows = rows.groupBy("_id").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text", "toxic")).alias("r"))  # a text an id, so that the bound holds
    rows = stored(rows.select("r.text", F.least(F.greatest("r.toxic", F.lit(0)), F.lit(1)).alias("toxic")))
    sums = rows.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sums}
    if not n.get(0) or not n.get(1):
        p = (n.get(1, 0) + 0.5) / (sum(n.values()) + 1)
        return Model([], np.r_[np.zeros(len(PATTERNS)), np.log(p / (1 - p))])
    counts = rows.mapInPandas(_count, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("c"), F.sum("toxic").alias("t"))
    p1, p0 = (F.col("t") + 0.5) / (n[1] + 1), (F.col("c") + 0.5) / (n[0] + 1)
    telling = (F.log(p1 / p0) * F.sqrt(F.col("t"))).alias("telling")
    top = counts.where((F.col("t") >= MIN_TOXIC) & (p1 > 2 * p0)).select("term", telling).orderBy(F.desc("telling"), "term").limit(LEXICON).collect()
    top = _distinct(top)
    lexicon = [r["term"] for r in top[:VOTERS]]
    lexicon += [w for w in ABUSE if " " not in w and w not in lexicon]
    voters = len(lexicon)
    lexicon += [r["term"] for r in top[VOTERS:] if r["term"] not in lexicon]
    size = _Features(lexicon).size

    def values(batches):
        f = _Features(lexicon)
        for pdf in batches:
            x = [f.of(t) for t in pdf["text"]]
            at = [np.flatnonzero(v) for v in x]
            yield pd.DataFrame({"toxic": pdf["toxic"], "at": at, "x": [v[i] for v, i in zip(x, at, strict=True)]})

    got = rows.mapInPandas(values, "toxic int, at array<int>, x array<float>").toArrow().to_pandas()
    x, y = np.zeros((len(got), size), np.float32), got["toxic"].to_numpy(float)
    for r, (i, v) in enumerate(zip(got["at"], got["x"], strict=True)):
        x[r, i] = v
    votes = _votes(x, len(lexicon), voters, y)
    # the label is one vote among others from the start
    start = 0.1 + 0.4 * y + 0.4 * (votes[:, : voters + len(PATTERNS)] > 0).any(1)
    model = LabelModel().fit(votes, start)
    return Model(lexicon, _fit_linear(x, model.posterior(votes)), model)


def score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with `score`, 0 to 1, in place of a column of that name. A row for each row, repeated ones included.

    Only the text is looked at, the whole of it; null and empty texts get the score of no terms.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def run(texts: pd.Series) -> pd.Series:
        release_memory()
        return pd.Series(shared.value.score(texts))

    return docs.withColumn(score_col, run(quoted(text_col)))


def op4(spark, sf_dir):
    """(doc_id, held_out, score, predicted), a row for each row of documents, learnt from labels of rows that are not held out.

    Null and empty texts are scored as texts without terms; rows with a null doc_id have no label and are not held out; repeated rows stay.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc_mod("doc_id", 3) == 1, F.lit(False))
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic").where(~held_out)
    return score(docs, train(docs, labels)).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
