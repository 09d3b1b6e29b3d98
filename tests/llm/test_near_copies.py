import random

import pytest
from pyspark.sql import functions as F

from logloom.llm import simhash


def _jaccard(a, b):
    a, b = (set(simhash._shingle_hashes(t.encode(), 5).tolist()) for t in (a, b))
    return len(a & b) / max(1, len(a | b))


def test_near_copies_are_dropped(spark):
    """Copies with a few words changed go, short and long; before, three of four stayed."""
    r = random.Random(3)
    texts = {}
    for i, (n, changed) in enumerate([(100, 1), (100, 2), (300, 5), (60, 1), (1000, 20)] * 20):
        w = [f"w{r.randrange(3000)}" for _ in range(n)]
        texts[2 * i] = " ".join(w)
        for at in r.sample(range(n), changed):
            w[at] = f"x{r.randrange(3000)}"
        texts[2 * i + 1] = " ".join(w)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = {r[0] for r in simhash.drop_near_duplicates(docs, words=5, similarity=0.8).select("doc_id").collect()}
    alike = {i + 1 for i in range(0, len(texts), 2) if _jaccard(texts[i], texts[i + 1]) >= 0.8}
    assert len(alike) > 50 and kept == set(texts) - alike


@pytest.mark.parametrize("tile, keys", [(300, None), (2_000_000, None), (2_000_000, 7)])
def test_similar_groups_in_tiles(spark, monkeypatch, tile, keys):
    """Chains, exact copies and buckets that are cut in tiles give the components of all similar pairs, and so do texts most of which have another one's hash."""
    monkeypatch.setattr(simhash, "_SETS", tile)
    if keys:
        monkeypatch.setattr(simhash, "text_key", lambda text: F.pmod(F.xxhash64(text), F.lit(keys)).cast("long"))
    r = random.Random(5)
    texts = []
    for _ in range(6):
        w = [f"w{r.randrange(500)}" for _ in range(120)]
        for _ in range(12):
            texts.append(" ".join(w))
            w[r.randrange(120)] = f"y{r.randrange(500)}"
    texts += texts[:5] + ["", "  ", None, "two words", "Two  words"]
    low = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            a, b = texts[i] or "", texts[j] or ""
            if _jaccard(a, b) >= 0.8 or not (a.split() or b.split()):
                low = [min(low[i], low[j]) if x in (low[i], low[j]) else x for x in low]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = dict(simhash.near_duplicates(docs, words=5, similarity=0.8).select("doc_id", "component_id").collect())
    assert [got[i] for i in range(len(texts))] == low


def test_texts_with_a_common_line_stay(spark):
    """Different texts that repeat the same line have close fingerprints; before, all but one of a line were dropped."""
    r = random.Random(9)
    rows = []
    for line in range(4):
        common = " ".join(f"c{r.randrange(3000)}" for _ in range(11))
        for _ in range(10):
            rows.append((len(rows), " ".join(f"w{r.randrange(3000)}" for _ in range(100)) + " " + " ".join([common] * r.randint(40, 300))))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert simhash.drop_near_duplicates(docs, words=5).count() < 20  # by fingerprints alone
    assert simhash.drop_near_duplicates(docs, words=5, similarity=0.8).count() == len(rows)
