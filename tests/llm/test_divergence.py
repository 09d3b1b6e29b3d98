"""Source divergence audit: bytes against a regular expression, sums against plain integers."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import xxhash

from logloom.llm import divergence
from logloom.llm.common import slice_hashes
from tests.llm.conftest import DOCS

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, top=200):
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source, _ in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = [t.translate(UPPER) for t in TERM.findall(text or "")]
        count[lang, source].update(found)
        docs[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= 3]
        sources = sorted(s for x, s in groups if x == lang)
        n = {s: sum(count[lang, s][t] for t in kept) for s in sources}
        total = Counter({t: sum(count[lang, s][t] for s in sources) for t in kept})
        part = lambda c, n: 1 + 1000000000 * (c + 1) // (n + len(kept))
        p = {s: {t: part(count[lang, s][t], n[s]) for t in kept} for s in sources}
        q = {t: part(total[t], sum(n.values())) for t in kept}
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(o, sum(f(p[s][t], p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if count[lang, s][t] and p[s][t] > q[t]]
            for name, items, most in (("pair", pairs, None), ("term", terms, top)):
                items.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, name, item, v, k + 1) for k, (item, v) in enumerate(items[:most])]
    return sorted(out)


def got(df):
    return sorted(map(tuple, df.select("lang", "source", "part", "item", "value", "rank").collect()))


def corpus(seed, n, sources):
    r = random.Random(seed)
    words = ["The", "the", "ÉTÉ", "été", "naïve", "x", "zebra", "你好", "\U0001F600", "don't", "a1b", "K", "ß"] + [f"w{chr(97 + i)}{chr(97 + j)}" for i in range(9) for j in range(9)]
    text = lambda: " ".join(r.choice(words[: r.choice([5, 20, 94])]) for _ in range(r.randrange(40)))
    return [(i, text(), r.choice(["en", "fr"]), f"s{r.randrange(sources)}", 1) for i in range(n)]


def test_odd_rows(spark, odd_docs, odd_rows):
    assert got(divergence.audit(odd_docs)) == plain(odd_rows)


def test_blocks_and_tiles(spark):
    """Many small blocks and tiles give what one task gives, sources without a kept term and languages without any included."""
    rows = corpus(1, 160, 9) + [(900, "once", "fr", "lonely", 1), (901, None, "xx", "a", 1), (902, "alone", "xx", "b", 1), (903, "", None, None, 1)]
    df = spark.createDataFrame(rows, DOCS).repartition(3)
    want = plain(rows)
    assert got(divergence.audit(df, block=15, tile=4)) == want
    assert got(divergence.audit(df, block=15, tile=1)) == want
    assert got(divergence.audit(df)) == want
    assert got(divergence.audit(df, top=3)) == plain(rows, top=3)


def test_many_terms_are_cut_at_200(spark):
    """Terms of a rank beyond 200 go, those of equal value by their bytes; blocks of their own change nothing."""
    words = [f"q{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(260)]
    rows = [(i, " ".join(words), "en", "all", 1) for i in range(3)] + [(10, "qaa other", "en", "few", 1)]
    want = plain(rows)
    assert sum(r[1] == "all" and r[2] == "term" for r in want) == 200
    df = spark.createDataFrame(rows, DOCS)
    assert got(divergence.audit(df)) == want == got(divergence.audit(df, block=40))


def test_no_documents(spark, no_docs):
    assert got(divergence.audit(no_docs)) == []


def test_boundaries_keep_texts_apart():
    texts = ["abc", "def ghi", "", "é", "É!", "", "z"]
    data = "".join(texts).encode()
    ends = np.cumsum([len(t.encode()) for t in texts])
    buf = divergence.LOWER[np.frombuffer(data, np.uint8)]
    start, end = divergence.boundaries(buf, ends)
    assert [buf[a:b].tobytes().decode() for a, b in zip(start, end, strict=True)] == ["abc", "def", "ghi", "é", "É", "z"]


def slices(words):
    data = b" ".join(words)
    buf = np.frombuffer(data, np.uint8)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    return data, buf, end - np.array([len(w) for w in words]), end


def test_hashes_are_those_of_the_library():
    r = random.Random(9)
    words = [bytes(r.randrange(97, 123) for _ in range(n)) for n in [*range(1, 70), 500, *range(1, 40)]] + ["é你\U0001F600".encode()]
    assert slice_hashes(*slices(words)).tolist() == [xxhash.xxh64_intdigest(w) for w in words]


def test_equal_hashes_of_unlike_slices():
    """A hash that says little: the bytes tell slices apart, short and long, of equal length and with equal beginnings."""
    words = b"aa bb aa c aa bb dd c bb abcdefgh abcdefghi abcdefgj abcdefghijklmnopq abcdefghijklmnopr abcdefghijklmnopq".split()
    words += [b"x" * 32, b"x" * 31, b"x" * 31 + b"y", b"x" * 30 + b"y", b"x" * 32, b"x" * 90, b"x" * 89 + b"y", b"x" * 90]
    for digest in (lambda *a: np.zeros(len(a[2]), np.uint64), lambda d, b, s, e: (e - s).astype(np.uint64), lambda d, b, s, e: b[s].astype(np.uint64)):
        data, buf, start, end = slices(words)
        group, rep = divergence.group_slices(data, buf, start, end, digest)
        assert [data[start[rep[g]] : end[rep[g]]] for g in group] == words
        assert len(set(group.tolist())) == len(set(words)) == len(set(rep.tolist()))


def test_share_is_exact_beyond_64_bits():
    for count, n in ((0, 1), (5, 7), (10**11, 3 * 10**12), (8 * 10**16, 9 * 10**16), (10**9, 10**9 + 1)):
        assert int(divergence.share(np.array([count]), n)[0]) == 1 + 10**9 * (count + 1) // n


def test_chunks_of_sliced_batches(monkeypatch):
    """Texts are cut into chunks, batches begin within their buffers: counts stay."""
    rows = corpus(4, 60, 2)
    batch = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in (2, 3, 1)], ["lang", "source", "text"])
    want = Counter()
    for _, text, lang, source, _ in rows[7:50]:
        want.update((lang, source, t.translate(UPPER)) for t in TERM.findall(text))
    for size in (1, 200, 1 << 20):
        monkeypatch.setattr(divergence, "CHUNK", size)
        found = Counter()
        for b in divergence.count_terms(iter([batch.slice(7, 43)])):
            for r in b.to_pylist():
                found[r["lang"], r["source"], r["term"]] += r["count"]
        assert found == want
