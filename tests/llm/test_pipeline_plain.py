"""The pipeline's stages against plain versions of them, a document at a time."""

import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from logloom.llm import pii, toxicity

from .conftest import DOCS, prose
from .test_text_operators import plain_containment, plain_spans

TERM = re.compile(r"[^\W\d_]{3,}")


def plain_terms(texts, smoothing=2.0, residual_bits=1.0, gained_bits=3.0, window=6):
    """Terms that disclose an entity, from all different texts."""
    texts, near, entity = {t for t in texts if t is not None}, defaultdict(set), defaultdict(set)
    spelled = set()
    for t in texts:
        spans = plain_spans(t)
        words = [m for m in TERM.finditer(t)]
        free = lambda m, spans=spans: all(m.end() <= s or m.start() >= e for s, e, _ in spans)
        for s, e, kind in spans:
            value = t[s:e].lower() if kind == "email" else t[s:e] if kind == "ip" else re.sub("[^0-9]", "", t[s:e])
            names = {f"{kind}:{value}": TERM.findall(value.split("@")[0]) if kind == "email" else []}
            if kind == "email":
                names["domain:" + value.split("@", 1)[1]] = []
            if kind == "ip":
                names["net:" + value.rsplit(".", 1)[0]] = []
            beside = [m for m in words if m.end() <= s][-window:] + [m for m in words if m.start() >= e][:window]
            for name, spells in names.items():
                entity[name].add(t)
                for m in beside:
                    if free(m):
                        near[name, m[0].lower()].add(t)
                        if m[0].lower() in spells:
                            spelled.add((name, m[0].lower()))
    total = len([t for t in texts if t])
    of_term = Counter(w for t in texts for w in {m[0].lower() for m in TERM.finditer(t)})
    out = set()
    for (name, w), held in near.items():
        more = 0.0 if (name, w) in spelled else smoothing
        if len(held) < 2 and (name, w) not in spelled:
            continue
        prior = len(entity[name]) / total
        residual = -math.log2(min(1.0, (len(held) + more * prior) / (of_term[w] + more)))
        if residual <= residual_bits and math.log2(min(1.0, len(held) / of_term[w]) / prior) >= gained_bits:
            out.add(w)
    return out


def plain_sanitised(t, terms):
    if t is None:
        return None
    spans = [*plain_spans(t)]
    base = [(s, e) for s, e, _ in spans]
    spans += [(*m.span(), "term") for m in TERM.finditer(t) if m[0].lower() in terms and all(m.end() <= s or m.start() >= e for s, e in base)]
    out, at = "", 0
    for s, e, k in sorted(spans):
        if e > at:
            out += t[at : max(s, at)] + (pii.GENERAL[k] if s >= at else "")
            at = e
    return out + t[at:]


def private_texts(r):
    people = {"zarquon": ("zarquon.v@quon.example.org", None), "trillian": ("t1@astra.example.net", "4692819832630923"), "marvin": ("m@sirius.example.com", "10.20.30.4")}
    out = [prose(r, 40) for _ in range(60)]
    for name, (mail, other) in people.items():
        for k in range(r.randint(1, 5)):
            out.append(f"{prose(r, r.randint(0, 12))} {name.title()} at {mail} {prose(r, 3)} {other or ''} {prose(r, r.randint(0, 9))}")
        out.append(f"{prose(r, 5)} {name} again")
    far = f"{name.title()} " + "1234 " * 200 + "+49 30 1234567"  # more than 400 characters, no word between
    out += [f"{prose(r, 20)} Hooloovoo {'.' * 700} 192.168.7.{i} {prose(r, 9)}" for i in range(4)] + [far]
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_disclosure_against_plain(spark, seed):
    import random

    texts = private_texts(random.Random(seed))
    texts += texts[60:66] * 40 + [None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = plain_terms(texts)
    assert {r[0] for r in pii.disclosing_terms(docs).collect()} == want and "hooloovoo" in want
    got = dict(pii.sanitise(docs).select("doc_id", "text").collect())
    assert got == {i: plain_sanitised(t, want) for i, t in enumerate(texts)}


def plain_toxic_score(model, t):
    """The classifier's score, from the text's words one by one."""
    words = re.findall(r"[^\W\d_]+", (t or "").lower())
    z = float(model.weights[-1])
    for i, term in enumerate(model.lexicon):
        k, eq, start = term.partition("=")
        n = sum(w.startswith(start) and len(w) > int(k) for w in words) if eq else words.count(term)
        if n:
            z += model.weights[i] * min(math.log1p(n), 2.5) + model.weights[len(model.lexicon) + i] * min(100 * n / max(len(words), 10), 3.0)
    for j, p in enumerate(toxicity.PATTERNS.values()):
        z += model.weights[2 * len(model.lexicon) + j] * min(len(p.findall(t or "")) * 1000 / max(len(t or ""), 200) / toxicity._DENSE, 3.0)
    return 1 / (1 + math.exp(-min(max(z, -30), 30)))


def plain_groups(texts, similarity=0.8):
    """The smallest id of each text's group by the sets of five-word shingles."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    sets, low = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    for i in texts:
        for j in texts:
            a, b = sets[i], sets[j]
            if i < j and (len(a & b) / len(a | b) >= similarity if a | b else True):
                x, y = low[i], low[j]
                low = {k: min(x, y) if v in (x, y) else v for k, v in low.items()}
    return low


def test_pipeline_against_plain(spark, rng, tmp_path):
    import corpus_pipeline

    sentencepiece = pytest.importorskip("sentencepiece")
    from logloom.llm import pieces

    items = [(i, prose(rng, n)) for i, n in enumerate((25, 40, 60))]
    texts = [prose(rng, rng.randint(20, 90)) for _ in range(60)] + private_texts(rng)
    for i in range(12):  # near copies, some above and some below the similarity
        w = texts[i].split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"new{i}"
        texts.append(" ".join(w))
    texts += texts[:4] + [f"{prose(rng, 30)} {t} {prose(rng, 30)}" for _, t in items] + ["", None, "  ", "two words"]
    texts += [" ".join(x for w in prose(rng, 40).split() for x in (w, rng.choice(["idiot", "moron", "scum"]))) for _ in range(16)]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    toxic = set(range(len(rows) - 16, len(rows)))
    spark.createDataFrame(rows, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    labels = spark.createDataFrame([(i, 1, int(i in toxic)) for i, *_ in rows if i % 3], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))

    model = toxicity.train(spark.read.parquet(str(tmp_path / "documents.parquet")), labels)
    left = {i: t for i, t, *_ in rows if plain_toxic_score(model, t) < toxicity.THRESHOLD}
    assert left.keys() == {i for i, *_ in rows} - toxic
    low = plain_groups(left)
    left = {i: t for i, t in left.items() if low[i] == i}
    held = {i for i, _ in plain_containment(left.items(), items)}
    left = {i: t for i, t in left.items() if i not in held}
    terms = plain_terms(left.values())
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    want = {i: lib.encode(plain_sanitised(t, terms) or "") for i, t in left.items()}

    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert held and len(low) - len(set(low.values())) > 6 and got.keys() == want.keys()
    assert got == want
