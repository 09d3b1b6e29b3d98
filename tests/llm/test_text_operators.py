import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from logloom.llm import decontam, langid, pieces, pii, ppm, simhash, toxicity

from .conftest import DOCS, prose

MARK = pieces.MARK
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def low(t):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")


# -- PPM ---------------------------------------------------------------------------------------


def plain_ppm(train, text, order=ppm.ORDER):
    """PPM with method D and exclusion, a byte at a time."""
    ctx = [defaultdict(Counter) for _ in range(order + 1)]
    seq = lambda t: [0xFE] * order + list(t.encode()) + [0xFF]
    for t in train:
        s = seq(t)
        for i in range(order, len(s)):
            for k in range(order + 1):
                ctx[k][tuple(s[i - k : i])][s[i]] += 1
    s, total = seq(text), 0.0
    for i in range(order, len(s)):
        gone = set()
        for k in range(order, -1, -1):
            c = ctx[k].get(tuple(s[i - k : i]))
            if not c:
                continue
            left = {b: n for b, n in c.items() if b not in gone}
            if not left:
                continue
            mass = sum(left.values())
            if s[i] in left:
                total += math.log10((left[s[i]] - 0.5) / mass)
                break
            total += math.log10(len(left) / 2 / mass)
            gone |= set(left)
        else:
            total += -math.log10(255 - len(gone))
    return total


def test_ppm_against_plain(spark, rng):
    texts = [prose(rng, rng.randint(0, 25)) for _ in range(30)] + ["", None, "zürich 你", "Q"]
    rows = [(i, t, i % 4 != 0) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = {r["doc_id"]: r for r in ppm.score_documents(docs, "train", block_bytes=300).collect()}
    train = [t or "" for _, t, ok in rows if ok]
    counts = Counter(w for t in train for w in [*WORD.findall(low(t)), None])
    n, v = sum(counts.values()), len(counts)
    for i, t, _ in rows:
        w = [*WORD.findall(low(t)), None]
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in counts for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r["score"] == pytest.approx(plain_ppm(train, t or ""), abs=1e-6)


def test_ppm_odd(odd_docs, no_docs, odd_rows):
    got = ppm.score_documents(odd_docs.withColumn("train", F.lit(True)), "train").collect()
    assert len(got) == len(odd_rows) and all(r["score"] <= 0 for r in got)
    assert ppm.score_documents(no_docs.withColumn("train", F.lit(True)), "train").count() == 0
    untrained = ppm.score_documents(odd_docs.where("doc_id = 101").withColumn("train", F.lit(False)), "train").first()
    assert untrained["train_tokens"] == 0 and untrained["score"] == pytest.approx(-math.log10(255))


def test_ppm_of_copies_and_empty_texts(spark, rng):
    """Rows of one id and text are scored once and count each time; texts without bytes are dealt over blocks by their number."""
    texts = [prose(rng, 12) for _ in range(12)]
    rows = [(i, t, i % 3 != 0) for i, t in enumerate(texts)] + [(50, "same text here", True)] * 500 + [(51, "other text", False)] * 40 + [(None, None, True)] * 60
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    got = [(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ppm.score_documents(docs, "train").collect()]
    train = [t or "" for _, t, ok in rows if ok]
    assert Counter(x[0] for x in got) == Counter(i for i, _, _ in rows) and len(set(got)) == 15
    counts = Counter(w for t in train for w in [*WORD.findall(low(t)), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in ((50, "same text here"), (51, "other text"), (None, ""), (3, texts[3])):
        w = [*WORD.findall(low(t)), None]
        (want,) = {x for x in got if x[0] == i}
        assert want[1:4] == (len(w), sum(x in counts for x in w), n)
        assert want[4] == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), abs=1e-5) and want[5] == pytest.approx(plain_ppm(train, t), abs=1e-5)
    many = spark.range(100_000).selectExpr("id as doc_id", "cast(null as string) as text", "true as train")
    many = ppm.score_documents(many, "train", block_rows=5000).agg(F.count("*"), F.min("score"), F.max("score")).first()
    assert many[0] == 100_000 and many[1] == many[2]


# -- SimHash -----------------------------------------------------------------------------------


def plain_fingerprint(t):
    w = WORD.findall(low(t))
    if not w:
        return 0
    sh = [" ".join(w[i : i + 4]) for i in range(len(w) - 3)] or [" ".join(w)]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius):
    ids = list(fps)
    comp = {i: i for i in ids}

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                comp[y] = x
    return {i: root(i) for i in ids}


def test_simhash_against_plain(spark, rng):
    base = [prose(rng, 80) for _ in range(25)]
    texts = base + [b.replace(" ", "  ", 3) for b in base[:5]] + [" ".join([*b.split()[:-1], "changed"]) for b in base] + ["", None, " ", "one two", "One  two"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    fps = {i: plain_fingerprint(t) for i, t in enumerate(texts)}
    want = plain_components(fps, 4)
    got = simhash.near_duplicates(docs).select("doc_id", simhash.hex16(F.col("fp")).alias("f"), "component_id").collect()
    assert {r["doc_id"]: r["f"] for r in got} == {i: f"{f:016x}" for i, f in fps.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == want
    kept = {r[0] for r in simhash.drop_near_duplicates(docs).select("doc_id").collect()}
    assert kept == set(want.values())


@pytest.mark.parametrize("tile", [8, 2048])
def test_near_pairs_in_tiles(spark, rng, monkeypatch, tile):
    monkeypatch.setattr(simhash, "TILE", tile)
    seeds = [rng.getrandbits(64) for _ in range(20)]
    fps = {s for s in seeds}
    for s in seeds[:8]:
        for _ in range(25):
            x = s
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
            fps.add(x)
    want = plain_components({f: f for f in fps}, 4)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in fps], "fp long")
    pairs = [(r["a"] % 2**64, r["b"] % 2**64) for r in simhash.near_pairs(df).collect()]
    assert all((a ^ b).bit_count() <= 64 for a, b in pairs)
    got = plain_components({f: f for f in fps}, -1)
    for a, b in pairs:  # join along the links
        a, b = (next(r for r in [x] if r == x) for x in (a, b))
        ra, rb = sorted((_root(got, a), _root(got, b)))
        got[rb] = ra
    assert {f: _root(got, f) for f in fps} == want


def _root(comp, i):
    while comp[i] != i:
        i = comp[i]
    return i


def test_simhash_odd(odd_docs, no_docs, odd_rows):
    got = simhash.near_duplicates(odd_docs).collect()
    assert len(got) == len(odd_rows)
    empty = {r["component_id"] for r in got if r["doc_id"] in (100, 101, 102)}
    assert empty == {100}
    kept = simhash.drop_near_duplicates(odd_docs)
    assert kept.columns == odd_docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert ids.count(None) == 2 and 104 not in ids and ids.count(3) == 1
    assert simhash.near_duplicates(no_docs).count() == 0


# -- decontamination ---------------------------------------------------------------------------


def plain_containment(docs, items):
    out = {}
    for i, t in docs:
        w = WORD.findall(low(t))
        for j, u in items:
            v = WORD.findall(low(u))
            n = min(5, len(v))
            if not n:
                continue
            s = {tuple(v[k : k + n]) for k in range(len(v) - n + 1)}
            c = len(s & {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}) / len(s)
            if c >= 0.8:
                out[i, j] = c
    return out


def test_containment_against_plain(spark, rng):
    items = [(j, prose(rng, rng.choice([1, 3, 5, 9, 40, 120]))) for j in range(30)] + [(90, ""), (91, None), (92, "Only")]
    docs = []
    for i in range(40):
        t = prose(rng, 200).split()
        for _, u in rng.sample(items, 2):
            k = rng.randrange(len(t))
            v = (u or "").split()
            if len(v) > 60 and rng.random() < 0.5:
                v[3] = "changed"
            t[k:k] = v
        docs.append((i, " ".join(t).upper() if i % 5 == 0 else " ".join(t)))
    docs += [(50, None), (51, ""), (52, "only")]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["containment"] for r in decontam.contained(d, b).collect()}
    want = plain_containment(docs, items)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(v) for k, v in want.items()) and len(want) > 30
    left = {r[0] for r in decontam.decontaminate(d, b).select("doc_id").collect()}
    assert left == {i for i, _ in docs} - {i for i, _ in want}


def test_containment_of_repeated_ids(spark, rng):
    """Rows that repeat an item_id or a doc_id with other texts stand for themselves, in the query as in its SQL; before, item texts were merged over the larger total."""
    import duckdb

    a, b, c = (prose(rng, n) for n in (13, 24, 40))
    long = prose(rng, 44).split()
    items = [(1, a), (1, b), (None, b), (None, c), (2, c), (2, c), (3, " ".join(long))]
    docs = [(1, f"{a} and {b}"), (2, " ".join(b.split()[:13])), (3, c), (3, a), (None, b), (4, " ".join(long[:34])), (5, " ".join([*long[:40], "cut"])), (5, None)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted(map(repr, map(tuple, decontam.contained(d, i).collect())))
    con = duckdb.connect()
    for name, rows in (("documents", docs), ("benchmark", items)):
        con.execute(f"create table {name}({name[:3] == 'doc' and 'doc_id' or 'item_id'} bigint, text varchar)")
        con.executemany(f"insert into {name} values (?, ?)", rows)
    assert got == sorted(map(repr, con.execute(decontam.OP8_SQL).fetchall())) and len(got) == 8
    assert all(eval(x)[2] <= 1 for x in got)


def test_sketches_miss_nothing(spark, rng):
    """Recall of the candidate search is 1 on items of all size partitions, at the threshold itself; documents that hold none are not asked."""
    items, docs = [], []
    for j, n in enumerate([1, 2, 4, 5, 6, 7, 9, 12, 20, 33, 60, 61, 100, 130, 250, 600] * 3):
        w = [f"a{j}w{k}" for k in range(n + 4)]
        items.append((j, " ".join(w)))
        keep = -(-4 * n // 5) + 4  # words whose runs are the threshold's share
        at = rng.randrange(n + 4 - keep + 1)
        docs.append((j, f"{prose(rng, 30)} {' '.join(w[at : at + keep])} {prose(rng, 3000 if j % 5 == 0 else 30)}"))
    docs += [(1000 + i, prose(rng, 100)) for i in range(30)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shingles = decontam.item_shingles(i)
    found = {(r["doc_id"], r["item_id"]) for r in decontam.candidates(d.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text"), shingles).collect()}
    want = plain_containment(docs, items)
    assert len(want) == len(items) and want.keys() <= found and not {x for x, _ in found} & set(range(1000, 1030))
    sizes = {r["total"]: r["n"] for r in shingles.where("sketched").groupBy("item", "total").agg(F.count("*").alias("n")).collect()}
    assert sizes[1] == 1 and sizes[7] == 2 and sizes[33] == 13 and sizes[600] == 13


def test_common_shingles_ask_for_nothing(spark, rng):
    """A preamble that all items share makes no candidates of the documents that have it; items and documents that hold one are found all the same, copies of an item too."""
    preamble = "answer the following question with care and"
    body = lambda j, n: " ".join(f"b{j}x{k}" for k in range(n))
    items = [(j, f"{preamble} {body(j, 20 + j % 40)}") for j in range(300)] + [(1000 + j, preamble) for j in range(3)]
    docs = [(i, f"{prose(rng, 20)} {preamble} {prose(rng, 20)}") for i in range(300)] + [(500 + j, f"{preamble} {body(j, 20 + j % 40)} end") for j in range(0, 300, 30)]
    docs += [(900 + j, f"so {body(j, 20 + j % 40)} end") for j in (39, 79)]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    shingles = decontam.item_shingles(i).checkpoint()
    found = decontam.candidates(d.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text"), shingles).collect()
    want = plain_containment(docs, items)
    assert {(r["doc_id"], r["item_id"]) for r in found} >= want.keys() and len(found) < 1000 + len(want)
    assert {(r["doc_id"], r["item_id"]) for r in decontam.contained(d, i).collect()} == want.keys() and len(want) > 900


def test_containment_odd(spark, odd_docs, no_docs, odd_rows):
    items = spark.createDataFrame([(1, odd_rows[0][1]), (1, odd_rows[0][1]), (None, "no id here at all")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contained(odd_docs, items).collect()}
    assert {(0, 1), (None, None)} <= got
    assert decontam.decontaminate(odd_docs, items).columns == odd_docs.columns
    assert decontam.contained(no_docs, items).count() == 0
    assert decontam.contained(odd_docs, items.limit(0)).count() == 0
    assert decontam.decontaminate(odd_docs, items.limit(0)).count() == len(odd_rows)


# -- PII ---------------------------------------------------------------------------------------

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def plain_spans(t):
    digits = lambda s: [int(c) for c in s if c.isdigit()]

    def luhn(d):
        return sum(x if i % 2 == 0 else (2 * x - 9 if 2 * x > 9 else 2 * x) for i, x in enumerate(reversed(d))) % 10 == 0

    out = [(*m.span(), "email") for m in EMAIL.finditer(t)]
    out += [(*m.span(), "ip") for m in IP.finditer(t) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [(*m.span(), "card") for m in CARD.finditer(t) if 12 <= len(digits(m[0])) <= 19 and luhn(digits(m[0]))]
    out += [(*m.span(), "phone") for m in PHONE.finditer(t) if 9 <= len(digits(m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2])))


def test_base_spans_against_plain(rng):
    bits = ["a@b.co", "x.y%z@ex-1.example.org", "@", "a@", "@b.c", "a@b", "1.2.3.4", "999.1.1.1", "1.2.3.4.5.6.7.8", "0001.2.3.4", "4539 1488 0343 6467", "4539148803436467", "4111-1111-1111-1111", "123", "+1 (415) 555-0100",
            "+49 30 1234567", "+12", "+1 2", " ", " ", "é", "\n", "text", ".", "-", "9" * 30, "+", "A1", "a@b.c@d.e", "a@b@c.d"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans(None) == []


def test_disclosing_terms(spark, rng):
    rows = [(i, f"{prose(rng, 30)} Zarquon reaches zar@quon.example.org at {prose(rng, 5)}") for i in range(6)]
    rows += [(i + 10, prose(rng, 40)) for i in range(60)] + [(99, f"Ask Zarquon about it {prose(rng, 8)}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    terms = {r[0] for r in pii.disclosing_terms(docs).collect()}
    assert "zarquon" in terms and not terms & {"the", "and", "house"}
    spans = {r["doc_id"]: [(s["start"], s["end"], s["kind"]) for s in r["spans"]] for r in pii.find_pii(docs).collect()}
    assert spans[99] == [(4, 11, "term")]
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(docs).collect()}
    assert clean[99].startswith("Ask [TERM] about it") and all("quon" not in clean[i] and "[EMAIL]" in clean[i] for i in range(6))
    assert all(clean[i + 10] == rows[i + 6][1] for i in range(60))


def test_pii_odd(odd_docs, no_docs, odd_rows):
    assert pii.find_pii(odd_docs).count() == len(odd_rows)
    out = pii.sanitise(odd_docs)
    assert out.columns == odd_docs.columns and out.count() == len(odd_rows)
    assert {r["text"] for r in out.where("doc_id = 100").collect()} == {None}
    assert pii.find_pii(no_docs).count() == pii.sanitise(no_docs).count() == 0


# -- toxicity ----------------------------------------------------------------------------------


def test_toxicity_held_out(spark, rng):
    rows = []
    for i in range(600):
        bad, w = i % 6 == 0, prose(rng, 60).split()
        for _ in range(5 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "Moron", "grulf" + rng.choice("abcdef"), "snarp"]))
        rows.append((i, " ".join(w), int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = {i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 == 1}
    model = toxicity.train(docs.select("doc_id", "text"), docs.where(~F.col("doc_id").isin(*held)).select("doc_id", "toxic"))
    got = {r["doc_id"]: r["score"] >= toxicity.THRESHOLD for r in toxicity.score(docs.select("doc_id", "text"), model).collect()}
    wrong = [i for i, _, y in rows if i in held and got[i] != bool(y)]
    assert len(wrong) <= 0.02 * len(held)
    assert 0 < model.label_model.prior < 1 and (model.label_model.hit > model.label_model.false)[:5].all()


def test_label_model_finds_copies_of_a_voter(rng):
    r = np.random.default_rng(1)
    y = r.random(4000) < 0.3
    own = lambda: np.where(y, r.random(4000) < 0.7, r.random(4000) < 0.05)
    a = own()
    votes = np.array([a, a, a, own(), own(), own()]).T
    m = toxicity.LabelModel().fit(votes, votes.mean(1))
    assert m.discount[:3].max() < 0.5 < m.discount[3:].min()
    assert m.hit[3:] == pytest.approx(0.7, abs=0.15)


def plain_label_model(votes, start, rounds):
    """The label model in plain loops."""
    rows, voters, post = len(votes), len(votes[0]), list(start)
    all_ = [[(sum(x[j] == o for x in votes) + 1e-3) / (rows + 3e-3) for o in (-1, 0, 1)] for j in range(voters)]
    for _ in range(rounds):
        w = [[1 - p for p in post], post]
        rate = [[[(sum(w[y][r] for r in range(rows) if votes[r][j] == o) + all_[j][o + 1]) / (sum(w[y]) + 1) for o in (-1, 0, 1)] for j in range(voters)] for y in (0, 1)]
        prior = min(max(sum(post) / rows, 1e-3), 0.999)
        likely = [p >= 0.5 for p in post]
        mean = {y: [sum(x[j] for x, k in zip(votes, likely, strict=True) if k == y) / max(1, likely.count(y)) for j in range(voters)] for y in (False, True)}
        res = [[x[j] - mean[y][j] for j in range(voters)] for x, y in zip(votes, likely, strict=True)]
        sd = [math.sqrt(sum(x[j] ** 2 for x in res) / rows) + 1e-3 for j in range(voters)]
        cor = [[sum(x[i] * x[j] for x in res) / rows / sd[i] / sd[j] for i in range(voters)] for j in range(voters)]
        weight = [1 / max(1, sum(c for c in cor[j] if c > 0.1)) for j in range(voters)]
        odds = [math.log(prior / (1 - prior)) + sum(weight[j] * math.log(rate[1][j][o + 1] / rate[0][j][o + 1]) for j, o in enumerate(row)) for row in votes]
        post = [1 / (1 + math.exp(-min(max(z, -30), 30))) for z in odds]
    return post


@pytest.mark.parametrize("rounds", [1, 4])
def test_label_model_against_plain(rng, rounds):
    votes = [[rng.choice([-1, 0, 0, 1]), a := rng.choice([0, 1]), a if rng.random() < 0.9 else 0, rng.choice([-1, 1])] for _ in range(60)]
    start = [0.2 + 0.6 * (v[3] > 0) for v in votes]
    m = toxicity.LabelModel().fit(np.array(votes), np.array(start), rounds)
    assert m.posterior(np.array(votes)) == pytest.approx(plain_label_model(votes, start, rounds), abs=1e-4)


def test_posteriors_mend_labels(spark, rng):
    """With every seventh label turned round, the label model turns most of them back, and what is trained on its posteriors is better than what is trained on the labels."""
    rows, given = [], []
    for i in range(1400):
        bad, w = i % 5 == 0, prose(rng, 40).split()
        for _ in range(3 * bad):
            w.insert(rng.randrange(len(w)), rng.choice(["idiot", "grulf", "snarp", "blick", "vorm", "tost"]))
        rows.append((i, " ".join(w), int(bad)))
        given.append((i, int(bad) ^ (rng.random() < 1 / 7)))
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string, true int").drop("true"), spark.createDataFrame(given[:1000], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    f = toxicity._Features(model.lexicon)
    x = np.array([f.of(t) for _, t, _ in rows])
    y, truth = np.array([b for _, b in given]), np.array([b for *_, b in rows])
    raw = toxicity._fit_linear(x[:1000], y[:1000].astype(float))
    wrong = lambda w: int(((toxicity._sigmoid(x[1000:] @ w) >= toxicity.THRESHOLD) != truth[1000:]).sum())
    voters = len(model.label_model.discount) - len(toxicity.PATTERNS) - toxicity.GROUPS - 1
    post = model.label_model.posterior(toxicity._votes(x[:1000], len(model.lexicon), voters, y[:1000])) >= 0.5
    turned = y[:1000] != truth[:1000]
    assert (post[turned] == truth[:1000][turned]).mean() > 0.9 and (post == truth[:1000]).mean() > 0.98
    assert wrong(model.weights) < wrong(raw) and wrong(model.weights) <= 8


def test_toxicity_sample_is_bounded(spark):
    """Rows that repeat an id don't add to the sample."""
    docs = spark.createDataFrame([(i % 4, f"idiot {i}") for i in range(4000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id long, toxic int")
    seen = []
    fit = toxicity.LabelModel.fit
    try:
        toxicity.LabelModel.fit = lambda self, votes, *a: seen.append(len(votes)) or fit(self, votes, *a)
        toxicity.train(docs, labels)
    finally:
        toxicity.LabelModel.fit = fit
    assert seen == [4]


def test_toxicity_odd(spark, odd_docs, no_docs, odd_rows):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (3, 0)], "doc_id long, toxic int")
    out = toxicity.score(odd_docs, toxicity.train(odd_docs, labels))
    assert out.columns == odd_docs.columns  # the column `score` is replaced
    assert out.count() == len(odd_rows) and out.where("score is null or score < 0 or score > 1").count() == 0
    empty = toxicity.train(odd_docs, labels.limit(0))
    assert toxicity.score(no_docs, empty).count() == 0 and len(set(empty.score(["", None, "a b"]))) == 1


# -- language ----------------------------------------------------------------------------------


def plain_bayes(rows, text):
    """Language and score, a letter at a time."""

    def grams(t):
        s = "".join(c if c.isalpha() else " " for c in f" {t.lower()} ")
        for n in (1, 2, 3):
            for i in range(len(s) - n + 1):
                h = 0
                for c in s[i : i + n]:
                    h = (h * 0x110000 + ord(c)) % 2**64
                yield (h + n) * 0x9E3779B97F4A7C15 % 2**64 >> 49

    counts, docs = defaultdict(Counter), Counter()
    for _, t, lang in rows:
        docs[lang] += 1
        counts[lang].update(grams(t or ""))
    total, g = sum(docs.values()), [*grams(text)]
    odds = {lang: math.log(docs[lang] / total) + sum(math.log((c[x] + 1) / (sum(c.values()) + 2**15)) for x in g) for lang, c in counts.items()}
    best = max(sorted(odds), key=odds.get)
    return best, 1 / sum(math.exp((z - odds[best]) * min(64, len(g)) / len(g)) for z in odds.values())


def test_langid_against_plain(spark, rng):
    words = {"en": ["the", "and", "with", "this"], "de": ["und", "nicht", "über", "der"], "fr": ["être", "les", "avec", "où"]}
    rows = [(i, prose(rng, 12, words[lang]), lang) for i in range(30) for lang in words]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs)
    texts = [prose(rng, n, words[lang] + ["zz"]) for lang in words for n in (1, 2, 5, 20)]
    got, score = langid.predict_texts(model, [*texts, None, "", "123 !"])
    want = [plain_bayes(rows, t) for t in texts]
    assert got == [lang for lang, _ in want] + ["und"] * 3
    assert score[:-3] == pytest.approx([s for _, s in want], abs=1e-3) and (score[-3:] == 0).all()


def test_langid_of_many_languages(spark, rng):
    """300 languages, in slices; before, more than 200 were refused."""
    alphabet = [chr(0x4E00 + i) for i in range(900)]
    rows = [(f"l{k:03}", "".join(rng.choice(alphabet[3 * k : 3 * k + 3]) for _ in range(40))) for k in range(300)]
    model = langid.train(spark.createDataFrame(rows, "lang string, text string"))
    got, _ = langid.predict_texts(model, [t[:20] for _, t in rows])
    assert len(model.slices) == 38 and sum(a == b for a, (b, _) in zip(got, rows, strict=True)) >= 297


def test_langid_odd(odd_docs, no_docs, odd_rows):
    out = langid.identify(odd_docs, langid.train(odd_docs))
    assert sorted(out.columns) == sorted(odd_docs.columns)  # lang_pred and score are replaced
    assert out.count() == len(odd_rows)
    assert {r["lang_pred"] for r in out.where("text is null or trim(text) = ''").collect()} == {"und"}
    assert {r["lang_pred"] for r in langid.identify(odd_docs, langid.train(no_docs)).collect()} == {"und"}


# -- pieces ------------------------------------------------------------------------------------


def test_pieces_against_library(spark, rng):
    sentencepiece = pytest.importorskip("sentencepiece")
    lib = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL_FILE)
    bits = ["the ", "  ", "\n", "é", "你", "x1", "==", "//", "    ", "\t", "a", "b", "ing", "▁", "\u0001", "\U0001F600", "<s>", "token "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(800)] + [prose(rng, 300), " ", "x" * 20_000]
    v = pieces.Vocabulary(pieces.MODEL_FILE)
    got = pieces.Encoder(v).texts(texts)
    want = lib.encode(texts)
    assert [g.tolist() for g in got] == want
    assert [pieces.decode(v, w) for w in want] == lib.decode(want)


def _field(n, value):
    """A field of a protocol buffer: an integer, or bytes."""
    number = lambda x: bytes([x]) if x < 128 else bytes([x & 127 | 128]) + number(x >> 7)
    return number(n << 3) + number(value) if isinstance(value, int) else number(n << 3 | 2) + number(len(value)) + value


def _vocabulary_file(path, pieces_, kind=1, byte=True, spaces=0, prefix=1):
    """A vocabulary as the library reads it: (piece, score) after the unknown piece, the two controls and the bytes."""
    import struct

    rows = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + ([(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] if byte else []) + [(p, s, 1) for p, s in pieces_]
    out = b"".join(_field(1, _field(1, p.encode()) + bytes([0x15]) + struct.pack("<f", s) + _field(3, t)) for p, s, t in rows)
    out += _field(2, _field(3, kind) + _field(35, int(byte)) + _field(4, len(rows)))
    out += _field(3, _field(1, b"identity") + _field(3, prefix) + _field(4, spaces) + _field(5, 1))
    path.write_bytes(out)
    return str(path)


@pytest.mark.parametrize("byte", [True, False])
def test_unigram_against_library(rng, tmp_path, byte):
    """Forward scores over a scored vocabulary give the library's ids, unknown characters and ties of length included."""
    sentencepiece = pytest.importorskip("sentencepiece")
    found = {MARK: -3.1} | {c: -5.0 - i / 7 for i, c in enumerate("abcdeést")}
    while len(found) < 150:
        w = "".join(rng.choice("abcdeést") for _ in range(rng.randint(2, 6)))
        found[rng.choice(["", MARK]) + w] = -rng.uniform(4, 12)
    file = _vocabulary_file(tmp_path / "u.model", found.items(), byte=byte)
    lib = sentencepiece.SentencePieceProcessor(model_file=file)
    texts = ["".join(rng.choice(["a", "b", "c", "d", "e", "é", "s", "t", "x", "你", " ", "  ", "\n", "test "]) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    v = pieces.Vocabulary(file)
    assert v.type == pieces.UNIGRAM
    want = lib.encode(texts)
    got = [g.tolist() for g in pieces.Encoder(v).texts(texts)]
    score = lambda ids: sum(v.worst if i == v.unknown else v.scores[i] for i in ids)
    # paths of equal scores ("e ee", "ee e") are told apart by the library's rounding of 32-bit sums over all that precedes, and only these
    ties = [(g, w) for g, w in zip(got, want, strict=True) if g != w]
    assert len(ties) <= 5 and all(sorted(g) == sorted(w) and score(g) == pytest.approx(score(w)) for g, w in ties)
    assert [pieces.decode(v, w) for w in want] == lib.decode(want)


def plain_unigram(v, word):
    best = [(0.0, [])]
    for i in range(1, len(word) + 1):
        ways = [(best[j][0] + v.score[word[j:i]], best[j][1] + [v.id[word[j:i]]]) for j in range(i) if word[j:i] in v.id]
        if word[i - 1] not in v.id:
            ways.append((best[i - 1][0] + v.worst, best[i - 1][1] + [v.unknown]))
        best.append(max(ways, key=lambda x: x[0]))
    return best[-1]


def test_unigram_prefixes_share_scores(rng, tmp_path):
    found = {MARK: -2.0} | {"".join(rng.choice("abc") for _ in range(rng.randint(1, 4))): -rng.uniform(1, 9) for _ in range(40)}
    v = pieces.Vocabulary(_vocabulary_file(tmp_path / "u.model", found.items(), byte=False))
    words = sorted({MARK + "".join(rng.choice("abcd") for _ in range(rng.randint(1, 12))) for _ in range(500)})
    e = pieces.Encoder(v)
    e.words(words)
    assert all(np.frombuffer(e.known[w], np.int32).tolist() == plain_unigram(v, w)[1] for w in words)


def test_other_vocabularies_are_refused(tmp_path):
    rows = {MARK: -1.0, "a": -2.0}.items()
    for name, how in {"neither": {"kind": 3}, "removes": {"spaces": 1}, "before": {"prefix": 0}}.items():
        with pytest.raises(ValueError, match=name):
            pieces.Vocabulary(_vocabulary_file(tmp_path / "w.model", rows, **how))


def test_pieces_odd(spark, odd_docs, no_docs, odd_rows):
    vocab = pieces.vocabulary(spark)
    out = pieces.encode(odd_docs, vocab)
    assert out.count() == len(odd_rows) and out.where("not round_trip").count() == 0
    assert {tuple(r["ids"]) for r in out.where("doc_id in (100, 101)").collect()} == {()}
    back = pieces.decoded(out, vocab)
    assert back.where("decoded <> coalesce(text, '')").count() == 0
    assert pieces.encode(no_docs, vocab).count() == 0
