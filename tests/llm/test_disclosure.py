import random

from logloom.llm import pii


def _words(r, n):
    return " ".join(r.choice(["the", "of", "and", "house", "river", "stone", "under", "light"]) for _ in range(n))


def test_names_in_few_texts(spark):
    """A name that an address spells, in one text; one beside the same card in two; one beside a domain's addresses. Rare words beside neither."""
    r = random.Random(1)
    rows = [_words(r, 30) for _ in range(60)]
    rows += [f"{_words(r, 8)} Zarquon writes from zarquon.v@quon.example.org rarely {_words(r, 8)}", f"{_words(r, 9)} saw Zarquon"]
    rows += [f"{_words(r, k)} Trillian 4692819832630923 {_words(r, 8)}" for k in (8, 9)]
    rows += [f"{_words(r, 8)} Hooloovoo {who}@blue.example.net {_words(r, 8)}" for who in ("anna", "bert", "cleo", "dora")]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    assert {r[0] for r in pii.disclosing_terms(docs).collect()} == {"zarquon", "trillian", "hooloovoo"}
    clean = dict(pii.sanitise(docs).select("doc_id", "text").collect())
    assert clean[61].endswith("saw [TERM]") and clean[5] == rows[5]


def test_copies_count_once(spark):
    """Repeated rows change nothing; before, a term of three texts of ten copies each no longer disclosed its entity."""
    r = random.Random(2)
    rows = [_words(r, 30) for _ in range(60)]
    few = [f"{_words(r, k)} Trillian 4692819832630923 {_words(r, 8)}" for k in (8, 9, 10)]
    for copies in (1, 10):
        docs = spark.createDataFrame(list(enumerate(rows + few * copies)), "doc_id long, text string")
        assert {r[0] for r in pii.disclosing_terms(docs).collect()} == {"trillian"}
