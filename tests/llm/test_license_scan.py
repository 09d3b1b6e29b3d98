"""License scans against a plain search of the words."""

import re

import pytest
from pyspark.sql import functions as F

from logloom.llm import license_scan
from tests.llm.conftest import DOCS

MIT = license_scan.NOTICES[17][1]


def plain(text, base=license_scan.BASE, notices=license_scan.NOTICES, slack=license_scan.SLACK):
    words = license_scan.words_of(text or "")
    places = lambda p: [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    found = sorted((i, label) for phrase, label in base for i in places(license_scan.words_of(phrase)))
    out = set()
    for label, wording, phrases in notices:
        w = license_scan.words_of(wording)
        parts = []
        for p in map(license_scan.words_of, phrases):
            q = next(i for i in range(len(w)) if w[i : i + len(p)] == p)
            parts.append([i - q for i in places(p)])
        for at in parts[0]:
            if all(any(abs(at - o) <= slack for o in other) for other in parts[1:]):
                out.add((label, at, sum(0 <= at + j < len(words) and words[at + j] == x for j, x in enumerate(w)) / len(w)))
    return len(words), found, sorted(out)


def scanned(df, **more):
    rows = license_scan.scan(df, **more).collect()
    return {r["doc_id"]: (r["n_words"], [tuple(x) for x in r["places"]], [tuple(x) for x in r["notices"]]) for r in rows}, len(rows)


def test_equals_plain_search(spark):
    texts = [
        "Released under the MIT License", "mit license mit license, MIT-LICENSE!", "the mit\nlicense", "x mit licensed", "cc by", "cc by cc by nc 4.0", "under CC BY-NC 4.0 and under cc by 4.0",
        f"  {MIT}. {MIT}", MIT.replace("documentation", "many more documentation"), " ".join(license_scan.words_of(MIT)[6:]), "permission is hereby granted, free of charge " + "w " * 90 + "to deal in the software without restriction",
        license_scan.NOTICES[13][1] + " " + license_scan.NOTICES[2][1], "GNU General Public License, version 3 or version 2", "gnu  general\tpublic license" * 3, "a " * 3000 + "apache license, version 2.0" + " b" * 3000,
        "ΜIT mİt license K gnu general public license", "éapache license apache licensé", "", "   \n ", "...", "x", " x ", *[n[1] for n in license_scan.NOTICES],
    ]
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got, _ = scanned(df)
    for i, t in enumerate(texts):
        assert got[i] == plain(t), t


def test_every_notice_is_found_whole(spark):
    df = spark.createDataFrame([(i, f"before {n[1]} after", "en", "s", 1) for i, n in enumerate(license_scan.NOTICES)], DOCS)
    got, _ = scanned(df)
    for i, (label, _, _) in enumerate(license_scan.NOTICES):
        assert (label, 1, 1.0) in got[i][2]


@pytest.mark.parametrize("rare", ["gnu", "license", "general", "public"])
def test_which_word_is_rare_changes_nothing(spark, rare):
    """The index holds each phrase by its word of the highest IDF; whichever that is, the places are the same."""
    known = license_scan.Notices()
    frequency = dict.fromkeys(known.vocabulary(), 9) | {rare: 1}
    assert any(known.phrases[k][i] == rare for k, i in license_scan.rare_word_index(known, frequency)[rare])
    text = "gnu general public license x gnu public license general, gnu gnu general public license license"
    df = spark.createDataFrame([(i, w, "en", "s", 1) for i in range(5) for w in [text if not i else "gnu general public license".replace(rare, "")]], DOCS)
    got, _ = scanned(df)
    assert got[0] == plain(text)


def test_frequencies_count_all_documents(spark):
    df = spark.createDataFrame([(1, "mit mit", "", "", 1), (2, "MIT license", "", "", 1), (2, "MIT license", "", "", 1), (3, None, "", "", 1)], DOCS)
    got = license_scan.document_frequencies(license_scan.with_words(df, "doc_id", "text"), ["mit", "license", "gnu"])
    assert got == {"mit": 3, "license": 2, "gnu": 0}


def test_odd_rows(spark, odd_docs, odd_rows):
    got, n = scanned(odd_docs)
    assert n == len(odd_rows)
    for i, text, *_ in odd_rows:
        if i is not None:
            assert got[i] == plain(text)


def test_own_notices(spark):
    """Own lists; a phrase that its notice lacks is an error; without notices only base phrases are found, without either none."""
    df = spark.createDataFrame([(1, "all rights are kept by the house", "", "", 1)], DOCS)
    got, _ = scanned(df, base=(("rights are", "r"),), notices=(("house", "kept by the house", ("the house",)),))
    assert got[1] == (7, [(1, "r")], [("house", 3, 1.0)])
    assert scanned(df, base=(("rights are", "r"),), notices=())[0][1] == (7, [(1, "r")], [])
    assert scanned(df, base=(), notices=(("house", "kept by the house", ("the house",)),))[0][1] == (7, [], [("house", 3, 1.0)])
    assert scanned(df, base=(), notices=())[0][1] == (7, [], [])
    with pytest.raises(ValueError, match="lacks"):
        license_scan.Notices(notices=(("x", "one two", ("three",)),))


def test_no_documents(spark, no_docs):
    assert scanned(no_docs) == ({}, 0)


def test_plan_is_native(spark, odd_docs):
    plan = license_scan.scan(odd_docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and "Exchange" not in plan


def test_long_file_of_many_notices(spark):
    """Work grows with the file, not with the square of a notice's places."""
    text = (MIT + " ") * 1500
    df = spark.createDataFrame([(1, text)], "doc_id long, text string").withColumn("text", F.col("text"))
    r = license_scan.scan(df).first()
    assert len(r["notices"]) == 1500 and all(x["share"] == 1 for x in r["notices"])
