"""Posting lists give what the search of all turns gives, and read the query's terms alone."""

import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from logloom.operators import search
from logloom.operators.filters import SessionFilter
from logloom.operators.postings import Postings, lists_of
from logloom.schema import DEVICES, KINDS, SESSIONS, TOOLS, TURNS, USAGE, Tables
from logloom.streaming.store import Store

AT = datetime(2026, 5, 1, 10)
SAID = {
    "a": [("user", "message", "foo bar audit trail of quantum things, foo and foo-bar"), ("user", "message", "nothing of it")],
    "b": [("assistant", "message", "terraform plan, then Terraform apply"), ("assistant", "thinking", "quantum in a thought")],
    "c": [("user", "message", "quantum whale while where"), ("user", "message", ""), ("tool", "tool_result", "the the the quantum")],
    "h": [("user", "message", "PR agregador found security issues in mz-irm-api mz-core-api and mz-intelligence-api")],
}
QUERIES = ["quantum", "quantum OR terraform", "terr*", "mz-core-ap*", "foo(bar)", "mz-irm-api mz-core-api security issues", "(", "audit OR", "NOT audit", "wh*", '"of quantum"', '"foo bar"', "quantum NOT wh*", "NEAR(foo trail, 2)", "NEAR(foo trail, 1)",
           "quantum AND while", "the", '"the the"', "of (it OR quantum) NOT foo", "zzz", "zzz OR foo", '""', "foo NOT (bar OR zzz)"]


def tables(spark, said):
    s = [(i, "codex", "d", None, None, None, AT, AT, None, None, f"f{i}", "h", 1, None, "default") for i in said]
    turns = [(n, i, role, text, AT, kind, None) for i, x in said.items() for n, (role, kind, text) in enumerate(x)]
    empty = [spark.createDataFrame([], x) for x in (TOOLS, USAGE, KINDS, DEVICES)]
    return Tables(spark.createDataFrame(s, SESSIONS), spark.createDataFrame(turns, TURNS), *empty)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    s = Store(spark, str(tmp_path_factory.mktemp("store")), buckets=8)
    s.append(tables(spark, {"a": [("user", "message", "old quantum words that are gone")], "b": SAID["b"]}))
    lists = Postings(s)
    assert lists.extend() == 1 and lists.extend() == 0
    s.append(tables(spark, {"a": SAID["a"], "c": SAID["c"]}))
    s.append(tables(spark, {"h": SAID["h"], "silent": []}))
    assert lists.extend() == 2 and lists.extend() == 0
    return s


@pytest.mark.parametrize("query", QUERIES)
def test_equals_the_search_of_all_turns(spark, store, query):
    t, lists = tables(spark, SAID), Postings(store)
    want = {(r["session_id"], r["id"]): r["rank"] for r in search.ranked_turns(t.turns, query).collect()}
    got = {(r["session_id"], r["turn"]): r["rank"] for r in lists.ranked(query).collect()}
    assert got == {k: pytest.approx(v, abs=1e-8) for k, v in want.items()}


def test_search_and_sessions(spark, store):
    t, lists, plain = store.read(), Postings(store), tables(spark, SAID)
    for query in ("quantum OR foo", "wh* NOT terraform", '"foo bar"', "zzz"):
        show = lambda df: [tuple(r) for r in df.select("session_id", "turn_id", "role", F.round("rank", 6), "snippet").collect()]
        assert show(lists.search(t, query)) == show(search.search(plain, query))
        assert {tuple(r) for r in lists.matching_sessions(t, query).collect()} == {tuple(r) for r in search.matching_sessions(plain, query).collect()}
    assert [r["session_id"] for r in lists.search(t, "quantum NOT whale", plain=True).collect()] == []
    assert [r["session_id"] for r in lists.search(t, "quantum", SessionFilter(agents=("codex",)), limit=1).collect()] == [search.search(plain, "quantum").first()["session_id"]]
    assert lists.search(t, "quantum", SessionFilter(agents=("gemini",))).collect() == []


def plan(df):
    return df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def test_only_the_terms_of_the_query_are_read(store):
    """A word's bucket of the lists, and what may have the word there; no turn, until snippets are made."""
    text = plan(Postings(store).ranked("quantum"))
    assert "SelectedBucketsCount: 1 out of 8" in text and "EqualTo(term,quantum)" in text
    assert "/turns" not in text
    assert "StringStartsWith(term,wh)" in plan(Postings(store).ranked("wh*"))
    hits = plan(Postings(store).search(store.read(), "quantum"))
    assert "/turns" in hits and "In(session_id, [a,c])" in hits, [x for x in hits.splitlines() if "PushedFilters" in x or "Buckets" in x]
    assert re.search("SelectedBucketsCount: [12] out of 8", hits)


def test_lists_made_twice_count_once(spark, store, tmp_path):
    """Two that extend at once make lists of the same batch; the first counts."""
    s = Store(spark, str(tmp_path), buckets=2)
    batch = s.append(tables(spark, {"c": SAID["c"]}))
    for _ in range(2):
        n = s.next_batch()
        one = lists_of(s.table("turns", [batch]))
        s.write(n, "postings", one.withColumn("of", F.lit(batch)))
        s.write(n, "sizes", spark.createDataFrame([("c", 3, 8, batch)], "session_id string, turns long, tokens long, of string"))
        s.commit(n)
    assert {(r["session_id"], r["turn"]) for r in Postings(s).ranked("quantum").collect()} == {("c", 0), ("c", 2)}
    assert Postings(s).ranked("the").collect()[0]["rank"] == search.ranked_turns(tables(spark, {"c": SAID["c"]}).turns, "the").first()["rank"]


def test_an_empty_store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "none"))
    assert Postings(s).extend() == 0 and Postings(s).ranked("quantum").collect() == [] and Postings(s).search(s.read(), "quantum").collect() == []
