import math

import pytest
from pyspark.sql import functions as F

from logloom.operators import search
from logloom.plans import entities
from logloom.schema import DEVICES, KINDS, TOOLS, USAGE, Tables

TURNS = {
    1: ("a", "user", "foo bar audit trail of quantum things", "message"), 2: ("b", "assistant", "terraform plan, then Terraform apply", "message"), 3: ("c", "user", "quantum whale while where", "message"),
    4: ("h", "user", "PR agregador found security issues in mz-irm-api mz-core-api and mz-intelligence-api", "message"), 5: ("c", "assistant", "terraform in a thought", "thinking"), 6: ("d", "user", "nothing of it", "message"),
}


@pytest.fixture(scope="module")
def tables(spark):
    turns = spark.createDataFrame([(i, s, r, c, "2026-05-01 10:00:00", k, None) for i, (s, r, c, k) in TURNS.items()], "id long, session_id string, role string, content string, ts string, kind string, tool_name string")
    sessions = turns.select(F.col("session_id").alias("id")).distinct().select(
        "id", F.lit("codex").alias("agent"), F.lit("d1").alias("device_id"), *[F.lit(None).cast("string").alias(c) for c in ("project_path", "project_remote", "project_marker")], F.lit("2026-05-01").cast("timestamp").alias("started_at"),
        F.lit("2026-05-01").cast("timestamp").alias("last_activity_at"), F.lit("gpt-5").alias("model"), F.lit(None).cast("string").alias("parent_session_id"), F.lit("default").alias("profile"),
    )
    return Tables(sessions, turns.withColumn("ts", F.col("ts").cast("timestamp")), *[spark.createDataFrame([], x) for x in (TOOLS, USAGE, KINDS, DEVICES)])


def found(tables, query, **how):
    return {r["session_id"]: r for r in search.search(tables, query, **how).collect()}


@pytest.mark.parametrize(
    "query, want",
    [
        ("quantum OR terraform", "abc"), ("terr*", "b"), ("mz-core-ap*", "h"), ("foo(bar)", "a"), ("mz-irm-api mz-core-api security issues", "h"), ("(", ""), ("audit OR", ""), ("NOT audit", ""), ("wh*", "c"),
        ('"of quantum"', "a"), ("quantum NOT wh*", "a"), ("NEAR(foo trail, 2)", "a"), ("NEAR(foo trail, 1)", ""), ("quantum AND while", "c"),
    ],
)
def test_hits(tables, query, want):
    assert set(found(tables, query)) == set(want)


def test_beginnings_are_ranked_and_marked(tables):
    """What is found by the beginning of a word has a rank and guillemets; before, it had 0 and none. Negated words are not marked."""
    r = found(tables, "wh* NOT terraform")["c"]
    assert r["rank"] > 0 and r["snippet"] == "quantum «whale» «while» «where»"
    assert found(tables, "quantum NOT whale")["a"]["snippet"] == "trail of «quantum» things"


def plain_rank(units, docs, n):
    """BM25 of document n."""
    avg = sum(map(len, docs)) / len(docs)
    total = 0.0
    for u in units:
        tf = [sum(u(w) for w in d) for d in docs]
        df = sum(x > 0 for x in tf)
        total += math.log(1 + (len(docs) - df + 0.5) / (df + 0.5)) * tf[n] * 2.2 / (tf[n] + 1.2 * (0.25 + 0.75 * len(docs[n]) / avg))
    return total


def test_rank_is_bm25(tables):
    docs = {i: [w for w in "".join(c if c.isalnum() else " " for c in t.lower()).split()] for i, (_, _, t, k) in TURNS.items() if k != "thinking"}
    ids = list(docs)
    hits = {r["id"]: r["rank"] for r in search.ranked_turns(tables.turns, "quantum OR wh* OR terraform").collect()}
    units = [lambda w: w == "quantum", lambda w: w.startswith("wh"), lambda w: w == "terraform"]
    assert hits == {i: pytest.approx(plain_rank(units, list(docs.values()), ids.index(i)), abs=1e-8) for i in (1, 2, 3)}


def test_stored_tokens_give_the_same(tables):
    stored = Tables(tables.sessions, search.indexed(tables.turns), tables.tools, tables.usage, tables.kinds, tables.devices)
    for q in ("quantum OR terraform", "mz-core-ap*"):
        assert {k: r["rank"] for k, r in found(stored, q).items()} == {k: r["rank"] for k, r in found(tables, q).items()}
    assert {r["session_id"] for r in search.matching_sessions(stored, "quantum").collect()} == {"a", "c"}


def test_plain_text_has_no_operators(tables):
    assert set(found(tables, "quantum NOT whale", plain=True)) == set() and set(found(tables, "(quantum) whale*", plain=True)) == {"c"} and found(tables, "()", plain=True) == {}


def test_narrow_snippets_hold_the_hit(tables):
    assert found(tables, "security", width=1)["h"]["snippet"] == "«security»" and "«security»" in found(tables, "security", width=2)["h"]["snippet"]


def test_list_by_rank(tables):
    page = [r["id"] for r in entities.list_sessions(tables, query="quantum OR terraform", limit=2).collect()]
    assert page[0] == "b" and len(page) == 2 and entities.list_sessions(tables, query="quantum OR terraform").first()["total"] == 3
