"""License scans by a positional index of rare words, in DataFrame functions alone.

A notice is a text of which some phrases are mandatory. The index is keyed by words: of each phrase the one of the highest IDF over
all documents, with the phrase and its place in it. A file's words that are in the index, its rarest licence words, are
looked up; each posting says where the phrase would begin, and the phrase's words are held against the file's there. So each place of a
phrase is found once, by one word, whatever that word is; a common word never starts a look-up where a rarer one can.

A phrase's place, less its place in a notice, is where the notice would begin. A notice stands where these beginnings of all its mandatory phrases
intersect, give or take SLACK words; its score is the share of its words that stand in place.
"""

from __future__ import annotations

import re
import string
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import quoted, table

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"  # of texts whose A-Z are lower-cased
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SLACK = 8  # words by which a mandatory phrase may be off its place in a notice
MENTION = 0.5  # score of a base phrase that no notice surrounds

#: Base phrases and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Wordings of common licence notices: label, text, mandatory phrases.
NOTICES = (
    ("agpl-3.0", "GNU Affero General Public License, version 3", ("gnu affero general public license",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ("licensed under the apache license version 2 0",)),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
     ("apache license version 2 0", "may not use this file except in compliance with the license")),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
     ("redistribution and use in source and binary forms", "provided that the following conditions are met")),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ("boost software license version 1 0",)),
    ("cc-by-4.0", "Licensed under CC BY 4.0", ("under cc by 4 0",)),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License", ("creative commons attribution 4 0 international",)),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("under cc by nc 4 0",)),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("under cc by sa 4 0",)),
    ("cc0-1.0", "has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("epl-2.0", "are made available under the terms of the Eclipse Public License 2.0", ("eclipse public license 2 0",)),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    ("gpl-3.0-or-later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version",
     ("terms of the gnu general public license as published by the free software foundation", "either version 3 of the license", "any later version")),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
     ("for any purpose with or without fee is hereby granted", "permission notice appear in all copies")),
    ("lgpl", "GNU Lesser General Public License", ("gnu lesser general public license",)),
    ("mit", "Released under the MIT License", ("under the mit license",)),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
     ("permission is hereby granted free of charge", "to deal in the software without restriction")),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    ("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
     ("provided as is without any express or implied warranty", "arising from the use of this software")),
)


def words_of(text: str) -> list[str]:
    return re.findall(WORD, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase)))


class Notices:
    """base (phrase, label) and notices (label, text, phrases), in words: `phrases`, and of each notice (label, words, [(phrase, its place in the text)])."""

    def __init__(self, base=BASE, notices=NOTICES):
        self.base = [label for _, label in base]
        self.phrases = [words_of(p) for p, _ in base]
        self.notices = []
        for label, text, mandatory in notices:
            words, parts = words_of(text), []
            for p in map(words_of, mandatory):
                at = next((i for i in range(len(words)) if words[i : i + len(p)] == p), None)
                if not p or at is None:
                    raise ValueError(f"{label}: a mandatory phrase that its text lacks")
                # phrases of notices are numbered after the base ones, even where their words are the same
                own = next((k for k in range(len(self.base), len(self.phrases)) if self.phrases[k] == p), None)
                if own is None:
                    own = len(self.phrases)
                    self.phrases.append(p)
                parts.append((own, at))
            self.notices.append((label, words, parts))

    def vocabulary(self) -> list[str]:
        return sorted({w for p in self.phrases for w in p})


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, as far as ASCII words go: other letters may change, but none into or out of ASCII."""
    exact = F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    # the two letters beyond ASCII whose lower case has an ASCII letter
    return F.when(c.contains("\u0130") | c.contains("\u212a"), exact).otherwise(F.lower(c))


def with_words(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(_id, _words, _lead): the words between separators; at most one empty string first, counted by _lead, and one last."""
    text = F.coalesce(quoted(text_col).cast("string"), F.lit(""))
    rows = docs.select(quoted(id_col).alias("_id"), F.split(ascii_lower(text), SEPARATORS, -1).alias("_words"))
    return rows.withColumn("_lead", (F.get("_words", F.lit(0)) == "").cast("int"))


def document_frequencies(rows: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """Documents that have each word of the vocabulary, over all of rows (_words); a number for each word of the notices reaches the driver."""
    if not vocabulary:
        return {}
    met = rows.select(F.explode(F.array_intersect("_words", F.array(*map(F.lit, vocabulary)))).alias("word")).groupBy("word").count()
    return dict.fromkeys(vocabulary, 0) | {r["word"]: r["count"] for r in met.collect()}


def rare_word_index(notices: Notices, frequency: dict[str, int]) -> dict[str, list[tuple[int, int]]]:
    """{word: [(phrase, the word's place in it)]}: each phrase under its word of the highest IDF, which is the lowest frequency; ties go to the first."""
    index: dict[str, list[tuple[int, int]]] = {}
    for k, p in enumerate(notices.phrases):
        at = min(range(len(p)), key=lambda i: (frequency[p[i]], i))
        index.setdefault(p[at], []).append((k, at))
    return index


def _phrase_places(notices: Notices, index: dict[str, list[tuple[int, int]]], words: Column) -> Column:
    """array<struct<phrase, at>> of all places of all phrases, each once."""
    if not index:
        return F.array().cast("array<struct<phrase:int,at:int>>")
    texts = F.array(*[F.array(*map(F.lit, p)) for p in notices.phrases])
    postings = F.create_map(*[x for w, ps in index.items() for x in (F.lit(w), F.array(*[F.struct(F.lit(k).alias("phrase"), F.lit(i).alias("place")) for k, i in ps]))])
    rare = F.filter(F.transform(words, lambda w, i: F.when(w.isin(*index), i)), lambda i: i.isNotNull())

    def begins(i: Column) -> Column:
        return F.transform(F.element_at(postings, F.get(words, i)), lambda p: F.struct(p["phrase"].alias("phrase"), (i - p["place"]).alias("at")))

    def stands(x: Column) -> Column:
        p = F.get(texts, x["phrase"])
        return F.when(x["at"] >= 0, F.slice(words, x["at"] + 1, F.size(p)) == p).otherwise(F.lit(False))

    return F.filter(F.flatten(F.transform(rare, begins)), stands)


_NOTICE = "array<struct<label:string,at:int,share:double>>"


def _places_of_notice(label: str, text: list[str], parts: list[tuple[int, int]], places: Column, words: Column) -> Column:
    own = F.array(*map(F.lit, text))

    def begins(phrase: int, place: int) -> Column:
        return F.transform(F.filter(places, lambda x: x["phrase"] == phrase), lambda x: x["at"] - place)

    def share(at: Column) -> Column:
        same = F.transform(own, lambda w, j: F.coalesce(w == F.get(words, at + j), F.lit(False)))
        return F.size(F.filter(same, lambda x: x)) / F.lit(float(len(text)))

    near = [F.flatten(F.transform(begins(k, q), lambda v: F.sequence(v - SLACK, v + SLACK))) for k, q in parts[1:]]
    starts = reduce(F.array_intersect, near, begins(*parts[0]))
    return F.transform(starts, lambda at: F.struct(F.lit(label).alias("label"), at.alias("at"), share(at).alias("share")))


def _notice_places(notices: Notices, places: Column, words: Column) -> Column:
    """array<struct<label, at, share>> of all notices, by label and place."""
    none = F.array().cast(_NOTICE)
    found = [_places_of_notice(*notice, places, words) for notice in notices.notices]
    return F.when(F.size(places) > 0, F.array_sort(F.array_distinct(F.concat(none, *found)))).otherwise(none)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base=BASE, notices=NOTICES) -> DataFrame:
    """(id, n_words, places array<struct<label, at>>, notices array<struct<label, at, share>>): a row for each row of docs.

    places: of base phrases, by their words' numbers from 0, ascending; notices: where each begins, which is before the text for one cut off at its head, and
    the share of its words in place. Null texts are empty and have none; repeated rows and null ids are kept; other columns are not looked at.
    Two passes: frequencies of licence words over all documents, then the look-up; neither shuffles more than counts.
    """
    known = Notices(base, notices)
    rows = with_words(docs, id_col, text_col)
    index = rare_word_index(known, document_frequencies(rows, known.vocabulary()))
    words, lead = F.col("_words"), F.col("_lead")
    rows = rows.withColumn("_places", _phrase_places(known, index, words))
    found = _notice_places(known, F.col("_places"), words)
    labels = F.array(*map(F.lit, known.base)) if known.base else F.array().cast("array<string>")
    n = F.greatest(F.size(words) - lead - (F.element_at(words, -1) == "").cast("int"), F.lit(0))
    base_places = F.filter("_places", lambda x: x["phrase"] < len(known.base))
    return rows.select(
        F.col("_id").alias(id_col), n.cast("long").alias("n_words"),
        F.array_sort(F.transform(base_places, lambda x: F.struct((x["at"] - lead).cast("long").alias("at"), F.get(labels, x["phrase"]).alias("label")))).alias("places"),
        F.transform(found, lambda x: F.struct(x["label"].alias("label"), (x["at"] - lead).cast("long").alias("at"), x["share"].alias("share"))).alias("notices"),
    )


def op12(spark, sf_dir):
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score) of all documents; no labels are an empty string.

    score: the largest share of a notice that stands in place, MENTION at least where a base phrase stands, else 0.
    """
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base, own = F.array_distinct(F.col("places.label")), F.col("notices.label")
    return rows.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min("places.at").alias("first_word"), F.array_max("places.at").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union(base, own)), ",").alias("labels"),
        F.greatest(F.coalesce(F.array_max("notices.share"), F.lit(0.0)), F.when(F.size("places") > 0, F.lit(MENTION)).otherwise(F.lit(0.0))).alias("score"),
    )


def _op12_sql() -> str:
    known = Notices()
    phrases = ", ".join(f"({k}, {known.base[k]!r}, {p})" if k < len(known.base) else f"({k}, NULL, {p})" for k, p in enumerate(known.phrases))
    texts = ", ".join(f"({t}, {label!r}, {words})" for t, (label, words, _) in enumerate(known.notices))
    parts = ", ".join(f"({t}, {j}, {k}, {q})" for t, (_, _, ps) in enumerate(known.notices) for j, (k, q) in enumerate(ps))
    return f"""
WITH d AS MATERIALIZED (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '{WORD}') AS words FROM documents),
t AS MATERIALIZED (SELECT n, unnest(words) AS w, generate_subscripts(words, 1) - 1 AS i FROM d),
p(k, base, pw) AS (VALUES {phrases}), s(s, label, sw) AS (VALUES {texts}), m(s, j, k, q) AS (VALUES {parts}),
o AS MATERIALIZED (SELECT n, k, base, i FROM t JOIN p ON w = pw[1] JOIN d USING (n) WHERE words[i + 1 : i + len(pw)] = pw),
b AS (SELECT n, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word FROM o WHERE base IS NOT NULL GROUP BY n),
c AS (SELECT DISTINCT n, m.s, i - q AS z FROM o JOIN m USING (k) WHERE j = 0),
v AS (SELECT n, s, z FROM c WHERE NOT EXISTS (SELECT 1 FROM m WHERE m.s = c.s AND m.j > 0 AND NOT EXISTS (SELECT 1 FROM o WHERE o.n = c.n AND o.k = m.k AND abs(o.i - m.q - c.z) <= {SLACK}))),
x AS (SELECT s, unnest(sw) AS w, generate_subscripts(sw, 1) - 1 AS j FROM s),
r AS (SELECT v.n, v.s, v.z, count(*) AS have FROM v JOIN x ON v.s = x.s JOIN t ON t.n = v.n AND t.i = v.z + x.j AND t.w = x.w GROUP BY ALL),
f AS (SELECT n, label, have / CAST(len(sw) AS DOUBLE) AS share FROM r JOIN s USING (s)),
a AS (SELECT n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT n, label FROM f UNION SELECT n, base FROM o WHERE base IS NOT NULL) GROUP BY n),
e AS (SELECT n, string_agg(DISTINCT base, ',' ORDER BY base) AS base_labels FROM o WHERE base IS NOT NULL GROUP BY n),
g AS (SELECT n, max(share) AS share FROM f GROUP BY n)
SELECT doc_id, len(words) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels,
  CAST(greatest(coalesce(share, 0), CASE WHEN n_base > 0 THEN {MENTION} ELSE 0 END) AS DOUBLE) AS score
FROM d LEFT JOIN b USING (n) LEFT JOIN a USING (n) LEFT JOIN e USING (n) LEFT JOIN g USING (n)
"""


OP12_SQL = _op12_sql()
