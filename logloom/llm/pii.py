"""PII: patterns find what must be protected; corpus co-occurrence finds what else reveals it.

A protected entity is the value of a pattern's match, and so is what recurs where values don't: an e-mail's domain, an
IP's first three parts. A term within `WINDOW` words of an entity is taken to disclose it when seeing the term leaves at
most `RESIDUAL_BITS` bits of doubt about the entity, -log2 p(entity | term), and takes away `GAINED_BITS` at least, its
pointwise mutual information. The first p is smoothed by `SMOOTHING` texts in which the entity is as frequent as anywhere, so one text
isn't enough; it is for a term that the e-mail's own local part spells, whose p is the plain share.
Terms that disclose an entity are removed or generalised wherever they stand.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Bloom, build_bloom, ensure_checkpoint_dir, quoted, release_memory, split_by_bloom, table

WINDOW = 6  # words on either side of an entity
SMOOTHING = 2.0  # texts that stand for what is known without the term
RESIDUAL_BITS = 1.0
GAINED_BITS = 3.0

#: The kinds in the order in which equal starts are listed, and what replaces them.
KINDS = ("email", "ip", "card", "phone", "term")
GENERAL = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]", "term": "[TERM]"}

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_NOT_DIGIT = re.compile("[^0-9]")


def _emails(text: str):
    """Leftmost, non-overlapping. Grown from each @, so that long runs of letters cost their length once."""
    at, low = text.find("@"), 0
    while at >= 0:
        nxt = at + 1
        if m := _DOMAIN.match(text, at + 1):
            i = at
            while i > low and text[i - 1] in _LOCAL:
                i -= 1
            if i < at:
                yield i, m.end(), "email"
                low = nxt = m.end()
        at = text.find("@", nxt)


def _small(part: str) -> bool:
    p = part.lstrip("0")
    return len(p) < 4 and int(p or 0) <= 255


def _luhn(digits: str) -> bool:
    d = [int(c) for c in reversed(digits)]
    return (sum(d[::2]) + sum(x * 2 - 9 * (x > 4) for x in d[1::2])) % 10 == 0


def base_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the patterns' valid matches in code points, by start, then kind as listed."""
    if not text:
        return []
    out = list(_emails(text)) if "@" in text else []
    out += [(*m.span(), "ip") for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := _NOT_DIGIT.sub("", m[0])) <= 19 and _luhn(d):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def _value(text: str, span) -> str:
    v = text[span[0] : span[1]]
    return v.lower() if span[2] == "email" else v if span[2] == "ip" else _NOT_DIGIT.sub("", v)


class _Cover:
    """Whether a stretch of text overlaps one of the spans, which are ordered by start."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for s, e, _ in spans:
            if self.ends and s < self.ends[-1]:
                self.ends[-1] = max(e, self.ends[-1])
            else:
                self.starts.append(s)
                self.ends.append(e)

    def __call__(self, start: int, end: int) -> bool:
        i = bisect_right(self.ends, start)
        return i < len(self.starts) and self.starts[i] < end


class _Near:
    """Terms within WINDOW words of a span, however far away, that are no part of a span."""

    def __init__(self, text: str, covered: _Cover):
        self.text, self.covered, self.starts, self.ends = text, covered, array("q"), array("q")
        for m in _TERM.finditer(text):
            self.starts.append(m.start())
            self.ends.append(m.end())

    def __call__(self, span) -> set[str]:
        left, right = bisect_right(self.ends, span[0]), bisect_left(self.starts, span[1])
        at = [*range(max(0, left - WINDOW), left), *range(right, min(right + WINDOW, len(self.starts)))]
        return {self.text[s:e].lower() for s, e in ((self.starts[i], self.ends[i]) for i in at) if not self.covered(s, e)}


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s.encode(), 42)


def _entities(value: str, kind: str) -> list[tuple[str, set[str]]]:
    """The entities of a match, each with the words that it spells."""
    out = [(f"{kind}:{value}", set())]
    if kind == "email":
        local, domain = value.split("@", 1)
        out = [(out[0][0], set(_TERM.findall(local))), (f"domain:{domain}", set())]
    elif kind == "ip":
        out.append((f"net:{value.rsplit('.', 1)[0]}", set()))
    return out


def _evidence(batches):
    """(term, entity, text, spelled): a term near an entity; term '' for the entity itself. text: a hash of the whole text."""
    for pdf in batches:
        out = []
        for t in pdf["text"]:
            spans = base_spans(t)
            if spans:
                whole, near_to = _hash(t), _Near(t, _Cover(spans))
                for s in spans:
                    near = near_to(s)
                    for name, spelled in _entities(_value(t, s), s[2]):
                        e = _hash(name)
                        out += [(term, e, whole, term in spelled) for term in near]
                        out.append(("", e, whole, False))
        out = list(set(out))
        yield pd.DataFrame({
            "term": pd.Series([x[0] for x in out], dtype=object), "entity": np.array([x[1] for x in out], np.uint64).view(np.int64),
            "text": np.array([x[2] for x in out], np.uint64).view(np.int64), "spelled": np.array([x[3] for x in out], bool),
        })


class _Terms:
    """Which words are possible terms of a set given as a Bloom filter; remembers some words."""

    def __init__(self, bloom: Bloom):
        self.bloom, self.known = bloom, {}

    def of(self, text: str) -> set[str]:
        words = set(_TERM.findall(text))
        if len(self.known) > 100_000:
            self.known.clear()
        new = [w for w in words if w not in self.known]
        if new:
            ok = self.bloom.has(np.array([_hash(w.lower()) for w in new], np.uint64))
            self.known.update(zip(new, ok.tolist(), strict=True))
        return {w for w in words if self.known[w]}


def _term_hash(col: str = "term") -> Column:
    return F.xxhash64(col)  # XXH64 of the UTF-8 bytes with seed 42, as _hash


def disclosing_terms(docs: DataFrame, text_col: str = "text", smoothing: float = SMOOTHING, residual_bits: float = RESIDUAL_BITS, gained_bits: float = GAINED_BITS) -> DataFrame:
    """(term): lower-cased terms that disclose an entity, by counts over all different texts of docs.

    Copies of a text count once, on both sides of p(entity | term); null and empty texts say nothing; ids are not looked at.
    """
    ensure_checkpoint_dir(docs.sparkSession)
    rows = docs.select(F.col(text_col).alias("text"))
    near = rows.mapInPandas(_evidence, "term string, entity long, text long, spelled boolean").distinct()
    pairs = near.groupBy("entity", "term").agg(F.count("*").alias("n"), F.max("spelled").alias("spelled"))
    # of one text, smoothed: p <= (1 + s p0) / (1 + s), which is below what is asked for
    alone = (1 + smoothing * 2.0**-gained_bits) / (1 + smoothing) < 2.0**-residual_bits
    pairs = pairs.where((F.col("term") == "") | F.col("spelled") | (F.col("n") >= (2 if alone else 1))).checkpoint()
    bloom = rows.sparkSession.sparkContext.broadcast(build_bloom(pairs.where("term <> ''").select(_term_hash().alias("h")), "h"))

    keyed = rows.select(F.xxhash64("text").alias("key"), "text")
    repeated = rows.sparkSession.sparkContext.broadcast(build_bloom(keyed.groupBy("key").count().where("count > 1"), "key"))

    def count(batches, once: bool):
        release_memory()
        for pdf in batches:
            terms, got, seen = _Terms(bloom.value), {}, 0
            for t in pdf["text"][~repeated.value.has(pdf["key"].to_numpy(np.int64))] if once else pdf["text"]:
                if t:
                    seen += 1
                    for w in {w.lower() for w in terms.of(t)}:
                        got[w] = got.get(w, 0) + 1
            yield pd.DataFrame({"term": ["", *got], "n": [seen, *got.values()]})

    # copies of a text count once, as they do in near; only texts that may have copies are shuffled
    maybe = F.pandas_udf(lambda k: pd.Series(repeated.value.has(k.to_numpy(np.int64))), "boolean", F.PandasUDFType.SCALAR)
    parts = keyed.mapInPandas(lambda b: count(b, True), "term string, n long").union(keyed.where(maybe("key")).dropDuplicates(["key"]).mapInPandas(lambda b: count(b, False), "term string, n long"))
    counts = parts.groupBy("term").agg(F.sum("n").alias("n")).checkpoint()
    total = counts.where("term = ''").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    entities = pairs.where("term = ''").select("entity", F.col("n").alias("of_entity"))
    found = pairs.where("term <> ''").join(counts.where("term <> ''").withColumnRenamed("n", "of_term"), "term").join(entities, "entity")
    prior = F.col("of_entity") / F.lit(float(total))
    more = F.when(F.col("spelled"), 0.0).otherwise(smoothing)
    residual = -F.log2(F.least(F.lit(1.0), (F.col("n") + more * prior) / (F.col("of_term") + more)))
    gained = F.log2(F.least(F.lit(1.0), F.col("n") / F.col("of_term")) / prior)
    return found.where((residual <= residual_bits) & (gained >= gained_bits)).select("term").distinct()


_SPANS = "array<struct<start:int,end:int,kind:string>>"


def _found_in(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(row, id, base, spans), a row for each row of docs: base spans, and these with the disclosing terms.

    row: hash of id and text; rows of equal id and hash have equal spans.
    """
    bloom = docs.sparkSession.sparkContext.broadcast(build_bloom(terms.select(_term_hash().alias("h")), "h"))
    rows = docs.select(F.xxhash64(id_col, text_col).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))

    def find(batches):
        release_memory()
        for pdf in batches:
            possible, base, term = _Terms(bloom.value), [], []
            for t in pdf["text"]:
                spans = base_spans(t)
                base.append([{"start": s, "end": e, "kind": k} for s, e, k in spans])
                hit = possible.of(t) if t else ()
                at = [(m[0].lower(), *m.span()) for m in _TERM.finditer(t) if m[0] in hit] if hit else []
                covered = _Cover(spans)
                term.append([{"term": w, "start": s, "end": e} for w, s, e in at if not covered(s, e)])
            yield pd.DataFrame({"row": pdf["row"], "id": pdf["id"], "base": base, "terms": term})

    found = rows.mapInPandas(find, f"row long, id {dict(rows.dtypes)['id']}, base {_SPANS}, terms array<struct<term:string,start:int,end:int>>").checkpoint()
    sure = found.where(F.size("terms") > 0).select("row", "id", F.explode("terms").alias("t")).distinct().join(terms, F.col("t.term") == F.col("term"))
    sure = sure.groupBy(F.col("row").alias("_r"), F.col("id").alias("_i")).agg(F.collect_list(F.struct(F.col("t.start").alias("start"), F.col("t.end").alias("end"), F.lit("term").alias("kind"))).alias("more"))
    all_ = F.concat("base", F.coalesce("more", F.array().cast(_SPANS)))
    order = F.transform(all_, lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("k"), s["end"].alias("end"), s["kind"].alias("kind")))
    spans = F.transform(F.array_sort(order), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    return found.join(sure, (F.col("row") == F.col("_r")) & F.col("id").eqNullSafe(F.col("_i")), "left").select("row", "id", "base", spans.alias("spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, spans), a row for each row of docs, repeated rows included. Null and empty texts have no spans.

    base: the patterns' spans; spans: with those of disclosing terms, kind 'term'; in code points, end exclusive.
    """
    terms = disclosing_terms(docs, text_col).checkpoint()
    return _found_in(docs, id_col, text_col, terms).select(F.col("id").alias(id_col), "base", "spans")


def _replace(text: str, spans) -> str:
    out, at = [], 0
    for s, e, k in sorted(spans):
        if e <= at:
            continue
        out += [text[at : max(s, at)], GENERAL[k] if s >= at else ""]
        at = e
    return "".join(out) + text[at:]


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each span in its text put in general terms ([EMAIL], [TERM], ...); of overlapping spans the first stands for both.

    Only texts that may hold a disclosing term are shuffled, to meet the exact list of terms. Null texts stay null.
    """
    terms = disclosing_terms(docs, text_col).checkpoint()
    found = _found_in(docs, id_col, text_col, terms).where(F.exists("spans", lambda s: s["kind"] == "term"))
    spotted = found.select(F.col("row").alias("_row"), F.col("id").alias("_id"), "spans").dropDuplicates(["_row", "_id"]).checkpoint()

    @F.pandas_udf("string")
    def general(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else _replace(t, base_spans(t) if s is None else [(x["start"], x["end"], x["kind"]) for x in s]) for t, s in zip(texts, spans, strict=True)])

    def plain(texts: pd.Series) -> pd.Series:
        return pd.Series([t if t is None else _replace(t, base_spans(t)) for t in texts], dtype=object)

    doc = F.struct(*[quoted(c) for c in docs.columns])
    keyed = docs.select(doc.alias("_doc"), F.xxhash64(quoted(id_col), quoted(text_col)).alias("_key"), quoted(id_col).alias("_of"), quoted(text_col).alias("_text"))
    rest, maybe = split_by_bloom(keyed, "_key", spotted.select(F.col("_row").alias("_key")), beside=("_text", plain, "string"))
    maybe = maybe.join(spotted, (F.col("_key") == F.col("_row")) & F.col("_of").eqNullSafe(F.col("_id")), "left")
    out = rest.select("_doc", F.col("_beside").alias("_text")).union(maybe.select("_doc", general("_text", "spans").alias("_text")))
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col("_doc")[c].alias(c) for c in docs.columns])


def spans_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3(spark, sf_dir):
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of documents, repeated rows and null ids included.

    Null and empty texts have no spans: zeros, the digest of the empty string, and ''. Texts of any length are searched whole.
    """
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(spans_text(F.col("base")).cast("binary"), 256).alias("base_sha256"), spans_text(F.col("spans")).alias("spans"))
