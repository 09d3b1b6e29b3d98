"""Source divergence audit: how the terms of each source of a language differ from those of its other sources, and from the language.

Terms are found in bytes: a table of 256 entries says which bytes belong to a term, and one pass over the concatenated UTF-8 texts of many
documents finds all boundaries. Slices are grouped by XXH64, and each slice's bytes are held against those of its group. Counts of
(lang, source, term) are summed by Spark, before and after the shuffle.

Each language's terms are dealt by hash into blocks of about BLOCK counts, and its sources into tiles of TILE; a task holds, of one block, the
counts of two tiles as CSR matrices, a row for each source. A divergence is a sum over all kept terms, most of which a source lacks, so it
is put together from the terms that one, the other or both have, by `reduceat` along the rows, and from what two sources give that have neither.
All in whole numbers of 64 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SHORT, eights, quoted, release_memory, slice_hashes, stored, table

LEAST_DOCS, PARTS, TOP = 3, 9, 200  # documents of a language that have a kept term; 10^9 parts; ranks of the part `term`
BLOCK, TILE = 200_000, 512
CHUNK = 4 << 20  # bytes of text that are cut at a time
_BYTES = np.arange(256, dtype=np.uint8)
IS_TERM = (_BYTES >= 0x80) | ((_BYTES | 0x20) >= 0x61) & ((_BYTES | 0x20) <= 0x7A)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES | 0x20, _BYTES).astype(np.uint8)
_COUNTS = "lang string, source string, term string, count long, docs long"


# -- terms --------------------------------------------------------------------------------------------


def boundaries(buf: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, end) of each term of texts that follow each other in buf, each text's end in `ends`; no term spans two texts."""
    inside = np.zeros(len(buf) + 2, bool)
    inside[1:-1] = IS_TERM[buf]
    before, after = inside[:-1], inside[1:]
    start, end = after & ~before, before & ~after
    cut = ends[(ends > 0) & (ends < len(buf))]
    cut = cut[inside[cut] & inside[cut + 1]]  # a text ends within a run: a term ends and another begins
    start[cut] = end[cut] = True
    return np.flatnonzero(start), np.flatnonzero(end)


def _same_bytes(data: bytes, buf: np.ndarray, start: np.ndarray, size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether each slice has the bytes of the slice numbered `other`."""
    eight, _ = eights(buf)
    same = size == size[other]
    for lane in range(SHORT // 8):
        k = np.flatnonzero(same & (size > 8 * lane) & (size < SHORT))
        over = np.maximum(8 * (lane + 1) - size[k], 0).astype(np.uint64) * np.uint64(8)  # bits of the eight that are not the slice's
        same[k] = ((eight[start[k] + 8 * lane] ^ eight[start[other[k]] + 8 * lane]) << over) == 0
    for i in np.flatnonzero(same & (size >= SHORT)).tolist():
        a, b = start[i], start[other[i]]
        same[i] = data[a : a + size[i]] == data[b : b + size[i]]
    return same


def group_slices(data: bytes, buf: np.ndarray, start: np.ndarray, end: np.ndarray, digest=slice_hashes) -> tuple[np.ndarray, np.ndarray]:
    """(group of each slice, a slice of each group): slices are of one group if, and only if, their bytes are equal.

    Grouped by their hash; then the bytes of each are held against those of its group's first, and what differs is grouped by the bytes themselves.
    """
    _, first, group = np.unique(digest(data, buf, start, end), return_index=True, return_inverse=True)
    equal = _same_bytes(data, buf, start, end - start, first[group])
    if not equal.all():
        own: dict[bytes, int] = {}
        more = []
        for i in np.flatnonzero(~equal):
            key = data[start[i] : end[i]]
            if key not in own:
                own[key] = len(first) + len(more)
                more.append(i)
            group[i] = own[key]
        first = np.concatenate([first, np.array(more, first.dtype)])
    return group, first


def _counted(lang: pa.Array, source: pa.Array, buf: np.ndarray, ends: np.ndarray) -> pa.RecordBatch | None:
    """_COUNTS of some whole documents, given by the end of each text in buf: occurrences, and documents that have the term."""
    buf = LOWER[buf]
    start, end = boundaries(buf, ends)
    if not len(start):
        return None
    data = buf.tobytes()
    term, rep = group_slices(data, buf, start, end)
    doc = np.searchsorted(ends, start, side="right")
    lang, source = lang.dictionary_encode(), source.dictionary_encode()
    group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    pair, count = np.unique(doc * np.int64(len(rep)) + term, return_counts=True)  # of a document and a term
    key, at = np.unique(group[pair // len(rep)] * np.int64(len(rep)) + pair % len(rep), return_inverse=True)
    terms = pa.array([data[start[i] : end[i]] for i in rep], pa.binary()).take(pa.array(key % len(rep)))
    of = key // len(rep)
    return pa.RecordBatch.from_arrays(
        [
            lang.dictionary.take(pa.array(of // len(source.dictionary))), source.dictionary.take(pa.array(of % len(source.dictionary))), _as_text(terms),
            pa.array(np.bincount(at, count).astype(np.int64)), pa.array(np.bincount(at)),
        ],
        ["lang", "source", "term", "count", "docs"],
    )


def _as_text(b: pa.Array) -> pa.Array:
    return pa.Array.from_buffers(pa.string(), len(b), b.buffers(), offset=b.offset)  # a term is cut at ASCII bytes, so it is valid where its text is


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, text), null as empty, to _COUNTS: one row for each of a chunk's groups and terms. Chunks hold whole texts, CHUNK bytes or one longer text."""
    release_memory()
    for b in batches:
        lang, source, text = (c if pa.types.is_string(c.type) else c.cast(pa.string()) for c in b.columns)
        offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1] if len(text) else np.zeros(1, np.int32)
        raw = np.frombuffer(text.buffers()[2] or b"", np.uint8)
        i = 0
        while i < len(text):
            j = max(i + 1, int(np.searchsorted(offsets, int(offsets[i]) + CHUNK, side="right")) - 1)
            got = _counted(lang.slice(i, j - i), source.slice(i, j - i), raw[offsets[i] : offsets[j]], (offsets[i + 1 : j + 1] - offsets[i]).astype(np.int64))
            if got is not None:
                yield got
            i = j


# -- divergences --------------------------------------------------------------------------------------


def share(count: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * (count + 1) / n), by long division, so that no product leaves 64 bits."""
    q, r = np.divmod(np.asarray(count, np.int64) + 1, n)
    for _ in range(PARTS):
        d, r = np.divmod(r * 10, n)
        q = q * 10 + d
    return q + 1


def gap(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def _row_sums(x: np.ndarray, indptr: np.ndarray) -> np.ndarray:
    """Sums of x along the rows of a CSR matrix, empty rows included."""
    out = np.zeros(len(indptr) - 1, np.int64)
    full = np.flatnonzero(np.diff(indptr))
    if len(full):
        out[full] = np.add.reduceat(x, indptr[full])
    return out


class _Csr:
    """Counts of some sources: rows are sources, columns terms of the block; what a source's absent terms have is `zero`."""

    def __init__(self, rows: np.ndarray, source: np.ndarray, term: np.ndarray, count: np.ndarray, n: np.ndarray):
        """rows: the sources' numbers, ascending, with n, the divisor of each; source, term, count: the entries."""
        row = np.searchsorted(rows, source)
        ok = (row < len(rows)) & (rows[np.minimum(row, len(rows) - 1)] == source)
        row, term, count = row[ok], term[ok], count[ok]
        order = np.lexsort((term, row))
        row, self.term, self.count = row[order], term[order], count[order]
        self.entry = np.flatnonzero(ok)[order]
        self.indptr = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(rows)))]).astype(np.int64)
        self.row, self.p, self.zero = row, share(self.count, n[row]), share(np.zeros(len(rows), np.int64), n)


def pair_sums(g: _Csr, h: _Csr, terms: int, both_absent: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row of g, sum of gap(p of that row, p of each row of h) over the block's terms). both_absent: terms that count as absent from all, before those found."""
    have_h = np.diff(h.indptr)
    for i in range(len(g.zero)):
        own = slice(g.indptr[i], g.indptr[i + 1])
        p, here = np.full(terms, g.zero[i]), np.zeros(terms, bool)
        p[g.term[own]], here[g.term[own]] = g.p[own], True
        q, met = np.repeat(h.zero, have_h), here[h.term]
        pt = p[h.term]
        # terms that h has; and what those that both have would have added as absent from h
        total = _row_sums(gap(pt, h.p) - np.where(met, gap(pt, q), 0), h.indptr)
        kinds, times = np.unique(g.p[own], return_counts=True)  # equal counts of a source are one kind
        for k in range(0, len(kinds), 1024):
            total += gap(kinds[k : k + 1024, None], h.zero[None, :]).T @ times[k : k + 1024]
        absent = both_absent - (own.stop - own.start) - have_h + _row_sums(met.astype(np.int64), h.indptr)
        yield i, total + absent * gap(np.full(len(h.zero), g.zero[i]), h.zero)


def _divergences(block: pa.Table) -> pa.Table:
    """One block of a language and two tiles of its sources: rows of sources (term null) and of counts, to (lang, source, part, item, value)."""
    release_memory()
    col = {c: block.column(c).combine_chunks() for c in block.column_names}
    of = {c: col[c].to_numpy(zero_copy_only=False) for c in ("block", "tile", "tile_g", "tile_h", "idx", "n", "lang_n", "v")}
    is_source = col["term"].is_null().to_numpy(zero_copy_only=False)
    tile_g, tile_h, v = int(of["tile_g"][0]), int(of["tile_h"][0]), int(of["v"][0])
    idx, n = of["idx"][is_source], of["n"][is_source]
    names, tile = col["source"].filter(pa.array(is_source)), of["tile"][is_source]
    order = np.argsort(idx)
    entries = pa.array(~is_source)
    words = col["term"].filter(entries).dictionary_encode()
    term, source, count = words.indices.to_numpy().astype(np.int64), of["idx"][~is_source], col["count"].filter(entries).to_numpy()
    made = {t: (o := order[tile[order] == t], _Csr(idx[o], source, term, count, n[o]) if v else None) for t in {tile_g, tile_h}}
    (at_g, g), (at_h, h) = made[tile_g], made[tile_h]
    out_g, out_h, value = [], [], []
    # terms that none of the block's sources has stand in no block: they are counted once, in the first
    for i, s in pair_sums(g, h, len(words.dictionary), v if of["block"][0] == 0 else 0) if v else ((i, np.zeros(len(at_h), np.int64)) for i in range(len(at_g))):
        k = np.flatnonzero(idx[at_h] != idx[at_g[i]])
        out_g.append(np.full(len(k), at_g[i]))
        out_h.append(at_h[k])
        value.append(s[k])
    cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    a, b, val = cat(out_g), cat(out_h), cat(value)
    parts = [(names.take(pa.array(a)), "pair", names.take(pa.array(b)), val)]
    if v and tile_g == tile_h:
        q = share(col["total"].filter(entries).to_numpy()[g.entry], of["lang_n"][~is_source][g.entry])
        more = np.flatnonzero(g.p > q)
        f, row, t = gap(g.p[more], q[more]), g.row[more], g.term[more]
        place = np.empty(len(words.dictionary), np.int64)
        place[pc.array_sort_indices(words.dictionary).to_numpy()] = np.arange(len(place))  # bytewise, as UTF-8
        o = np.lexsort((place[t], -f, row))
        start = np.searchsorted(row[o], row[o])
        o = o[np.arange(len(o)) - start < TOP]
        parts.append((names.take(pa.array(at_g[row[o]])), "term", words.dictionary.take(pa.array(t[o])), f[o]))
    lang = col["lang"][0].as_py()
    return pa.concat_tables(
        [pa.table({"lang": pa.array([lang] * len(x), pa.string()), "source": s, "part": pa.array([part] * len(x), pa.string()), "item": item, "value": pa.array(x, pa.int64())}) for s, part, item, x in parts]
    )


def audit(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", top: int = TOP, block: int = BLOCK, tile: int = TILE) -> DataFrame:
    """(lang, source, part, item, value, rank): part `pair` for each other source of the language, all ranks; part `term` for the terms
    that the source has more of than the language, ranks up to `top` (TOP at most).

    Null texts, languages and sources are empty ones, and a language or source without terms has rows too: its pairs. Repeated rows count as documents of
    their own. No documents, no rows. Other columns are not looked at. block, tile: counts and sources that a task holds.
    """
    kind = lambda c: F.coalesce(quoted(c).cast("string"), F.lit(""))
    rows = docs.select(kind(lang_col).alias("lang"), kind(source_col).alias("source"), kind(text_col).alias("text"))
    counts = rows.mapInArrow(count_terms, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counts.withColumns({"_docs": F.sum("docs").over(of_term), "total": F.sum("count").over(of_term), "_least": F.min("source").over(of_term)}).where(F.col("_docs") >= LEAST_DOCS)
    kept = stored(kept.select("lang", "source", "term", "count", "total", (F.col("source") == F.col("_least")).alias("head")))

    sources = rows.select("lang", "source").distinct().join(kept.groupBy("lang", "source").agg(F.sum("count").alias("_n")), ["lang", "source"], "left")
    langs = kept.groupBy("lang").agg(F.count_if("head").alias("_v"), F.count("*").alias("_entries"))
    sources = sources.join(langs, "lang", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("_n", "_v", "_entries")})
    of_lang = Window.partitionBy("lang")
    # a row for each source of a language: the square of their number is in the result
    sources = stored(
        sources.select(
            "lang", "source", (F.row_number().over(of_lang.orderBy("source")) - 1).cast("long").alias("idx"), F.col("_v").alias("v"),
            (F.col("_n") + F.col("_v")).alias("n"), (F.sum("_n").over(of_lang) + F.col("_v")).alias("lang_n"),
            F.ceil((F.col("_entries") + 1) / block).alias("blocks"), F.ceil(F.count("*").over(of_lang) / tile).alias("tiles"),
        )
    )
    entries = kept.join(sources, ["lang", "source"]).withColumn("block", F.pmod(F.xxhash64("term"), F.col("blocks")))
    of_source = sources.withColumns({"term": F.lit(None).cast("string"), "count": F.lit(0).cast("long"), "total": F.lit(0).cast("long")}).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    columns = ["lang", "source", "idx", "v", "n", "lang_n", "term", "count", "total", "block", "tiles"]
    both = entries.select(columns).union(of_source.select(columns)).withColumn("tile", F.floor(F.col("idx") / tile))
    others = F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)
    pairs = F.array_distinct(F.concat(F.transform(others, lambda o: F.struct(F.col("tile").alias("g"), o.alias("h"))), F.transform(others, lambda o: F.struct(o.alias("g"), F.col("tile").alias("h")))))
    both = both.withColumn("_pair", F.explode(pairs)).select(*columns[:-1], "tile", F.col("_pair.g").alias("tile_g"), F.col("_pair.h").alias("tile_h"))
    parts = both.groupBy("lang", "block", "tile_g", "tile_h").applyInArrow(_divergences, "lang string, source string, part string, item string, value long")
    parts = stored(parts)
    best = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pair = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value")).withColumn("rank", F.row_number().over(best))
    term = parts.where("part = 'term'").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= min(top, TOP))
    return pair.union(term.select(pair.columns))


def op13(spark, sf_dir):
    """(lang, source, part, item, value, rank) of all documents; odd rows as in `audit`."""
    return audit(table(spark, sf_dir, "documents").select("lang", "source", "text"))


OP13_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS n, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
o AS (SELECT n, lang, source, unnest(regexp_extract_all(text, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term FROM d),
k AS MATERIALIZED (SELECT lang, term, count(*) AS total FROM o GROUP BY lang, term HAVING count(DISTINCT n) >= {LEAST_DOCS}),
c AS MATERIALIZED (SELECT lang, source, term, count(*) AS c FROM o SEMI JOIN k USING (lang, term) GROUP BY lang, source, term),
g AS MATERIALIZED (SELECT lang, source, coalesce(sum(c), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
l AS (SELECT lang, sum(n) AS n FROM g GROUP BY lang), v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
p AS MATERIALIZED (SELECT g.lang, g.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + (1000000000 * (coalesce(c.c, 0) + 1)) // (g.n + v) AS HUGEINT) AS p,
    CAST(1 + (1000000000 * (total + 1)) // (l.n + v) AS HUGEINT) AS q
  FROM g JOIN k ON g.lang = k.lang JOIN l ON g.lang = l.lang JOIN v ON g.lang = v.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(value, 0) AS value
    FROM g AS x JOIN g AS y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source
  UNION ALL SELECT lang, source, 'term', term, (p - q) * (p - q) // q FROM p WHERE c > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM r QUALIFY part = 'pair' OR rank <= {TOP}
"""
