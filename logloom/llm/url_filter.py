"""URL filters: rules first, then a blocked Bloom filter of listed canonical URLs, then an exact join."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import quoted, stored, table

#: Fixed values: (verdict, host, path).
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
#: The parts of the URLs that op10 has listed where no list is given; see default_list.
LISTED = {
    "sub": ("", "blog.", "m."), "site": ("ads-track", "casino-win", "cheap-pills", "spam-farm"), "top": ("com", "net", "org"), "lang": ("de", "en", "es", "fr"),
    "first": 1000, "last": 9999,
}

#: Blocks of one 64-bit word, four bits a URL: one for each four URLs listed, but 2^20 at most (about 16 MB to broadcast, enough
#: for four million URLs). A longer list passes more URLs that are not on it to the exact join.
BLOOM_BLOCKS = 1 << 20
KEYS_A_BLOCK = 4
_PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def url_host(url: Column) -> Column:
    """Text after the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; '' for null or without '://'."""
    found = F.coalesce(F.regexp_extract(url, _PARTS, 1), F.lit(""))
    return F.translate(found, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _PARTS, 2), F.lit(""))


def canonical_url(host: Column, path: Column) -> Column:
    """Host without 'www.' and path without trailing slashes; scheme, query and fragment don't count. Null where there is no host."""
    c = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))
    return F.when(host != "", c)


def rule_columns(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits; null where none does."""
    name = verdict = F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is outermost
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _bloom_address(key: str, blocks: int) -> tuple[Column, Column]:
    """Block of a key, and its four bits in the block's word."""
    bits = " | ".join(f"shiftleft(1L, cast(shiftrightunsigned(xxhash64({key}, 1), {s}) & 63 as int))" for s in (0, 6, 12, 18))
    return F.expr(f"cast(pmod(xxhash64({key}), {blocks}) as int)"), F.expr(bits)


def blocked_bloom(listed: DataFrame, key: str, blocks: int = BLOOM_BLOCKS) -> DataFrame:
    """(block, word): at most `blocks` rows."""
    block, bits = _bloom_address(key, blocks)
    return listed.where(F.col(key).isNotNull()).select(block.alias("block"), bits.alias("bits")).groupBy("block").agg(F.bit_or("bits").alias("word"))


def bloom_blocks(urls: int) -> int:
    """Blocks for a list of so many URLs."""
    return min(BLOOM_BLOCKS, max(64, 1 << (max(urls, 1) // KEYS_A_BLOCK).bit_length()))


def filter_urls(pages: DataFrame, listed: DataFrame, id_col: str = "page_id", url_col: str = "url", listed_url_col: str = "url", rules=RULES, blocks: int | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, listed), a row for each row of pages, repeated rows and null ids kept; other columns are not looked at.

    listed: the URLs to block, one a row; they may repeat or be null. A rule's verdict stands; else URLs whose canonical form is listed are
    blocked, the others allowed. Null URLs and URLs without '://' have empty host and path, no rule, and are allowed.
    The filter's blocks are broadcast, 2^20 at most; only possible hits reach the exact join with the list,
    a shuffled one that AQE splits where one URL holds many rows.
    """
    keys = listed.select(canonical_url(url_host(quoted(listed_url_col)), url_path(quoted(listed_url_col))).alias("_listed")).where("_listed is not null").distinct()
    keys = stored(keys)  # counted, and read by filter and join
    if blocks is None:
        blocks = bloom_blocks(keys.count())
    block, bits = _bloom_address("_key", blocks)
    rows = pages.select(quoted(id_col).alias("_id"), url_host(quoted(url_col)).alias("host"), url_path(quoted(url_col)).alias("path"))
    rows = rows.withColumn("_key", canonical_url(F.col("host"), F.col("path"))).withColumn("_block", block).withColumn("_bits", bits)
    bloom = F.broadcast(blocked_bloom(keys, "_listed", blocks))
    rows = rows.join(bloom, rows["_block"] == bloom["block"], "left")
    rows = rows.withColumn("_maybe", F.coalesce(F.col("word").bitwiseAND(F.col("_bits")) == F.col("_bits"), F.lit(False)) & F.col("_key").isNotNull())
    cols = ["_id", "host", "path"]
    hit = rows.where("_maybe").select(*cols, "_key").join(keys, F.col("_key") == F.col("_listed"), "left").select(*cols, F.col("_listed").isNotNull().alias("listed"))
    rest = rows.where("not _maybe").select(*cols, F.lit(False).alias("listed"))
    rule, verdict = rule_columns(F.col("host"), F.col("path"), rules)
    return hit.union(rest).select(
        F.col("_id").alias(id_col), "host", "path", rule.alias("rule"),
        F.coalesce(verdict, F.when(F.col("listed"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"), "listed",
    )


def default_list(spark: SparkSession, parts: dict = LISTED) -> DataFrame:
    """(url): http://<sub><site>.example.<top>/<lang>/<number> of all parts and numbers, 1.3 million URLs that no table is looked at for.

    Pages of the same hosts at other paths (.html, and languages and numbers beyond) are not listed.
    """
    of = lambda name: F.explode(F.array(*map(F.lit, parts[name]))).alias(name)
    numbers = spark.range(parts["first"], parts["last"] + 1).withColumnRenamed("id", "number")
    rows = numbers.select("number", of("sub")).select("*", of("site")).select("*", of("top")).select("*", of("lang"))
    return rows.select(F.concat(F.lit("http://"), "sub", "site", F.lit(".example."), "top", F.lit("/"), "lang", F.lit("/"), F.col("number").cast("string")).alias("url"))


def op10(spark, sf_dir, list_path: str | None = None):
    """(page_id, host, path, rule, verdict), a row for each row of pages.

    list_path: a Parquet table of listed URLs, column url; else default_list. Null and odd URLs as in filter_urls.
    """
    listed = spark.read.parquet(list_path) if list_path else default_list(spark)
    return filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), listed).select("page_id", "host", "path", "rule", "verdict")


_HOST = r"translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_RULE_SQL = " ".join(
    f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{{{i}}}'" for i, (_, h, p) in sorted(enumerate(RULES), key=lambda r: -len(r[1][1] + r[1][2]))
)
OP10_SQL = f"""
WITH u AS (SELECT page_id, {_HOST} AS host, coalesce(regexp_extract(url, '^.*?://([^/?#]*)([^?#]*)', 2, 's'), '') AS path FROM pages),
k AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, '^www\\.', '') || regexp_replace(path, '/+$', '') END AS ckey FROM u),
l AS (SELECT sub || site || '.example.' || top || '/' || lang || '/' || number AS lkey
  FROM {", ".join(f"(VALUES {', '.join(f'({x!r})' for x in LISTED[k])}) AS t_{k}({k})" for k in ("sub", "site", "top", "lang"))}, range({LISTED["first"]}, {LISTED["last"] + 1}) AS t_number(number))
SELECT page_id, host, path, CASE {_RULE_SQL.format(*[h + p for _, h, p in RULES])} END AS rule,
  CASE {_RULE_SQL.format(*[v for v, _, _ in RULES])} WHEN lkey IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict
FROM k LEFT JOIN l ON ckey = lkey
"""
