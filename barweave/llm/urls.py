"""URL filter: rules by host and path, then a list of canonical URLs behind a blocked Bloom filter.

The filter is a table of blocks of eight 32-bit words; a listed URL sets one bit in each word of one block. It is built
by a hash aggregation (`bit_or` per block) and has at most `MAX_BLOCKS` blocks, whatever the length of the list, so it
may be broadcast. A URL whose eight bits are set is a possible hit; an exact hash join with the list removes the false
positives. A longer list only makes the filter less selective, never the verdicts wrong.

Defined cases: a null URL or one without `://` has an empty host and path, no rule and no canonical form, and is
allowed. Repeated URLs are judged alike. Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from barweave.llm.common import lower_ascii, stored, table

RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
TRACKING = ("utm_", "ref=")
BITS_PER_URL = 16
MAX_BLOCKS = 1 << 17  # times 40 bytes: the most that is ever broadcast
WORDS = 8


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Host (A-Z lower-cased), path and query; null parts where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(rest, r"^[^?#]*\?([^#]*)", 1)
    return host, path, query


def canonical_url(host: Column, path: Column, query: Column) -> Column:
    """Host without www. or m., path without a final slash, query without tracking parameters, no scheme or fragment."""
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(p, F.lit(TRACKING[0])) & ~F.startswith(p, F.lit(TRACKING[1])))
    tail = F.array_join(kept, "&")
    return F.concat(
        F.regexp_replace(host, r"^(www|m)\.", ""), F.regexp_replace(path, r"/$", ""), F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise("")
    )


def match_rules(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null without one. The rules are a short fixed list."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, rule_host, rule_path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == rule_host) | F.endswith(host, F.lit("." + rule_host))) & F.startswith(path, F.lit(rule_path))
        rule, verdict = F.when(fits, rule_host + rule_path).otherwise(rule), F.when(fits, what).otherwise(verdict)
    return rule, verdict


def _block(url: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(blocks)).cast("int")


def _bits(url: Column) -> list[Column]:
    """The bit of each word, from hashes that are independent of the block's."""
    one, two = F.xxhash64(url, F.lit(1)), F.xxhash64(url, F.lit(2))
    parts = [F.shiftrightunsigned(h, 5 * i).bitwiseAND(F.lit(31)).cast("int") for h in (one, two) for i in range(WORDS // 2)]
    return [F.call_function("shiftleft", F.lit(1), p) for p in parts]


def bloom_blocks(listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> tuple[DataFrame, int]:
    """(block, w0..w7) of a list with the column `url`, and the number of blocks."""
    wanted = listed.count() * BITS_PER_URL // (32 * WORDS) + 1
    blocks = min(max_blocks, 1 << (wanted - 1).bit_length())
    words = [F.bit_or(b).alias(f"w{i}") for i, b in enumerate(_bits(F.col("url")))]
    return listed.where("url is not null").groupBy(_block(F.col("url"), blocks).alias("block")).agg(*words), blocks


def in_list(urls: DataFrame, listed: DataFrame, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """The distinct values of the column `url` of `urls` that are in the distinct `url` of `listed`, exactly."""
    filter_table, blocks = bloom_blocks(listed, max_blocks)
    u = F.col("url")
    probed = urls.select("url").where("url is not null").withColumn("block", _block(u, blocks)).join(F.broadcast(filter_table), "block")
    for i, bit in enumerate(_bits(u)):
        probed = probed.where(F.col(f"w{i}").bitwiseAND(bit) != 0)
    # distinct before the shuffle: a URL that fills a third of the rows becomes one row per task
    return probed.select("url").distinct().join(listed, "url", "left_semi")


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES, max_blocks: int = MAX_BLOCKS) -> DataFrame:
    """page_id, host, path, rule, verdict, canonical for each row of (page_id, url); `listed` has one canonical `url` a row."""
    host, path, query = url_parts(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"), canonical_url(host, path, query).alias("canonical"))
    rule, verdict = match_rules(F.col("host"), F.col("path"), rules)
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("by_rule"))
    hits = in_list(ruled.where("by_rule is null").select(F.col("canonical").alias("url")), listed, max_blocks)
    hits = hits.select(F.col("url").alias("canonical"), F.lit("block").alias("by_list"))
    return ruled.join(hits, "canonical", "left").select(
        "page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule",
        F.coalesce("by_rule", "by_list", F.lit("allow")).alias("verdict"), "canonical",
    )


def tracked_urls(pages: DataFrame) -> DataFrame:
    """The list the query uses: canonical URLs that some page was fetched from through a `utm_` link."""
    host, path, query = url_parts(F.col("url"))
    tracked = F.exists(F.split(query, "&"), lambda p: F.startswith(p, F.lit(TRACKING[0])))
    return pages.where(tracked).select(canonical_url(host, path, query).alias("url")).distinct()


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return filter_urls(pages, stored(tracked_urls(pages), "listed"))


ORACLE = r"""
WITH cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path,
    string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&') AS params FROM cut
), canon AS (
  SELECT *, array_to_string(list_filter(params, lambda p: p <> '' AND NOT starts_with(p, 'utm_') AND NOT starts_with(p, 'ref=')), '&') AS tail
  FROM parts
), named AS (
  SELECT *, regexp_replace(host, '^(www|m)\.', '') || regexp_replace(path, '/$', '')
    || CASE WHEN tail <> '' THEN '?' || tail ELSE '' END AS canonical,
    len(list_filter(params, lambda p: starts_with(p, 'utm_'))) > 0 AS tracked FROM canon
), listed AS (SELECT DISTINCT canonical AS url FROM named WHERE tracked),
rules(what, rh, rp) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
best AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(what, length(rh || rp)) AS verdict
  FROM named JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id
)
SELECT n.page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, b.rule,
  coalesce(b.verdict, CASE WHEN l.url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict, n.canonical
FROM named n LEFT JOIN best b USING (page_id) LEFT JOIN listed l ON l.url = n.canonical
"""
