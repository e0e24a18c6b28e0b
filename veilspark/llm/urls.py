"""URL filters: path rules, then a blocked Bloom filter of listed URLs with an exact join behind it. DataFrame functions only."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm.common import ascii_lower, stash, table

# Fixed values: (host, path, verdict) rules; the site names whose pages the production query lists, and the runs of signs in titles that pages elsewhere are listed for.
RULES = (("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block"))
LISTED_SITES = ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm")
JUNK_TITLE = "<title>[^<]*([%][%][%]|[*][*][*]|[#][#][#])"

BITS_PER_URL, HASHES = 16, 6
#: A filter up to this size goes to every executor; a larger one is joined by its block number.
BROADCAST_BYTES = 32 << 20


def host_path(url: Column) -> tuple[Column, Column]:
    pattern = "(?s)^.*?://([^/?#]*)([^?#]*)"
    return (ascii_lower(F.coalesce(F.regexp_extract(url, pattern, 1), F.lit(""))), F.coalesce(F.regexp_extract(url, pattern, 2), F.lit("")))


def canonical(host: Column, path: Column) -> Column:
    """Host without a default port and path without closing slashes: scheme, query and fragment don't count."""
    return F.concat(F.regexp_replace(host, ":(80|443)?$", ""), F.regexp_replace(path, "/+$", ""))


def fitting_rule(host: Column, path: Column, rules) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule whose host and subdomains hold ``host`` and whose path starts ``path``."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        name, verdict = F.when(fits, h + p).otherwise(name), F.when(fits, v).otherwise(verdict)
    return name, verdict


def _mask(h: Column) -> Column:
    bits = [F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63)).cast("int")) for k in range(HASHES)]
    return functools.reduce(lambda a, b: a.bitwiseOR(b), bits)


def block_of(url: Column, n_blocks: int) -> Column:
    return F.xxhash64(url, F.lit("block")).bitwiseAND(F.lit(n_blocks - 1))


def bloom_blocks(listed: DataFrame, n_blocks: int) -> DataFrame:
    """A blocked Bloom filter of ``listed`` (url) as rows (block, bits): every URL sets its bits in one 64-bit block."""
    rows = listed.select(block_of(F.col("url"), n_blocks).alias("block"), _mask(F.xxhash64("url")).alias("m"))
    return rows.groupBy("block").agg(F.bit_or("m").alias("bits"))


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and listed for every row of ``pages``.

    Where a rule fits, the longest decides. Elsewhere a page is blocked if its canonical URL is among the canonical URLs
    of ``listed`` (url): its hash must first pass the blocked Bloom filter, then an equality join removes false hits, so that
    only possible hits are shuffled. Null URLs and URLs without ``://`` have an empty host and path; those, like all URLs
    that aren't listed, are allowed. Repeated pages each get a row; empty tables give no rows, other columns are ignored.
    """
    host, path = host_path(F.col("url"))
    keys = listed.select(*[c.alias(n) for c, n in zip(host_path(F.col("url")), ("h", "p"))]).select(canonical(F.col("h"), F.col("p")).alias("url"))
    keys = stash(keys.where("url <> ''").distinct(), "listed")
    n_blocks = 1 << max(0, (keys.count() * BITS_PER_URL // 64)).bit_length()
    blocks = bloom_blocks(keys, n_blocks)
    if n_blocks * 24 <= BROADCAST_BYTES:
        blocks = F.broadcast(blocks)
    known = keys.select(F.col("url").alias("k"))
    small = (keys.agg(F.sum(F.octet_length("url") + 64)).first()[0] or 0) <= BROADCAST_BYTES
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("by_rule"), canonical(F.col("host"), F.col("path")).alias("url"))
    rows = rows.withColumn("b", block_of(F.col("url"), n_blocks)).join(blocks, F.col("b") == F.col("block"), "left")
    m = _mask(F.xxhash64("url"))
    possible = F.col("by_rule").isNull() & F.coalesce(F.col("bits").bitwiseAND(m) == m, F.lit(False))
    if small:
        # one pass: what can't be listed looks nothing up
        out = rows.withColumn("hit", F.when(possible, F.col("url"))).join(F.broadcast(known), F.col("hit") == F.col("k"), "left").withColumn("listed", F.col("k").isNotNull())
    else:
        # only possible hits are shuffled, so pages are read once for them and once for the others
        sure = rows.where(~possible).withColumn("listed", F.lit(False))
        maybe = rows.where(possible).join(known, F.col("url") == F.col("k"), "left").withColumn("listed", F.col("k").isNotNull())
        cols = ["page_id", "host", "path", "rule", "by_rule", "listed"]
        out = sure.select(*cols).unionAll(maybe.select(*cols))
    return out.select("page_id", "host", "path", "rule", F.coalesce("by_rule", F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))


def listed_pages(pages: DataFrame) -> DataFrame:
    """The URLs of all pages of LISTED_SITES, on any subdomain, and of pages anywhere whose title has runs of signs: the block list of the production query."""
    host, _ = host_path(F.col("url"))
    return pages.where(host.rlike("(^|[.])(" + "|".join(LISTED_SITES) + ")[.]") | F.coalesce(F.col("html").rlike(JUNK_TITLE), F.lit(False))).select("url")


def op6_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages, listed_pages(pages))


ORACLE = r"""
with u as (select page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
           coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') as path, coalesce(regexp_matches(html, '<title>[^<]*([%][%][%]|[*][*][*]|[#][#][#])'), false) as junk from pages),
r(h, p, v) as (values ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
b as (select x.host, x.path, max_by(r.h || r.p, length(r.h || r.p)) as rule, max_by(r.v, length(r.h || r.p)) as v
      from (select distinct host, path from u) x join r on (x.host = r.h or x.host like '%.' || r.h) and starts_with(x.path, r.p) group by 1, 2),
k as (select distinct regexp_replace(host, ':(80|443)?$', '') || regexp_replace(path, '/+$', '') as url from u
      where (junk or regexp_matches(host, '(^|[.])(ads-track|adult-x|casino-win|cheap-pills|free-bets|spam-farm)[.]')) and host <> '')
select u.page_id, u.host, u.path, b.rule,
       coalesce(b.v, case when regexp_replace(u.host, ':(80|443)?$', '') || regexp_replace(u.path, '/+$', '') in (select url from k) then 'block' else 'allow' end) as verdict
from u left join b on u.host = b.host and u.path = b.path
"""
