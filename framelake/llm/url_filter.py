"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter; DataFrame and SQL functions only.

The filter is a table with a row a block of 512 bits, eight words of 64. A listed URL's hash picks the
block, another hash six bits for each word, and one bit is set in each of the eight. So a look-up
is one equi-join on the block number, whose small side is broadcast while its size, known from the count of
the list, allows it. What passes the filter goes to an exact hash join with the list, which removes false
positives; what does not pass is not shuffled again. The filter never misses a listed URL, so verdicts are exact.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm.common import materialize, table

#: (verdict, host, path) of the query's rules.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The query's list has the pages of hosts that have one of these labels.
LISTED_LABELS = ("adult-x", "ads-track", "casino-win", "cheap-pills", "free-bets", "spam-farm")
#: Query parameters that do not tell pages apart.
TRACKING = "utm_.*|ref|fbclid|gclid"
#: Words of a block, bits of a listed URL, and bytes of a filter or list that is broadcast at most (a row counts as ROW_BYTES).
WORDS, BITS, BROADCAST_BYTES, ROW_BYTES = 8, 16, 32 << 20, 120
#: Rules are a chain of conditions, so there is a bound.
MOST_RULES = 1000


def _lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _rest(url: Column) -> Column:
    """What follows the first ://, null without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + F.lit(3)))


def host(url: Column) -> Column:
    """From behind the first :// to the next slash, question mark, number sign or the end, A-Z lower-cased; empty for null or without ://."""
    return F.coalesce(_lower(F.regexp_extract(_rest(url), r"^[^/?#]*", 0)), F.lit(""))


def path(url: Column) -> Column:
    """What follows the host, to the next question mark, number sign or the end; empty for null or without ://."""
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def canonical(url: Column) -> Column:
    """One form for the URLs of a page: no scheme, user, `www.` or `m.`, standard port, fragment, closing slashes of the path or tracking parameter; the other parameters in order.

    Null for null, without :// and with an empty host.
    """
    h = F.regexp_replace(F.regexp_replace(F.regexp_replace(host(url), r"^.*@", ""), r":(80|443)?$", ""), r"^(www|m)\.", "")
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(rf"^({TRACKING})(=|$)")))
    return F.when(h != "", F.concat(h, F.regexp_replace(path(url), r"/+$", ""), F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def matched_rule(h: Column, p: Column, rules: Sequence[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule as host and path, its verdict) of the longest rule that fits, by characters of host and path, the longer host first; nulls where none does.

    A rule fits its host and all subdomains, if the path starts with the rule's.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules, at most {MOST_RULES}")
    none = F.lit(None).cast("string")
    name, verdict = none, none
    for v, rh, rp in sorted(rules, key=lambda r: (len(r[1]) + len(r[2]), len(r[1]))):
        fits = ((h == rh) | F.endswith(h, F.lit("." + rh))) & F.startswith(p, F.lit(rp))
        name, verdict = F.when(fits, F.lit(rh + rp)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _place(c: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(blocks).cast("bigint"))


def _bits(c: Column) -> list[Column]:
    """Eight bit numbers of 0 to 63, from a hash that is independent of the block's."""
    h = F.xxhash64(c, F.lit("bits"))
    return [F.shiftrightunsigned(h, 6 * k).bitwiseAND(F.lit(63).cast("bigint")).cast("int") for k in range(WORDS)]


def blocked_bloom(listed: DataFrame, column: str, n: int, bits: int = BITS) -> tuple[DataFrame, int]:
    """(filter table (block, w0 to w7), number of blocks) over a column of listed; n is about the number of its rows. Nulls are left out."""
    blocks = max(1, -(-n * bits // (64 * WORDS)))
    c = F.col(column)
    each = listed.where(c.isNotNull()).select(_place(c, blocks).alias("block"), F.array(*_bits(c)).alias("bit"))
    words = [F.bit_or(F.expr(f"shiftleft(1L, bit[{k}])")).alias(f"w{k}") for k in range(WORDS)]
    return each.groupBy("block").agg(*words), blocks


def _may_be_listed(rows: DataFrame, column: str, bloom: DataFrame, blocks: int, flag: str) -> DataFrame:
    """rows with a boolean column flag: false only where the filter does not hold the value. A null is held by no filter."""
    c = F.col(column)
    # no row waits in one place for a partner that null has not
    at = F.coalesce(F.when(c.isNotNull(), _place(c, blocks)), -1 - F.pmod(F.xxhash64(*rows.columns), F.lit(4096).cast("bigint")))
    fits = blocks * ROW_BYTES <= BROADCAST_BYTES
    met = rows.withColumn("block", at).join(F.broadcast(bloom) if fits else bloom, "block", "left")
    hits = [F.expr(f"shiftright(w{k}, bit[{k}]) & 1L") == 1 for k in range(WORDS)]
    met = met.withColumn("bit", F.array(*_bits(c)))
    return met.select(*rows.columns, F.coalesce(reduce(Column.__and__, hits), F.lit(False)).alias(flag))


def judge(pages: DataFrame, listed: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, key: str = "page_id", url: str = "url", bits: int = BITS) -> DataFrame:
    """(key, host, path, canonical, rule, verdict, passed_filter, listed) for every row of pages.

    The longest rule that fits decides; else a page is blocked when its canonical URL is in listed (a frame with a column canonical, nulls and
    repeated rows allowed), and allowed otherwise. A null URL and one without :// have an empty host and
    path, fit no rule and are on no list: allowed. Rows with a null key and repeated rows are judged each. Other columns of pages are ignored. An
    empty list blocks nothing.
    """
    listed = materialize(listed.where("canonical is not null").select("canonical").distinct(), "listed")
    n = listed.count()
    bloom, blocks = blocked_bloom(listed, "canonical", n, bits)
    u = F.col(url)
    rows = pages.select(F.col(key).alias("k"), host(u).alias("host"), path(u).alias("path"), canonical(u).alias("canonical"))
    name, verdict = matched_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", name.alias("rule"), verdict.alias("ruled"))
    probed = _may_be_listed(rows, "canonical", bloom, blocks, "passed_filter")
    exact = listed.select("canonical", F.lit(True).alias("listed"))
    exact = F.broadcast(exact) if n * ROW_BYTES <= BROADCAST_BYTES and n < 1 << 16 else exact.hint("shuffle_hash")
    hits = probed.where("passed_filter").join(exact, "canonical", "left")
    both = hits.unionByName(probed.where("not passed_filter").withColumn("listed", F.lit(False)))
    on_list = F.coalesce("listed", F.lit(False))
    final = F.coalesce("ruled", F.when(on_list, "block").otherwise("allow"))
    return both.select(F.col("k").alias(key), "host", "path", "canonical", "rule", final.alias("verdict"), "passed_filter", on_list.alias("listed"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages", "page_id", "url")
    labels = F.split(host(F.col("url")), r"\.")
    listed = pages.where(F.exists(labels, lambda x: x.isin(*LISTED_LABELS))).select(canonical(F.col("url")).alias("canonical"))
    return judge(pages, listed).select("page_id", "host", "path", "rule", "verdict")


_LABELS = ", ".join(f"'{x}'" for x in LISTED_LABELS)
_CASES = " ".join(f"WHEN (host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}') THEN {{}}" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2])))
ORACLE = rf"""WITH r AS (SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages),
s AS (SELECT page_id, rest, coalesce(translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path FROM r),
q AS (SELECT *, list_sort(list_filter(string_split(regexp_extract(rest, '^[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^({TRACKING})(=|$)'))) AS kept,
  regexp_replace(regexp_replace(regexp_replace(host, '^.*@', ''), ':(80|443)?$', ''), '^(www|m)\.', '') AS h FROM s),
c AS (SELECT *, CASE WHEN h <> '' THEN h || regexp_replace(path, '/+$', '') || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END END AS canonical FROM q),
l AS (SELECT DISTINCT canonical FROM c WHERE len(list_intersect(string_split(host, '.'), [{_LABELS}])) > 0)
SELECT page_id, host, path, CASE {_CASES.format(*[f"'{h}{p}'" for _, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))])} END AS rule,
  CASE {_CASES.format(*[f"'{v}'" for v, h, p in sorted(RULES, key=lambda r: -len(r[1] + r[2]))])} WHEN canonical IN (SELECT canonical FROM l WHERE canonical IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict FROM c"""
