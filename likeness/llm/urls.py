"""URL filter: listed canonical URLs, found through a blocked Bloom filter and confirmed by an exact join.

The filter is a table of 64-bit blocks: a listed URL's hash names a block and four bits in it. A page whose
bits are not all set is not listed. The others meet the list itself in a join on the whole URL, so the
answer is exact. The number of blocks follows the length of the list; whether the blocks are broadcast is
left to Spark's own size check.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from likeness.session import stored

# Rules (host, path, verdict) for hosts with all subdomains and paths with all that begins alike.
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"^(?s:.*?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?"
#: Query parameters that say where a visitor came from, and hosts' first labels that name a site's entrance.
TRACKING, ENTRANCE = "^(utm_.*|ref)(=|$)", "^(www|m)[.]"
KEYS_PER_BLOCK = 4
#: Hosts whose pages are listed: a label, at any depth below the entrance, that begins like one of these.
BAD_HOSTS = "(^|[.])(spam|casino-|free-bets|cheap-pills|adult-|ads-)"


def _part(url: Column, number: int) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, number), F.lit(""))


def with_host_and_path(pages: DataFrame) -> DataFrame:
    url = F.col("url").cast("string")
    return pages.select(
        "*", F.translate(_part(url, 1), UPPER, LOWER).alias("host"), _part(url, 2).alias("path"), _part(url, 3).alias("query")
    )


def _site() -> Column:
    """Host without its entrance."""
    return F.regexp_replace("host", ENTRANCE, "")


def canonical() -> Column:
    """Host without its entrance, path without slashes at the end, the other parameters in order; null without a host."""
    host = _site()
    path = F.regexp_replace("path", "/+$", "")
    kept = F.array_sort(F.filter(F.split("query", "&"), lambda p: (p != "") & ~p.rlike(TRACKING)))
    return F.when(host != "", F.concat(host, path, F.lit("?"), F.array_join(kept, "&")))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, says in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def _mask(key: Column) -> Column:
    bits = F.lit(0).cast("long")
    for i in range(4):
        bit = F.shiftrightunsigned(key, 6 * i).bitwiseAND(63).cast("int")
        bits = bits.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), bit))
    return bits


def bloom_blocks(listed: DataFrame) -> tuple[DataFrame, int]:
    """(block, bits) of the listed URLs, and the number of blocks."""
    blocks = max(1, listed.count() // KEYS_PER_BLOCK)
    key = F.xxhash64("canonical")
    hashed = listed.select(F.pmod(F.xxhash64("canonical", F.lit("block")), F.lit(blocks)).alias("block"), _mask(key).alias("mask"))
    return stored(hashed.groupBy("block").agg(F.bit_or("mask").alias("bits")), "bloom"), blocks


def filter_urls(pages: DataFrame, listed: DataFrame, rules=RULES) -> DataFrame:
    """Verdict on each page's URL: all columns of ``pages``, host, path, rule, canonical, listed, verdict.

    ``listed`` has ``canonical``. ``pages`` has ``page_id`` and ``url``; a null URL, or one without ``://``, has
    empty host and path and is allowed. A rule's verdict goes before the list's. Equal rows are judged each;
    pages without an id too. Columns of ``pages`` with the names of results are replaced. Empty tables give
    an empty result, an empty list blocks nothing.
    """
    results = ["host", "path", "query", "rule", "canonical", "listed", "verdict"]
    listed = stored(listed.filter("canonical is not null").select("canonical").distinct(), "listed")
    bits, blocks = bloom_blocks(listed)
    parts = with_host_and_path(pages.drop(*results)).withColumn("canonical", canonical())
    probes = parts.filter("canonical is not null").select(
        "canonical", F.pmod(F.xxhash64("canonical", F.lit("block")), F.lit(blocks)).alias("block"), _mask(F.xxhash64("canonical")).alias("mask")
    )
    # Pages are probed as they are read; only URLs that pass are exchanged as strings.
    possible = probes.join(bits, "block").filter(F.col("bits").bitwiseAND(F.col("mask")) == F.col("mask"))
    sure = stored(possible.select("canonical").distinct().join(listed, "canonical", "left_semi").withColumn("listed", F.lit(True)), "hits")
    rule, verdict = rule_columns(rules)
    judged = parts.join(sure, "canonical", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    own = F.when(F.col("listed"), "block").otherwise("allow")
    return judged.withColumn("rule", rule).withColumn("verdict", F.coalesce(verdict, own)).drop("query")


def reported(pages: DataFrame, hosts: str = BAD_HOSTS) -> DataFrame:
    """A list to filter by: the canonical URLs of hosts that match a pattern without their entrance, wherever else they show up."""
    parts = with_host_and_path(pages.select("url"))
    return parts.filter(_site().rlike(hosts)).select(canonical().alias("canonical")).distinct()


def op2_url_filter(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, reported(pages)).select("page_id", "host", "path", "rule", "verdict", "canonical", "listed")


def _case(rules, what) -> str:
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = "(host = '{h}' OR suffix(host, '.{h}')) AND starts_with(path, '{p}')"
    return "CASE " + " ".join(f"WHEN {fits.format(h=r[0], p=r[1])} THEN '{what(r)}'" for r in ordered) + " END"


SQL = rf"""
WITH parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*[^?#]*[?]([^#]*)', 1), '') AS query
  FROM pages
), named AS (
  SELECT *, CASE WHEN regexp_replace(host, '{ENTRANCE}', '') <> '' THEN
    regexp_replace(host, '{ENTRANCE}', '') || regexp_replace(path, '/+$', '') || '?' || coalesce(array_to_string(
      list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{TRACKING}'))), '&'), '') END AS canonical
  FROM parts
), listed AS (SELECT DISTINCT canonical FROM named WHERE regexp_matches(regexp_replace(host, '{ENTRANCE}', ''), '{BAD_HOSTS}') AND canonical IS NOT NULL)
SELECT page_id, host, path, {_case(RULES, lambda r: r[0] + r[1])} AS rule,
  coalesce({_case(RULES, lambda r: r[2])}, CASE WHEN l.canonical IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  n.canonical, l.canonical IS NOT NULL AS listed
FROM named n LEFT JOIN listed l ON n.canonical = l.canonical
"""
