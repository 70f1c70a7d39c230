"""URL filters: rules of host and path that allow or block, looked up by digests.

A rule fits a URL if the URL's host is the rule's or a subdomain of it and its path begins with
the rule's. Each URL is expanded into the expressions that a rule could be: every suffix of its host at a
label, of a length that rules have, with every beginning of its path, of a length that rules
have. Expressions and rules meet in an equi-join on the first PREFIX hexadecimal digits of their
SHA-256, the full digests confirm, and of a URL's rules the longest decides.

Everything is DataFrame functions. A URL's expressions number at most the rules' distinct lengths of
hosts times those of paths, however long the URL is. The best rule is found by a grouping
whose map side leaves one row per page, keyed by the input partition too, so that a URL or page_id
of a third of all rows is spread like the input. Rules are broadcast up to MOST_BROADCAST; beyond it
both sides shuffle by digest prefix and a salt of SALTS, so that an expression which a third of all
pages share meets its rule in SALTS tasks.

Defined results
- null url, or no ``://``: host and path empty, no rule;
- the host ends at the first of ``/ ? #``, with port and user as they are; the path at the first of ``? #``;
- of fitting rules the longest (characters of host and path) wins; equal ones: the longer host, and of rules
  that are equal in host and path ``block``;
- rules whose host is null or empty, whose path is null or whose verdict is neither ``allow`` nor ``block`` are ignored;
- no rule fits: rule null and the verdict ``default``;
- null page_ids and repeated rows: a result each; an empty table gives an empty result; other columns are
  ignored whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX = 8
MOST_BROADCAST = 100_000  # rules
SALTS = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    found = F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)
    return F.coalesce(F.translate(found, _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What lies between the host and the next ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def digest(host: Column, path: Column) -> Column:
    """A rule's or an expression's digest; a path is empty or begins with ``/``, which no host has."""
    return F.sha2(F.concat(host, path).cast("binary"), 256)


def known_rules(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, verdict, digest, prefix): usable rules, hosts lower-cased, each host and path once."""
    held = rules.select(F.translate(F.col("host").cast("string"), _UPPER, _LOWER).alias("rule_host"), F.col("path").cast("string").alias("rule_path"), F.col("verdict").cast("string").alias("verdict"))
    held = held.where("rule_host <> '' and rule_path is not null and verdict in ('allow', 'block')").groupBy("rule_host", "rule_path").agg(F.max("verdict").alias("verdict"))
    found = digest(F.col("rule_host"), F.col("rule_path"))
    return held.withColumn("digest", found).withColumn("prefix", F.substring("digest", 1, PREFIX))


def expressions(host: Column, path: Column, hosts: list[int], paths: list[int]) -> Column:
    """array<string>: digests of the host's suffixes at labels, of ``hosts`` characters, with the path's beginnings of ``paths``."""
    n, m = F.char_length(host), F.char_length(path)
    numbers = lambda xs: F.split(F.lit(",".join(map(str, xs))), ",").cast("array<int>")
    whole = lambda h: (n == h) | ((n > h) & (F.substr(host, n - h, F.lit(1)) == "."))
    suffixes = F.transform(F.filter(numbers(hosts), whole), lambda h: F.substr(host, n - h + 1, h))
    beginnings = F.transform(F.filter(numbers(paths), lambda p: p <= m), lambda p: F.substr(path, F.lit(1), p))
    return F.flatten(F.transform(suffixes, lambda h: F.transform(beginnings, lambda p: digest(h, p))))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages`` (page_id, url) by ``rules`` (host, path, verdict)."""
    known = known_rules(rules)
    # lengths that occur: not more than the longest rule has characters
    told = known.agg(F.count("*").alias("n"), F.collect_set(F.char_length("rule_host")).alias("hosts"), F.collect_set(F.char_length("rule_path")).alias("paths")).first()
    rows = pages.select(F.spark_partition_id().alias("part"), F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"))
    rows = rows.select("part", "page_id", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    if not told["n"]:
        return rows.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    # the first entry of each row stands for the row itself and meets no rule
    tried = F.concat(F.array(F.lit(None).cast("string")), expressions(F.col("host"), F.col("path"), sorted(told["hosts"]), sorted(told["paths"])))
    tried = rows.select("*", F.explode(tried).alias("tried"))
    salt = F.pmod(F.xxhash64("page_id", "host", "path"), F.lit(SALTS)).cast("int")
    if told["n"] <= MOST_BROADCAST:
        met = tried.withColumn("prefix", F.substring("tried", 1, PREFIX)).join(F.broadcast(known), "prefix", "left")
    else:
        sides = tried.withColumn("salt", salt).withColumn("prefix", F.coalesce(F.substring("tried", 1, PREFIX), F.xxhash64("part", "page_id", "host", "path").cast("string")))
        met = sides.join(known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["prefix", "salt"], "left")
    found = F.when(
        F.col("tried") == F.col("digest"),
        F.struct((F.char_length("rule_host") + F.char_length("rule_path")).alias("n"), F.char_length("rule_host").alias("h"), F.concat("rule_host", "rule_path").alias("rule"), F.col("verdict").alias("verdict")),
    )
    best = met.groupBy("part", "page_id", "host", "path").agg(F.max(found).alias("best"), F.count_if(F.col("tried").isNull()).alias("rows"))
    each = best.withColumn("_", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("rows"))))
    return each.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
