"""URL allow and block rules: host-suffix and path-prefix expressions, joined on short hash prefixes.

A rule is a host and the beginning of a path; it fits its host and all subdomains where the url's path
starts with the rule's.  Every url is expanded into the expressions (host suffix, path prefix) that a
rule of the table could equal, expressions and rules meet on the first PREFIX_DIGITS hex digits of
their SHA-256, the whole digest confirms, and the longest rule that is left decides.

Only label counts and path lengths that occur among the rules are expanded (they are short lists of
small numbers, however many rules there are), so a url makes as few expressions as possible and none
that could matter is left out.  A url's verdict depends on its host and on the first characters of its
path, as many as the longest rule has: those pairs are made distinct before anything is expanded, so a
host that holds a third of the rows is one row.  Spark broadcasts the rules where they are
small and joins by sort and merge where they are not.

Defined cases: a null url, or one without ``://``, has empty host and path and no rule; rows that repeat get
equal results; of rules that are equally long the one with the longer host decides, of equal rules with both
verdicts the block; a rule with a null host or another verdict than allow or block is no rule, a null path
is empty; without rules every url is allowed, as is one that no rule fits; empty tables give empty results;
further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PREFIX_DIGITS = 8       # hex digits of a digest that are joined on: 32 bits
UNMATCHED = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(_rest(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def _expression(host: Column, path: Column) -> Column:
    return F.concat(host, F.lit("?"), path)  # neither part can hold a question mark


def _with_digest(df: DataFrame, expression: Column) -> DataFrame:
    df = df.withColumn("digest", F.sha2(expression, 256))
    return df.withColumn("short", F.substring("digest", 1, PREFIX_DIGITS))


def _usable(rules: DataFrame) -> DataFrame:
    """(rule_host, rule_path, blocks): every different rule once."""
    path = F.coalesce(F.col("path").cast("string"), F.lit(""))
    return (rules.filter(F.col("host").isNotNull() & F.col("verdict").isin("allow", "block"))
            .groupBy(F.translate(F.col("host").cast("string"), UPPER, LOWER).alias("rule_host"), path.alias("rule_path"))
            .agg(F.max(F.col("verdict") == "block").alias("blocks")))


def _expanded(sites: DataFrame, labels: list[int], lengths: list[int]) -> DataFrame:
    """A row per site and expression."""
    hosts = F.array_distinct(F.array(*[F.substring_index("host", ".", -n) for n in labels]))
    paths = F.filter(F.array(*[F.when(F.length("head") >= n, F.substring("head", 1, n)) for n in lengths]),
                     lambda p: p.isNotNull())
    both = sites.select("host", "head", F.explode(hosts).alias("_host"), paths.alias("_paths"))
    both = both.select("host", "head", "_host", F.explode("_paths").alias("_path"))
    return _with_digest(both, _expression(F.col("_host"), F.col("_path"))).select("host", "head", "digest", "short")


def judge(pages: DataFrame, rules: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """(``key``, host, path, rule, verdict) per row of ``pages``; ``rules`` has (host, path, verdict)."""
    known = _usable(rules)
    sizes = known.agg(F.collect_set(F.size(F.split("rule_host", "\\."))).alias("labels"),
                      F.collect_set(F.length("rule_path")).alias("lengths")).first()
    longest = max(sizes["lengths"], default=0)
    address = F.col(f"`{url}`").cast("string")
    parsed = pages.select(F.col(f"`{key}`").alias(key), host_of(address).alias("host"), path_of(address).alias("path"))
    head = F.substring("path", 1, longest)
    if not sizes["labels"]:
        return parsed.select(key, "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(UNMATCHED).alias("verdict"))

    sites = parsed.select("host", head.alias("head")).distinct()
    hashed = _with_digest(known, _expression(F.col("rule_host"), F.col("rule_path")))
    asked = _expanded(sites, sorted(sizes["labels"]), sorted(sizes["lengths"]))
    met = asked.alias("u").join(hashed.alias("r"), F.col("u.short") == F.col("r.short"))
    fits = met.filter(F.col("u.digest") == F.col("r.digest"))
    rule = F.concat("rule_host", "rule_path")
    rank = F.struct(F.length(rule).alias("n"), F.length("rule_host").alias("h"), F.col("blocks").alias("b"))
    best = fits.groupBy("host", "head").agg(F.max_by(F.struct(rule.alias("rule"), "blocks"), rank).alias("best"))
    told = parsed.withColumn("head", head).join(best, ["host", "head"], "left")
    verdict = F.when(F.col("best.blocks"), "block").when(~F.col("best.blocks"), "allow").otherwise(UNMATCHED)
    return told.select(key, "host", "path", F.col("best.rule").alias("rule"), verdict.alias("verdict"))
