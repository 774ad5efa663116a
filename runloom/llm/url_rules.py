"""URL rules by sort-merge range joins.

A host is turned into a key by reversing its labels, ``www.example.com`` to
``com.example.www.``, so that a domain with all its subdomains is an interval of
keys: those with the domain's key as prefix. The paths below a rule's path are
an interval as well. Intervals of prefixes are nested or disjoint, so one sweep
over keys and rules in order finds for each key the stack of rules open there.

The sweep is a window. A rule's level is the number of rules around it; of each
level the last rule that began is the only one that can still be open, and is if
the key starts with it. Keys are made distinct before, and dealt out with a copy
of the rules for each dealing, so that no host, however common, is one task's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from runloom.llm.stage import staged

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ALLOW, BLOCK = "allow", "block"


def rules_of(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """A rule table from (host, path, verdict) literals."""
    rows = [F.struct(*[F.lit(x).alias(n) for n, x in zip(("host", "path", "verdict"), rule)]) for rule in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def host_of(url: str = "url") -> Column:
    """Between the first ``://`` and ``/``, ``?``, ``#`` or the end, in lower case; empty without ``://``."""
    return F.translate(F.regexp_extract(_after_scheme(url), "^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: str = "url") -> Column:
    """From the host's end up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), "^[^/?#]*([^?#]*)", 1)


def _after_scheme(url: str) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")


def host_key(host: str) -> Column:
    """Labels in reverse, each with a dot behind it; empty for an empty host."""
    return F.when(F.col(host) == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit(".")))


def open_prefixes(keys: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(key, stack): for each distinct key the prefixes that it starts with, outermost first."""
    spark = keys.sparkSession
    prefixes = prefixes.select("prefix").distinct()
    # The prefixes of a prefix are looked up by equality to get its level.
    around = prefixes.select("prefix", F.explode(F.transform(
        F.sequence(F.lit(0), F.length("prefix")), lambda n: F.substring(F.col("prefix"), F.lit(1), n))).alias("outer"))
    around = around.distinct().join(prefixes.select(F.col("prefix").alias("outer")), "outer")
    levels = staged(around.groupBy("prefix").agg((F.count("*") - 1).alias("level")), "prefixes")
    depth = levels.agg(F.max("level")).first()[0]
    if depth is None:
        return keys.select("key").distinct().withColumn("stack", F.array().cast("array<string>"))
    deals = int(spark.conf.get("spark.sql.shuffle.partitions"))
    events = keys.select("key").distinct().select(
        F.pmod(F.xxhash64("key"), F.lit(deals)).cast("int").alias("deal"), "key", F.lit(-1).cast("long").alias("level"))
    rules = levels.select(
        F.explode(F.sequence(F.lit(0), F.lit(deals - 1))).alias("deal"), F.col("prefix").alias("key"), "level")
    # Rules that begin at a key come before it.
    sweep = Window.partitionBy("deal").orderBy("key", F.col("level").desc())
    began = [F.last(F.when(F.col("level") == n, F.col("key")), ignorenulls=True).over(sweep).alias(f"began_{n}") for n in range(depth + 1)]
    stack = F.array_compact(F.array(*[F.when(F.col("key").startswith(F.col(f"began_{n}")), F.col(f"began_{n}")) for n in range(depth + 1)]))
    return events.union(rules).select("*", *began).filter("level = -1").select("key", stack.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = ALLOW) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict.

    ``rules`` has host, path and verdict. A rule fits its host and all
    subdomains if the url's path starts with the rule's; the longest (host and
    path together) wins, of equally long ones that with the longer host. Of
    equal rules with different verdicts ``block`` counts. Rules with a null are
    left out. A null url and one without ``://`` have an empty host and path.
    Where no rule fits, ``rule`` is null and the verdict is ``default``. Repeated
    rows each get a row, also without an id; an empty table gives an empty one.
    """
    rules = rules.select("host", "path", "verdict").dropna().groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    rules = staged(rules.withColumn("prefix", host_key("host")), "rules")
    urls = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"))
    urls = urls.select("page_id", F.coalesce(host_of(), F.lit("")).alias("host"), F.coalesce(path_of(), F.lit("")).alias("path"))
    pairs = staged(urls.select("host", "path").distinct(), "urls")
    paths = open_prefixes(pairs.select(F.col("path").alias("key")), rules.select(F.col("path").alias("prefix")))
    paths = staged(paths.select(F.col("key").alias("path"), F.explode("stack").alias("under")), "paths")
    # Host keys are searched below each path of a rule by itself.
    below = lambda key: F.concat(F.col("under"), F.lit("\u0000"), key)
    probes = staged(pairs.join(paths, "path").select("host", "path", "under", below(host_key("host")).alias("key")), "probes")
    prefixes = rules.select(F.concat("path", F.lit("\u0000"), "prefix").alias("prefix"), F.concat("host", "path").alias("rule"), F.length("host").alias("size"), "verdict")
    hits = open_prefixes(probes.select("key"), prefixes).select("key", F.try_element_at("stack", F.lit(-1)).alias("prefix")) if not rules.isEmpty() else None
    if hits is None:
        return urls.select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    hits = staged(hits.filter("prefix is not null").join(prefixes, "prefix").select("key", "rule", "size", "verdict"), "hits")
    longest = F.max(F.struct(F.length("rule").alias("length"), "size", "rule", "verdict")).alias("best")
    best = staged(probes.join(hits, "key").groupBy("host", "path").agg(longest).select("host", "path", "best.rule", "best.verdict"), "verdicts")
    return urls.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
