"""URL filtering by equi-joins on digests of host-suffix and path-prefix expressions.

Each distinct URL is expanded into expressions: every suffix of its host at a label border with every
prefix of its path whose length some rule has. Expressions and rules meet on the first bytes of a SHA-256
digest, as lists of rules are usually exchanged; the full digest then confirms, and the longest rule wins
(a block rule over an allow rule of the same length, then by name). Everything is DataFrame functions.

URLs are judged once however often they occur, and the verdicts are joined back by URL, so a hot host or
URL is spread by its distinct URLs and by adaptive execution. The distinct path lengths of the rules are the
only thing that reaches the driver; they are bounded by ``longest_path``, beyond which a rule is refused.

Nulls: a null URL, or one without ``://``, has an empty host and path and no rule. Rules with a null or
empty host are left out; a null path counts as empty. Repeated pages are each answered. An empty table
gives an empty result. Only ``page_id`` and ``url`` are read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT = 8  # hexadecimal digits: four bytes
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_after_scheme(url), r"^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host, up to ``?``, ``#`` or the end."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _digest(host: Column, path: Column) -> Column:
    # The separator is in no host, so host and path cannot run into each other.
    return F.sha2(F.concat(host, F.lit("/"), path).cast("binary"), 256)


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = "allow",
               longest_path: int = 2048) -> DataFrame:
    """Per row of ``pages``: page_id, host, path, rule, verdict. ``rules``: host, path, verdict."""
    pages = pages.select("page_id", "url")
    rules = rules.select(
        F.translate("host", UPPER, LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"),
        "verdict",
    ).where(F.col("host") != "").distinct()
    lengths = [r[0] for r in rules.select(F.length("path")).distinct().limit(longest_path + 2).collect()]
    if any(n > longest_path for n in lengths):
        raise ValueError(f"a rule's path is longer than {longest_path}")
    known = rules.select(
        _digest(F.col("host"), F.col("path")).alias("digest"), F.concat("host", "path").alias("rule"),
        F.col("verdict").alias("rule_verdict"),
    ).withColumn("short", F.substring("digest", 1, SHORT))

    parts = pages.select("url").where(F.col("url").isNotNull()).distinct().select(
        "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")
    ).where(F.col("host") != "")
    labels = F.split("host", r"\.")
    suffixes = F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda i: F.array_join(F.slice(labels, i, F.size(labels) - i + 1), "."),
    )
    sizes = F.array(*(F.lit(n) for n in sorted(lengths))) if lengths else F.expr("cast(array() as array<int>)")
    prefixes = F.transform(
        F.filter(sizes, lambda n: n <= F.length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n)
    )
    expressions = (
        parts.select("url", "path", F.explode(suffixes).alias("suffix"))
        .select("url", "suffix", F.explode(prefixes).alias("prefix"))
        .select("url", _digest(F.col("suffix"), F.col("prefix")).alias("full"))
        .withColumn("short", F.substring("full", 1, SHORT))
    )
    fits = expressions.join(known, "short").where(F.col("full") == F.col("digest"))
    rank = F.struct(F.length("rule"), F.col("rule_verdict") == "block", F.col("rule"),
                    F.col("rule_verdict"))
    best = fits.groupBy("url").agg(F.max(rank).alias("best")).select(
        F.col("url").alias("judged"), F.col("best.rule").alias("rule"),
        F.col("best.rule_verdict").alias("rule_verdict"),
    )
    url = F.col("url")
    return pages.join(best, url == F.col("judged"), "left").select(
        "page_id", host_of(url).alias("host"), path_of(url).alias("path"), "rule",
        F.coalesce("rule_verdict", F.lit(default)).alias("verdict"),
    )
