"""URL filters by host-suffix and path-prefix expressions (operator 3), in DataFrame functions only.

A rule is a host and a path. A URL is expanded into the expressions that a rule could be filed under:
every suffix of its host at a label, with every prefix of its path that ends in a slash. A rule is
filed under its host and its path up to the last slash. Expressions and rules meet on the first four
bytes of a digest; those that meet are confirmed by the full digest and by the rest of the rule's
path. Of the rules that fit, the longest one decides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """Between ``://`` and the next ``/``, ``?``, ``#``, A-Z lower-cased; empty if null or without ``://``."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_table(rules: DataFrame) -> DataFrame:
    """Rules ``(rule, action)`` such as ``("example.net/en/", "allow")`` with the key that they are filed under.

    The host ends at the first slash; a rule without one has an empty path. Repeated rules count once;
    of a rule with both actions ``block`` counts. Rows with a null rule or action, and rules without
    host, fit nothing and are left out.
    """
    once = rules.where("rule is not null and action is not null").groupBy("rule").agg(F.max("action").alias("action"))
    split = once.select("rule", "action", F.translate(F.regexp_extract("rule", r"(?s)^([^/]*)", 1), UPPER, LOWER).alias("rule_host"),
                        F.regexp_extract("rule", r"(?s)^[^/]*(.*)$", 1).alias("rule_path")).where("rule_host <> ''")
    folder = F.regexp_extract("rule_path", r"(?s)^(.*/)?[^/]*$", 1)
    filed = split.withColumn("filed", F.sha2(F.concat("rule_host", F.lit("\n"), folder), 256)).withColumn("depth", F.size(F.split(folder, "/")))
    return filed.withColumn("short", F.substring("filed", 1, 8)).withColumn("labels", F.size(F.split("rule_host", r"\.")))


def verdicts(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` and ``verdict``.

    ``rule`` is null and the verdict ``default`` where no rule fits; null urls and urls without ``://``
    have an empty host and path, so none does. Rules of equal length go by the longer host, then by
    the text. All rows stay, repeated ones too; input columns with an added name are replaced; empty
    tables give the obvious. Each distinct host and path is judged once. Expansion goes no deeper
    than the deepest rule, which very long urls need.
    """
    filed = rule_table(rules)
    deepest = filed.agg(F.max("labels"), F.max("depth")).first()  # two numbers
    most_labels, most_parts = deepest[0] or 0, deepest[1] or 0
    added = {"host", "path", "rule", "verdict"}
    kept = [c for c in pages.columns if c.lower() not in added]
    named = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    distinct = named.select("host", "path").where("host <> ''").distinct()
    labels, parts = F.split("host", r"\."), F.split("path", "/", most_parts + 1)
    n_labels = F.least(F.size(labels), F.lit(most_labels))
    suffixes = F.when(n_labels > 0, F.transform(F.sequence(F.lit(1), n_labels), lambda k: F.array_join(F.slice(labels, -k, k), ".")))
    # Prefix k ends in the k-th slash; prefix 0 is empty.
    n_slashes = F.least(F.size(parts) - 1, F.lit(max(most_parts - 1, 0)))
    prefixes = F.transform(F.sequence(F.lit(0), n_slashes), lambda k: F.when(k == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, 1, k), "/"), F.lit("/"))))
    digests = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda p: F.sha2(F.concat(s, F.lit("\n"), p), 256))))
    expressions = distinct.select("host", "path", F.explode(digests).alias("digest")).withColumn("short", F.substring("digest", 1, 8))
    met = expressions.join(filed, "short").where((F.col("digest") == F.col("filed")) & F.startswith(F.col("path"), F.col("rule_path")))
    rank = F.struct(F.length("rule").alias("n"), F.length("rule_host").alias("h"), F.col("rule").alias("rule"), F.col("action").alias("verdict"))
    best = met.groupBy("host", "path").agg(F.max(rank).alias("best")).select("host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("verdict"))
    return named.join(best, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in kept], "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
