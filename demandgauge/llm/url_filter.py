"""URL filter (native): host suffixes and path prefixes joined to rules by short hash prefixes.

A url is expanded into expressions ``host suffix + path prefix``, but only for those (number
of host labels, length of path) pairs that some rule has, so the expansion is bounded by the
shapes of rules and loses no match.  An equi-join on the first 32 bits of SHA-256 finds rules,
full digests confirm them, and the longest rule wins.  Distinct expressions are joined, so a
host with a third of all rows meets the rules once per partition's distinct expressions.

Defined results: a null url or one without ``://`` has an empty host and path and no rule; ties
between equally long rules go to the longer host, then to ``block``; repeated rules act once; a
rule with a null host, path or verdict is ignored; without rules all rows get ``default``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgauge.llm.shared import lower_ascii


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of the url in the named column; empty where there are none."""
    rest = F.expr(f"CASE WHEN locate('://', {url}) > 0 THEN substring({url}, locate('://', {url}) + 3) END")
    return (
        F.coalesce(lower_ascii(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit("")),
        F.coalesce(F.regexp_extract(rest, "^[^/?#]*(/[^?#]*)", 1), F.lit("")),
    )


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with host, path, rule and verdict; input columns of these names are replaced.

    ``rules``: host, path, verdict (allow or block).
    """
    kept = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    host, path = host_and_path("_url")
    base = pages.withColumn("_url", F.col(url)).select(*kept, host.alias("host"), path.alias("path"))
    indexed = _index(rules)
    shapes = indexed.agg(F.collect_set(F.struct("labels", "chars"))).scalar()
    pair = base.filter("host <> ''").select("host", "path").distinct().withColumn("shapes", shapes)
    # Only shapes that the url can fill: enough labels, and a path long enough.
    n_labels = F.size(F.split("host", r"\."))
    fitting = F.filter("shapes", lambda s: (s["labels"] <= n_labels) & (s["chars"] <= F.length("path")))
    expressions = F.transform(
        fitting,
        lambda s: F.concat(
            F.call_function("substring_index", F.col("host"), F.lit("."), -s["labels"]), F.substring("path", F.lit(1), s["chars"])),
    )
    expanded = pair.select("host", "path", F.explode(expressions).alias("expression")).select(
        "host", "path", F.sha2("expression", 256).alias("digest"))
    found = (
        expanded.withColumn("short", F.substring("digest", 1, 8)).join(indexed, "short")
        .filter(F.col("digest") == F.col("rule_digest"))
        .groupBy("host", "path")
        .agg(F.max(F.struct("size", "host_size", "blocks", "rule", "rule_verdict")).alias("best"))
        .select(F.col("host").alias("_h"), F.col("path").alias("_p"), F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("_v"))
    )
    return (
        base.join(found, (F.col("host") == F.col("_h")) & (F.col("path") == F.col("_p")), "left")
        .select(*kept, "host", "path", "rule", F.coalesce("_v", F.lit(default)).alias("verdict"))
    )


def _index(rules: DataFrame) -> DataFrame:
    host, path = lower_ascii(F.col("host")), F.col("path")
    rule = F.concat(host, path)
    return (
        rules.filter("host is not null and path is not null and verdict is not null")
        .select(
            rule.alias("rule"), F.col("verdict").alias("rule_verdict"), (F.col("verdict") == "block").alias("blocks"),
            F.sha2(rule, 256).alias("rule_digest"), F.size(F.split(host, r"\.")).alias("labels"), F.length(path).alias("chars"),
            F.length(rule).alias("size"), F.length(host).alias("host_size"))
        .distinct().withColumn("short", F.substring("rule_digest", 1, 8))
    )
