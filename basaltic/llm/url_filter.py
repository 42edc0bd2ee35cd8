"""URL verdicts from a table of host and path rules, by hash prefixes.

Each distinct (host, path) is expanded into the suffixes of its host with as many labels as
rules have, and the prefixes of its path at the lengths that rules have. The expressions are equi-joined with the
rules on the first bytes of a digest, confirmed by the whole digest, and the longest rule
wins. DataFrame functions only.

Cases: a null url, or one without ``://``, has an empty host and path, and no rule; a path
that lacks a leading slash (it is empty then) starts with no rule's path but the empty one;
repeated rows get the same verdict each; of rules of one length the one with the longer host
wins, then a block; rules given twice count once; null fields make no rule; an empty rule
table leaves the default everywhere; other columns of ``pages`` are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basaltic.llm.exact_dedup import LOWER, UPPER

#: Hex digits of a SHA-256 that the join compares (four bytes).
PREFIX_DIGITS = 8
#: Up to so many rules are broadcast (some 150 bytes each); more are joined by shuffling.
BROADCAST_RULES = 100_000
DEFAULT_VERDICT = "allow"

RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_table(spark, rules=RULES) -> DataFrame:
    """A short list of rules as a table; long ones come as a table from the start."""
    fields = ("rule_host", "rule_path", "verdict")
    rows = [F.struct(*[F.lit(v).cast("string").alias(n) for n, v in zip(fields, r, strict=True)]) for r in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """Between the first ``://`` and the next ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    return F.translate(F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), r"(?s)^[^/?#]*([^?#]*)", 1), F.lit(""))


def expressions(places: DataFrame, counts: list[int], lengths: list[int]) -> DataFrame:
    """(host, path) with every (suffix, prefix) of theirs. ``counts``: the numbers of labels of
    rule hosts; ``lengths``: those of rule paths."""
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.filter(F.array(*[F.lit(n) for n in counts]), lambda n: n <= F.size("labels")), lambda n: F.concat_ws(".", F.slice("labels", F.size("labels") - n + 1, n)))
    cuts = F.filter(F.array(*[F.lit(n) for n in lengths]), lambda n: n <= F.length("path"))
    return (
        places.withColumn("labels", labels)
        .withColumn("prefix", F.explode(F.transform(cuts, lambda n: F.substring(F.col("path"), F.lit(1), n))))
        .withColumn("suffix", F.explode(suffixes))
        .select("host", "path", F.concat("suffix", "prefix").alias("rule"), F.length("suffix").alias("host_length"))
    )


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """page_id, host, path, rule (null where none fits) and verdict for each row of ``pages``."""
    rules = (
        rules.where("rule_host is not null and rule_path is not null and verdict is not null")
        .groupBy("rule_host", "rule_path")
        .agg(F.max("verdict").alias("rule_verdict"))
        .select(F.concat("rule_host", "rule_path").alias("rule"), F.length("rule_host").alias("rule_host_length"), F.length("rule_path").alias("n"), F.size(F.split("rule_host", r"\.")).alias("labels"), "rule_verdict")
        .withColumn("digest", F.sha2(F.concat_ws("\n", "rule_host_length", "rule"), 256))
    )
    shape = rules.agg(F.count(F.lit(1)).alias("rules"), F.collect_set("n").alias("lengths"), F.collect_set("labels").alias("counts")).first()
    split = pages.select(F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    if not shape["rules"]:
        return split.select("*", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))
    keyed = rules.select(F.left("digest", F.lit(PREFIX_DIGITS)).alias("short"), F.col("digest").alias("rule_digest"), "rule_verdict")
    if shape["rules"] <= BROADCAST_RULES:
        keyed = F.broadcast(keyed)
    tried = expressions(split.select("host", "path").distinct(), sorted(shape["counts"]), sorted(shape["lengths"]))
    tried = tried.withColumn("digest", F.sha2(F.concat_ws("\n", "host_length", "rule"), 256)).withColumn("short", F.left("digest", F.lit(PREFIX_DIGITS)))
    order = F.struct(F.length("rule"), F.col("host_length"), F.col("rule_verdict"))
    best = (
        tried.join(keyed, "short")
        .where("digest = rule_digest")
        .groupBy("host", "path")
        .agg(F.max_by(F.struct("rule", "rule_verdict"), order).alias("best"))
        .select("host", "path", "best.*")
    )
    return split.join(best, ["host", "path"], "left").select("page_id", "host", "path", "rule", F.coalesce("rule_verdict", F.lit(default)).alias("verdict"))
