"""Change frequency per file, and hotspots: files that are both changed often and complex."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def parse_numstat(blocks: DataFrame) -> DataFrame:
    """(commit_hash, ts, path, added, deleted) from ``blocks(block)``, a commit each: a line
    ``hash<tab>seconds``, then ``added<tab>deleted<tab>path`` for each file, where ``-`` counts
    0. Other blocks and lines are passed over; no shuffle."""
    lines = F.split("block", "\n")
    head = F.regexp_extract(F.trim(F.get(lines, F.lit(0))), r"^([0-9a-f]{7,64}\t\d+)$", 1)
    rows = blocks.select(F.split(head, "\t").alias("head"), F.explode(lines).alias("line")).where((F.size("head") == 2) & F.col("line").rlike(r"^(\d+|-)\t(\d+|-)\t."))
    added, deleted, path = (F.get(F.split("line", "\t", 3), F.lit(i)) for i in range(3))
    number = lambda text: F.when(text == "-", 0).otherwise(F.try_to_number(text, F.lit("9" * 18)).cast("long"))
    return rows.select(F.col("head")[0].alias("commit_hash"), F.col("head")[1].cast("long").alias("ts"), path.alias("path"), number(added).alias("added"), number(deleted).alias("deleted"))


def churn(log: DataFrame) -> DataFrame:
    """file_id, churn_commits, churn_added, churn_deleted, last_commit (UTC day)."""
    grouped = log.groupBy(F.col("path").alias("file_id")).agg(F.count(F.lit(1)).alias("churn_commits"), F.sum("added").alias("churn_added"), F.sum("deleted").alias("churn_deleted"), F.max("ts").alias("ts"))
    return grouped.select("file_id", "churn_commits", "churn_added", "churn_deleted", F.date_format(F.timestamp_seconds("ts"), "yyyy-MM-dd").alias("last_commit"))


def cumulative_share(rows: DataFrame, value: str, out: str) -> DataFrame:
    """``rows`` with the share of rows whose ``value`` is no larger. The ranks come from counts
    by distinct value, so the window runs over those and not over all rows."""
    counts = rows.groupBy(value).agg(F.count(F.lit(1)).alias("n_here"))
    running = F.sum("n_here").over(Window.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    total = F.sum("n_here").over(Window.partitionBy())
    shares = counts.select(F.col(value).alias("of_value"), (running / total).alias(out))
    return rows.join(F.broadcast(shares) if shares.count() <= 100_000 else shares, F.col(value) == F.col("of_value")).drop("of_value")


def with_hotspots(metrics: DataFrame, changes: DataFrame) -> DataFrame:
    """``metrics(file_id, cc_total, ...)`` with churn columns (0 and "" where there is none) and
    hotspot: the product of both cumulative shares over the files with churn, to four places;
    0 where either value is 0."""
    joined = metrics.join(changes, "file_id", "left")
    filled = joined.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("churn_commits", "churn_added", "churn_deleted")} | {"last_commit": F.coalesce("last_commit", F.lit(""))})
    active = filled.where("churn_commits > 0").select("file_id", "churn_commits", "cc_total")
    ranked = cumulative_share(cumulative_share(active, "churn_commits", "pr_churn"), "cc_total", "pr_cc")
    scored = ranked.select("file_id", F.when(F.col("cc_total") > 0, F.round(F.col("pr_churn") * F.col("pr_cc"), 4)).otherwise(0.0).alias("hotspot"))
    return filled.join(scored, "file_id", "left").withColumn("hotspot", F.coalesce("hotspot", F.lit(0.0)))


def top_hotspots(scored: DataFrame, n: int = 20) -> DataFrame:
    """The ``n`` largest hotspots above 0, ties by file id."""
    return scored.where("hotspot > 0").orderBy(F.desc("hotspot"), "file_id").limit(n)
