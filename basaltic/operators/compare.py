"""What changed between two snapshots of the fact and metric tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Differences no larger than this are none.
EPSILON = 1e-9
# The keys that are compared.
PROJECT_KEYS = ("files", "loc_total", "loc_code", "loc_comment", "functions", "classes", "cc_avg", "cc_max", "mi_avg", "cycles_count")
FILE_KEYS = (
    "loc_total", "loc_code", "loc_comment", "loc_blank", "functions", "classes", "cc_total", "cc_max", "mi",
    "fan_in", "fan_out", "pagerank", "betweenness", "closeness", "degree_centrality", "churn_commits", "hotspot",
)


def unpivoted(rows: DataFrame, id_cols: list[str], keys: list[str], value: str) -> DataFrame:
    """(ids, key, value) of the numeric ``keys``; nulls are left out."""
    long = rows.select(*id_cols, F.explode(F.array(*[F.struct(F.lit(k).alias("key"), F.col(k).cast("double").alias(value)) for k in keys])).alias("x"))
    return long.select(*id_cols, "x.*").where(F.col(value).isNotNull())


def changed_values(old: DataFrame, new: DataFrame, id_cols: list[str], keys: list[str]) -> DataFrame:
    """(ids, key, old_value, new_value) where both sides have the key and differ."""
    both = unpivoted(old, id_cols, keys, "old_value").join(unpivoted(new, id_cols, keys, "new_value"), [*id_cols, "key"])
    return both.where(F.abs(F.col("old_value") - F.col("new_value")) > EPSILON)


def project_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, old_value, new_value) of the project totals that changed."""
    keys = [k for k in PROJECT_KEYS if k in old.columns and k in new.columns]
    one = F.lit(1).alias("one")
    return changed_values(old.select(one, *keys), new.select(one, *keys), ["one"], keys).drop("one")


def file_keys(old: DataFrame, new: DataFrame) -> list[str]:
    """The named keys and any other ``loc_*`` that both sides have."""
    shared = [c for c in old.columns if c in new.columns]
    return [c for c in shared if c in FILE_KEYS or c.startswith("loc_")]


def presence(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, status): ``added`` or ``removed``, over distinct keys of both sides."""
    a = old.select(*keys).distinct().withColumn("in_old", F.lit(True))
    b = new.select(*keys).distinct().withColumn("in_new", F.lit(True))
    joined = a.join(b, keys, "full_outer").where("in_old is null or in_new is null")
    return joined.select(*keys, F.when(F.col("in_old").isNull(), "added").otherwise("removed").alias("status"))


def import_edges(old: DataFrame, new: DataFrame) -> DataFrame:
    """Import edges (src, dst, kind) that came or went; lines and confidence don't count."""
    return presence(old.where("kind = 'import'"), new.where("kind = 'import'"), ["src", "dst", "kind"])


def cycle_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Cycles that came or went, whichever way they were written down."""
    ordered = lambda c: c.select(F.array_sort("cycle").alias("cycle"))
    return presence(ordered(old), ordered(new), ["cycle"])


def hotspot_changes(old: DataFrame, new: DataFrame) -> DataFrame | None:
    """Hotspots that are new or resolved; None where a side has none at all."""
    if old.isEmpty() or new.isEmpty():
        return None
    status = F.when(F.col("status") == "added", "new").otherwise("resolved")
    return presence(old, new, ["file_id"]).select("file_id", status.alias("status"))


def compare(old: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All sections from tables by name: project, file_metrics, edges, cycles, hotspots."""
    keys = file_keys(old["file_metrics"], new["file_metrics"])
    found = {
        "project_delta": project_delta(old["project"], new["project"]),
        "files": presence(old["file_metrics"], new["file_metrics"], ["file_id"]),
        "files_changed": changed_values(old["file_metrics"], new["file_metrics"], ["file_id"], keys),
        "edges": import_edges(old["edges"], new["edges"]),
        "cycles": cycle_changes(old["cycles"], new["cycles"]),
        "hotspots": hotspot_changes(old["hotspots"], new["hotspots"]) if "hotspots" in old and "hotspots" in new else None,
    }
    return {k: v for k, v in found.items() if v is not None}


def is_empty(sections: dict[str, DataFrame]) -> bool:
    return all(s.isEmpty() for s in sections.values())
