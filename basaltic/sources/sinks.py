"""Reports and snapshots of analysed projects.

Tables stay tables: snapshots are Parquet folders, one for each table. The one-file forms
(JSON, CSV, Markdown, HTML) are for projects that fit a report, and are built on the driver
from tables that hold a row per file or symbol.
"""

from __future__ import annotations

import base64
import csv
import gzip
import html
import io
import json
import os
import re
from typing import Any

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basaltic.storage import drop_scratch, saved

SCHEMA_VERSION = "1.3"
METRIC_COLUMNS = (
    "loc_total", "loc_code", "loc_comment", "loc_blank", "functions", "classes", "cc_total", "cc_max", "mi", "fan_in", "fan_out", "fan_out_external",
    "pagerank", "betweenness", "closeness", "degree_centrality", "churn_commits", "hotspot",
)
FILE_COLUMNS = ("path", "language", *METRIC_COLUMNS)
SNAPSHOT_TABLES = ("files", "symbols", "edges", "defuses", "diagnostics", "cycles", "symbol_metrics", "file_metrics", "project", "languages", "network", "resolution", "imports", "meta", "hotspots")
#: Sources in a report: longer files are left out, and all from the first past the total.
MOST_SOURCE_CHARS, MOST_TOTAL_CHARS = 200_000, 20_000_000


# snapshots


def save_snapshot(tables: dict[str, DataFrame], folder: str, snapshot_id: str) -> None:
    """Writes the tables under ``folder/snapshot_id/<table>``."""
    for name in SNAPSHOT_TABLES:
        if name in tables:
            tables[name].write.mode("overwrite").parquet(f"{folder}/{snapshot_id}/{name}")


def load_snapshot(spark: SparkSession, folder: str, snapshot_id: str) -> dict[str, DataFrame]:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    found = {}
    for name in SNAPSHOT_TABLES:
        place = hadoop.Path(f"{folder}/{snapshot_id}/{name}")
        if place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
            found[name] = spark.read.parquet(str(place))
    return found


def prune_snapshots(spark: SparkSession, folder: str, ids: list[str], keep: int = 10) -> list[str]:
    """Deletes all but the ``keep`` last of ``ids`` in order; returns those that stay."""
    for old in ids[:-keep]:
        drop_scratch(spark, f"{folder}/{old}")
    return ids[-keep:]


# one-file forms


def rows_of(df: DataFrame, *order: str) -> list[dict[str, Any]]:
    return [r.asDict(recursive=True) for r in (df.orderBy(*order) if order else df).collect()]


def file_rows(tables: dict[str, DataFrame]) -> list[dict[str, Any]]:
    """One row per file in order of its path, with every column (None where unknown)."""
    measured = tables["file_metrics"]
    have = [c for c in METRIC_COLUMNS if c in measured.columns]
    joined = tables["files"].select(F.col("id").alias("file_id"), "path", "language").join(measured.select("file_id", *have), "file_id", "left")
    return [{c: r.get(c) for c in FILE_COLUMNS} for r in rows_of(joined, "path")]


def summary_pairs(tables: dict[str, DataFrame]) -> list[tuple[str, Any]]:
    project = rows_of(tables["project"])[0]
    project["languages"] = {r["language"]: {"files": r["files"], "loc_code": r["loc_code"]} for r in rows_of(tables["languages"], "language")}
    project["test"] = {"files": project.pop("test_files"), "loc_code": project.pop("test_loc_code")}
    pairs = [(k, json.dumps(v, sort_keys=True) if isinstance(v, dict) else v) for k, v in sorted(project.items())]
    return pairs + [(f"network_{k}", v) for k, v in sorted(rows_of(tables["network"])[0].items())]


def resolution(tables: dict[str, DataFrame]) -> dict[str, Any]:
    by_scope = {r.pop("scope"): r for r in rows_of(tables["resolution"])}
    calls = by_scope.get("calls", {}) | {"non_test": by_scope.get("non_test", {})}
    languages = {k.removeprefix("language:"): {"calls_total": v["total"], "calls_certain_pct": v["certain_pct"], "calls_ambiguous_pct": v["ambiguous_pct"]} for k, v in sorted(by_scope.items()) if k.startswith("language:")}
    return {"calls": calls, "imports": rows_of(tables["imports"])[0], "by_language": languages}


def cycle_list(tables: dict[str, DataFrame]) -> list[list[str]]:
    return sorted(r["cycle"] for r in rows_of(tables["cycles"]))


def to_document(tables: dict[str, DataFrame], with_defuse: bool = False) -> dict[str, Any]:
    """The whole analysis as one document, every list in its canonical order."""
    symbols = rows_of(tables["symbols"], "id")
    for s in symbols:
        s["span"] = {k: s.pop(k) for k in ("start_line", "end_line", "start_col", "end_col")}
    files = {r.pop("file_id"): r for r in rows_of(tables["file_metrics"])}
    hot = tables.get("hotspots")
    state = rows_of(tables["churn_state"])[0] if "churn_state" in tables else {"available": False, "reason": "disabled", "window_days": 0}
    return {
        "schema_version": SCHEMA_VERSION,
        "meta": rows_of(tables["meta"])[0],
        "files": rows_of(tables["files"], "id"),
        "symbols": symbols,
        "edges": rows_of(tables["edges"], "src", "dst", "kind", "line"),
        "defuses": rows_of(tables["defuses"], "symbol_id", "var") if with_defuse else [],
        "diagnostics": rows_of(tables["diagnostics"], "file", "kind", "line"),
        "metrics": {
            "files": files,
            "symbols": {r.pop("symbol_id"): r for r in rows_of(tables["symbol_metrics"])},
            "project": dict(rows_of(tables["project"])[0]),
            "network": rows_of(tables["network"])[0],
            "resolution": resolution(tables),
            "cycles": cycle_list(tables),
            "churn": state,
            "hotspots": [{"file_id": r["file_id"], "hotspot": r["hotspot"]} for r in rows_of(hot)] if hot is not None else [],
        },
    }


def write_json(document: dict, path: str) -> None:
    os.makedirs(os.path.dirname(os.path.abspath(path)), exist_ok=True)
    with open(path, "w", encoding="utf-8") as f:
        json.dump(document, f, ensure_ascii=False, indent=2)


def read_json(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The tables that a comparison needs, from a written document."""
    with open(path, encoding="utf-8") as f:
        doc = json.load(f)
    if missing := [k for k in ("schema_version", "files", "metrics") if k not in doc]:
        raise ValueError(f"{path}: no {', '.join(missing)}")
    m = doc["metrics"]
    keys = sorted({k for v in m["files"].values() for k, x in v.items() if isinstance(x, (int, float)) and not isinstance(x, bool)})
    number = lambda x: None if x is None or isinstance(x, (bool, str)) else float(x)
    by_file = [(i, *[number(v.get(k)) for k in keys]) for i, v in m["files"].items()]
    project = {k: number(v) for k, v in m.get("project", {}).items() if number(v) is not None}
    found = {
        "file_metrics": spark.createDataFrame(by_file, ", ".join(["file_id string", *(f"`{k}` double" for k in keys)])),
        "project": spark.createDataFrame([tuple(project.values())], ", ".join(f"`{k}` double" for k in project)),
        "edges": spark.createDataFrame([(e["src"], e["dst"], e["kind"]) for e in doc.get("edges", [])], "src string, dst string, kind string"),
        "cycles": spark.createDataFrame([(c,) for c in m.get("cycles", [])], "cycle array<string>"),
    }
    if m.get("hotspots"):
        found["hotspots"] = spark.createDataFrame([(h["file_id"],) for h in m["hotspots"]], "file_id string")
    return found


def _csv(headers, rows) -> str:
    out = io.StringIO()
    writer = csv.writer(out)
    writer.writerows([headers, *[["" if x is None else x for x in r] for r in rows]])
    return out.getvalue()


def _markdown(headers, rows) -> str:
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in (headers, ["---"] * len(headers), *rows))


def export_metrics(tables: dict[str, DataFrame], fmt: str) -> str:
    """All metrics as csv (three sections), md or json."""
    files, cycles = file_rows(tables), cycle_list(tables)
    lines = [[r[c] for c in FILE_COLUMNS] for r in files]
    if fmt == "csv":
        pairs = "\r\n# project summary\r\n" + _csv(["key", "value"], summary_pairs(tables))
        return _csv(FILE_COLUMNS, lines) + pairs + "\r\n# cycles\r\n" + _csv(["index", "files"], [(i, " -> ".join(c)) for i, c in enumerate(cycles)])
    if fmt == "md":
        told = [(k, json.dumps(v, sort_keys=True, ensure_ascii=False)) for k, v in sorted(resolution(tables).items())]
        sections = [("Files", _markdown(FILE_COLUMNS, lines)), ("Project Summary", _markdown(["key", "value"], summary_pairs(tables))), ("Resolution", _markdown(["key", "value"], told))]
        sections.append(("Cycles", "\n".join(f"- Cycle {i}: {' -> '.join(c)}" for i, c in enumerate(cycles)) or "_(no cycles)_"))
        return "\n\n".join(f"## {title}\n\n{body}" for title, body in sections) + "\n"
    if fmt == "json":
        return json.dumps({"project": rows_of(tables["project"])[0], "network": rows_of(tables["network"])[0], "resolution": resolution(tables), "files": files, "cycles": cycles}, ensure_ascii=False, indent=2)
    raise ValueError(f"unsupported export format: {fmt!r} (expected csv, md, or json)")


SYMBOL_COLUMNS = ("symbol_id", "file", "name", "kind", "start_line", "end_line", "loc", "cc", "params")


def symbol_rows(tables: dict[str, DataFrame]) -> DataFrame:
    """Functions and methods with their metrics, by id."""
    named = tables["symbols"].where("kind in ('function', 'method')").select(F.col("id").alias("symbol_id"), F.col("file_id").alias("file"), "name", "kind", "start_line", "end_line")
    return named.join(tables["symbol_metrics"], "symbol_id", "left").select(*SYMBOL_COLUMNS).orderBy("symbol_id")


def export_symbols_csv(tables: dict[str, DataFrame]) -> str:
    return _csv(SYMBOL_COLUMNS, [list(r.values()) for r in rows_of(symbol_rows(tables))])


# tables for people

TABLE_COLUMNS = ("path", "lang", "loc_code", "funcs", "classes", "cc_max", "mi", "fan_in", "fan_out")


def metric_table(tables: dict[str, DataFrame], sort_by: str = "path", top: int | None = None) -> list[dict[str, Any]]:
    """The short view of each file, numbers in falling order, ties by path."""
    joined = tables["files"].select(F.col("id").alias("file_id"), F.col("language").alias("lang")).join(tables["file_metrics"], "file_id", "left")
    rows = joined.select(F.col("file_id").alias("path"), "lang", *[F.coalesce(F.col(a), F.lit(0)).alias(b) for a, b in (("loc_code", "loc_code"), ("functions", "funcs"), ("classes", "classes"), ("cc_max", "cc_max"))], F.round(F.coalesce("mi", F.lit(0.0)), 1).alias("mi"), *[F.coalesce(c, F.lit(0)).alias(c) for c in ("fan_in", "fan_out")])
    order = F.col(sort_by) if sort_by in ("path", "lang") else F.desc(sort_by)
    rows = rows.orderBy(order, "path")
    return rows_of(rows.limit(top) if top is not None else rows)


def render_table(rows: list[dict[str, Any]]) -> str:
    cells = [list(TABLE_COLUMNS), *[[str(r[c]) for c in TABLE_COLUMNS] for r in rows]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(TABLE_COLUMNS))]
    cells.insert(1, ["-" * w for w in widths])
    return "\n".join("  ".join(x.ljust(w) for x, w in zip(r, widths, strict=True)) for r in cells)


def kept_sources(sources: DataFrame) -> DataFrame:
    """(id, source) of the sources that a report embeds: in order of id, none over the limit
    for a file, and none from the first at which the total passes its limit. The running total
    starts from those of ranges of ids, so that no task holds more than a range."""
    sized = sources.select("id", F.length("source").alias("size")).where(F.col("size") <= MOST_SOURCE_CHARS)
    placed = saved(sized.repartitionByRange("id").select("id", "size", F.spark_partition_id().alias("range")), "source-sizes")
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("range").agg(F.sum("size").alias("total")).select("range", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("base")).where(F.col("base") <= MOST_TOTAL_CHARS)
    upto = Window.partitionBy("range").orderBy("id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ids = placed.join(totals, "range").withColumn("running", F.col("base") + F.sum("size").over(upto)).where(F.col("running") <= MOST_TOTAL_CHARS).select("id")
    return sources.select("id", "source").join(ids, "id")


# impact


def impact_document(found: dict) -> dict[str, Any]:
    """An impact with its DataFrames nested by file, in order of hops."""
    if "error" in found:
        return found
    from basaltic.operators.impact import grouped

    files = [{"file_id": r["file_id"], "symbols": [{k: s[k] for k in ("symbol_id", "lines", "confidence", "via", "hops")} for s in r["symbols"]]} for r in rows_of(grouped(found["affected"]))]
    stats = {"files": len(files), "symbols": sum(len(f["symbols"]) for f in files), "max_hops_reached": found["max_hops_reached"]}
    kept = {k: v for k, v in found.items() if k in ("query", "origin", "origins", "hunks", "sliced_vars")}
    return kept | {"affected_files": files, "unresolved_boundaries": rows_of(found["boundaries"]), "stats": stats}


def impact_text(doc: dict) -> str:
    if "error" in doc:
        return f"error: {doc['error']}"
    lines = []
    if "query" in doc:
        lines.append(f"impact of {doc['query']['file']}:{doc['query']['start_line']}-{doc['query']['end_line']} (depth {doc['query']['depth']})")
    lines += [f"origin: {o['symbol_id']} [{o['kind']}]" for o in doc.get("origins") or [doc["origin"]]]
    lines += [f"hunk: {h['file']}:{h['start']}-{h['end']} [{h['status']}]" + (f" ({h['reason']})" if h.get("reason") else "") for h in doc.get("hunks", ())]
    if doc["sliced_vars"]:
        lines.append("variables: " + ", ".join(doc["sliced_vars"]))
    for f in doc["affected_files"]:
        lines.append(f["file_id"])
        lines += [f"  {s['symbol_id']}  lines {','.join(map(str, s['lines'])) or '-'}  {s['confidence']}  via {s['via']}  hops {s['hops']}" for s in f["symbols"]]
    lines += [f"boundary: {b['symbol_id']} line {b['line']}: {b['reason']}" for b in doc["unresolved_boundaries"]]
    stats = doc["stats"]
    return "\n".join([*lines, f"{stats['files']} files, {stats['symbols']} symbols" + (" (depth limit reached)" if stats["max_hops_reached"] else "")])


# comparison


def compare_document(sections: dict[str, DataFrame]) -> dict[str, Any]:
    """The sections of a comparison as one document; hotspots only where both sides have some."""
    split = lambda rows, a, b, make: {k: [make(r) for r in rows if r["status"] == k] for k in (a, b)}
    changed: dict[str, dict] = {}
    for r in rows_of(sections["files_changed"], "file_id", "key"):
        changed.setdefault(r["file_id"], {})[r["key"]] = [r["old_value"], r["new_value"]]
    files = split(rows_of(sections["files"], "file_id"), "added", "removed", lambda r: r["file_id"])
    out = {
        "schema_version": SCHEMA_VERSION,
        "kind": "comparison",
        "project_delta": {r["key"]: [r["old_value"], r["new_value"]] for r in rows_of(sections["project_delta"], "key")},
        "files": files | {"changed": [{"file_id": k, "deltas": v} for k, v in changed.items()]},
        "edges": split(rows_of(sections["edges"], "src", "dst"), "added", "removed", lambda r: {k: r[k] for k in ("src", "dst", "kind")}),
        "cycles": split(rows_of(sections["cycles"], "cycle"), "added", "removed", lambda r: r["cycle"]),
    }
    if "hotspots" in sections:
        out["hotspots"] = split(rows_of(sections["hotspots"], "file_id"), "new", "resolved", lambda r: r["file_id"])
    return out


def is_same(doc: dict) -> bool:
    """Whether a comparison found nothing."""
    return not any([doc["project_delta"], *doc["files"].values(), *doc["edges"].values(), *doc["cycles"].values(), *doc.get("hotspots", {}).values()])


# pages


def _page(title: str, body: str, data: dict) -> str:
    packed = base64.b64encode(gzip.compress(json.dumps(data, ensure_ascii=False).encode(), mtime=0)).decode()
    style = "body{font:14px sans-serif;margin:2em}table{border-collapse:collapse}td,th{border:1px solid #ccc;padding:2px 8px;text-align:left}"
    return f'<!doctype html><html><head><meta charset="utf-8"><title>{html.escape(title)}</title><style>{style}</style></head><body><h1>{html.escape(title)}</h1>{body}<script type="application/gzip+base64" id="data">{packed}</script></body></html>'


def _rows_html(headers, rows) -> str:
    line = lambda tag, r: "<tr>" + "".join(f"<{tag}>{html.escape('' if x is None else str(x))}</{tag}>" for x in r) + "</tr>"
    return f"<table>{line('th', headers)}{''.join(line('td', r) for r in rows)}</table>"


def report_html(tables: dict[str, DataFrame], document: dict, embed_sources: bool = False) -> str:
    """One self-contained page; the document rides along, packed."""
    if embed_sources:
        document = document | {"sources": {r["id"]: r["source"] for r in rows_of(kept_sources(tables["sources"]))}}
    body = "<h2>Summary</h2>" + _rows_html(["key", "value"], summary_pairs(tables)) + "<h2>Files</h2>" + _rows_html(FILE_COLUMNS, [[r[c] for c in FILE_COLUMNS] for r in file_rows(tables)])
    return _page("Code analysis", body + "<h2>Cycles</h2>" + _rows_html(["files"], [[" -> ".join(c)] for c in cycle_list(tables)]), document)


def compare_html(doc: dict) -> str:
    if is_same(doc):
        return _page("Comparison", "<p>No differences.</p>", doc)
    by_mi = sorted(doc["files"]["changed"], key=lambda f: (-abs((lambda d: d[1] - d[0])(f["deltas"].get("mi", [0, 0]))), f["file_id"]))
    body = "<h2>Project</h2>" + _rows_html(["key", "old", "new"], [(k, *v) for k, v in doc["project_delta"].items()])
    body += "<h2>Files</h2>" + _rows_html(["file", "key", "old", "new"], [(f["file_id"], k, *v) for f in by_mi for k, v in f["deltas"].items()])
    for name in ("files", "edges", "cycles", "hotspots"):
        for status, items in doc.get(name, {}).items():
            if status != "changed":
                body += f"<h2>{name} {status}</h2>" + _rows_html([name], [[x if isinstance(x, str) else json.dumps(x)] for x in items])
    return _page("Comparison", body, doc)


TARGET = re.compile(r"^(.+):(\d+)(?:-(\d+))?$")


def parse_target(text: str) -> tuple[str, int, int] | None:
    """``FILE:LINE`` or ``FILE:START-END``."""
    m = TARGET.match(text)
    return (m[1], int(m[2]), int(m[3] or m[2])) if m else None
