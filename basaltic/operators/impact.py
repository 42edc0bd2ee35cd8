"""What a change of some lines can affect, over the symbol, edge and def-use tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basaltic.operators.graph import reverse_walk
from basaltic.storage import saved

MODULE = "::<module>"
MAX_DEPTH = 10


def _suffixes(path: F.Column) -> F.Column:
    """What a path ends with, from its second segment on."""
    parts = F.split(path, "/")
    later = F.filter(parts, lambda _, i: i > 0)
    return F.transform(later, lambda _, i: F.array_join(F.slice(parts, i + 2, F.size(parts)), "/"))


def normalize_files(files: DataFrame, wanted: list[str], root: str = "") -> dict[str, str]:
    """For each of ``wanted`` the file that it means: exactly, relative to ``root``, or as the
    only one of which either path ends with the other. Those without one are left out."""
    top = root.rstrip("/") + "/" if root else ""
    paths = {w: w.replace("\\", "/").removeprefix("./") for w in wanted}
    paths = {w: p[len(top) :] if top and p.startswith(top) else p for w, p in paths.items()}
    if not paths:
        return {}
    asked = files.sparkSession.createDataFrame([(p,) for p in sorted(set(paths.values()))], "path string")
    ids = files.select("id")
    same = ids.where(F.col("id").isin(sorted(set(paths.values())))).select(F.col("id").alias("path"), "id", F.lit(True).alias("exact"))
    longer = ids.select("id", F.explode(_suffixes(F.col("id"))).alias("path")).join(asked, "path").select("path", "id", F.lit(False).alias("exact"))
    shorter = asked.select("path", F.explode(_suffixes(F.col("path"))).alias("id")).join(ids, "id").select("path", "id", F.lit(False).alias("exact"))
    rows = same.union(longer).union(shorter).groupBy("path").agg(F.max(F.when(F.col("exact"), F.col("id"))).alias("id"), F.min("id").alias("least"), F.max("id").alias("most"))
    found = {r.path: r.id or r.least for r in rows.collect() if r.id or r.least == r.most}
    return {w: found[p] for w, p in paths.items() if p in found}


def normalize_file(files: DataFrame, wanted: str, root: str = "") -> str | None:
    return normalize_files(files, [wanted], root).get(wanted)


def enclosing_symbols(symbols: DataFrame, ranges: DataFrame) -> DataFrame:
    """For ``ranges(range_id, file_id, start, end)`` the innermost symbol that holds each: the
    shortest, then the smallest id. An equi-join on the file with the range as a filter."""
    held = ranges.join(symbols.where("kind <> 'module'"), "file_id").where("start_line <= start and end <= end_line")
    best = held.groupBy("range_id").agg(F.min(F.struct((F.col("end_line") - F.col("start_line")).alias("length"), "id", "name", "kind")).alias("s"))
    return best.select("range_id", F.col("s.id").alias("symbol_id"), F.col("s.name").alias("symbol_name"), F.col("s.kind").alias("kind"))


def boundaries(edges: DataFrame, visited: DataFrame) -> DataFrame:
    """(symbol_id, reason, line) of unresolved and ambiguous references from ``visited(id)``."""
    calls = edges.where("kind <> 'import'")
    lost = (F.col("confidence") == "unresolved") | F.col("dst").startswith("unresolved:")
    counts = edges.where("ambiguous").groupBy("src", "line").agg(F.count_distinct("dst").alias("n"))
    rows = calls.where(lost | F.col("ambiguous")).join(visited.select(F.col("id").alias("src")).distinct(), "src", "left_semi").join(counts, ["src", "line"], "left")
    name = F.when(F.col("dst").contains(":"), F.regexp_replace("dst", "^[^:]*:", "")).otherwise(F.col("dst"))
    reason = F.when(lost, F.concat(F.lit("unresolved callee '"), name, F.lit("'"))).otherwise(F.concat(F.lit("ambiguous resolution ("), F.col("n").cast("string"), F.lit(" candidates)")))
    return rows.select(F.col("src").alias("symbol_id"), reason.alias("reason"), "line").distinct()


def merge_affected(parts: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per symbol: all lines, the fewest hops, the strongest confidence, and the cause
    that came first."""
    return parts.groupBy(*by, "symbol_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("lines")))).alias("lines"),
        F.when(F.bool_or(F.col("confidence") == "certain"), "certain").otherwise("inferred").alias("confidence"),
        F.min_by("via", "seq").alias("via"),
        F.min("hops").alias("hops"),
    )


RANGES = "range_id int, file_id string, start int, end int"
PARTS = ["symbol_id", "lines", "confidence", "via", "seq", "hops"]


def _origins(tables: dict[str, DataFrame], wanted: list[tuple]) -> list[dict]:
    """For each of ``wanted(range_id, file_id, start, end)`` its origin (symbol_id, symbol_name,
    kind): the innermost symbol, else the module if anything happens there; or its error."""
    symbols, edges = tables["symbols"], tables["edges"]
    ranges = symbols.sparkSession.createDataFrame(wanted, RANGES)
    inner = enclosing_symbols(symbols, ranges)
    modules = symbols.join(ranges.select("range_id", F.concat("file_id", F.lit(MODULE)).alias("id")), "id").select("range_id", F.col("id").alias("symbol_id"), F.col("name").alias("symbol_name"), "kind")
    sources = ranges.select("range_id", "start", "end", F.explode(F.array(F.struct(F.concat("file_id", F.lit(MODULE)).alias("src"), F.lit(False).alias("file")), F.struct(F.col("file_id").alias("src"), F.lit(True).alias("file")))).alias("s"))
    sources = sources.select("range_id", "start", "end", "s.src", "s.file")
    active = edges.join(sources, "src").where((~F.col("file") | (F.col("kind") == "import")) & F.col("line").between(F.greatest("start", F.lit(1)), F.col("end")))
    found = inner.withColumn("rank", F.lit(0)).union(modules.join(active.select("range_id"), "range_id", "left_semi").withColumn("rank", F.lit(1))).union(modules.withColumn("rank", F.lit(2)))
    best: dict[int, dict] = {}
    for row in found.orderBy("rank").collect():  # at most three for each range asked for
        best.setdefault(row.range_id, row.asDict())
    out = []
    for range_id, file_id, start, end in wanted:
        origin = best.get(range_id)
        if origin is None:
            out.append({"error": f"file {file_id!r} was not parsed; no symbols available"})
        elif origin["rank"] == 2:
            out.append({"error": f"no symbol or def-use activity at {file_id}:{start}-{end} (blank or comment line?)"})
        else:
            out.append({k: origin[k] for k in ("symbol_id", "symbol_name", "kind")})
    return out


def _impact(tables: dict[str, DataFrame], wanted: list[tuple], max_depth: int) -> dict:
    """The impact of all ranges ``wanted(range_id, file_id, start, end, oid, kind)`` together,
    the causes of earlier ranges first; each origin and each file is walked from once."""
    symbols, edges, defuses = (tables[t] for t in ("symbols", "edges", "defuses"))
    ranges = symbols.sparkSession.createDataFrame(wanted, RANGES + ", oid string, kind string")
    certain = ((F.col("confidence") == "certain") & ~F.col("ambiguous")).alias("certain")
    part_of = (F.col("id") == F.col("oid")) | ((F.col("of") == "class") & F.col("id").startswith(F.concat("oid", F.lit("::"))))
    seeds = symbols.select("id", "file_id").join(ranges.select("file_id", "oid", F.col("kind").alias("of")).distinct(), "file_id").where(part_of).select("oid", "id")
    seeds = saved(seeds.distinct(), "impact-seeds")
    references = edges.where("kind in ('call', 'inherit', 'type_ref')").select("src", "dst", "line", certain)
    by_symbol, cut_symbols = reverse_walk(references, seeds, max_depth, ("oid",))
    imports = edges.where("kind = 'import'").select("src", "dst", "line", certain)
    by_file, cut_files = reverse_walk(imports, ranges.select("file_id", F.col("file_id").alias("id")).distinct(), max_depth, ("file_id",))

    def seq(n: int) -> F.Column:
        return F.struct("range_id", F.lit(n).alias("part")).alias("seq")

    def walked(walk: DataFrame, by: str, via: str, n: int, suffix: str = "") -> DataFrame:
        first = ranges.groupBy(by).agg(F.min("range_id").alias("range_id"))
        return walk.join(first, by).select(F.concat("id", F.lit(suffix)).alias("symbol_id"), "lines", F.when(F.col("certain"), "certain").otherwise("inferred").alias("confidence"), F.lit(via).alias("via"), seq(n), "hops")

    own = defuses.withColumnRenamed("symbol_id", "oid").join(ranges.select("range_id", "oid", "start", "end"), "oid")
    sliced = own.withColumn("here", F.filter("def_lines", lambda d: d.between(F.col("start"), F.col("end")))).where(F.size("here") > 0)
    sliced = saved(sliced.select("range_id", "oid", "var", "here", "use_lines", "return_lines"), "impact-sliced")
    slice_lines = sliced.select("range_id", "oid", F.explode(F.array_union("here", "use_lines")).alias("line")).distinct()
    returned = sliced.where(F.array_max("return_lines") >= F.array_min("here")).select("range_id", "oid").distinct()
    fixed = [F.lit(c).alias(n) for n, c in (("confidence", "inferred"), ("via", "dataflow"))]
    sure = [F.lit(c).alias(n) for n, c in (("confidence", "certain"), ("via", "dataflow"))]
    calls = edges.where("kind = 'call'")
    parts = ranges.select(F.col("oid").alias("symbol_id"), F.sequence("start", "end").alias("lines"), *sure, seq(0), F.lit(0).alias("hops"))
    parts = parts.union(walked(by_symbol, "oid", "call", 1)).union(walked(by_file, "file_id", "import", 2, MODULE))
    own_lines = slice_lines.groupBy("range_id", "oid").agg(F.collect_list("line").alias("lines"))
    parts = parts.union(own_lines.select(F.col("oid").alias("symbol_id"), "lines", *sure, seq(3), F.lit(0).alias("hops")))
    callers = calls.select("src", F.col("dst").alias("oid"), "line").join(returned, "oid")
    parts = parts.union(callers.select(F.col("src").alias("symbol_id"), F.array("line").alias("lines"), *fixed, seq(4), F.lit(1).alias("hops")))
    fed = calls.select(F.col("src").alias("oid"), "dst", "line").join(slice_lines, ["oid", "line"]).join(symbols.select(F.col("id").alias("dst")), "dst", "left_semi").select("range_id", F.col("dst").alias("symbol_id")).distinct()
    params = defuses.where("is_param").join(fed, "symbol_id").groupBy("range_id", "symbol_id").agg(F.array_distinct(F.flatten(F.collect_list(F.concat("def_lines", "use_lines")))).alias("lines")).where(F.size("lines") > 0)
    parts = parts.union(params.select("symbol_id", "lines", *fixed, seq(5), F.lit(1).alias("hops")).select(*PARTS))
    parts = parts.withColumn("lines", F.filter("lines", lambda n: n > 0))

    known = symbols.select(F.col("id").alias("symbol_id"), "file_id")
    affected = merge_affected(parts).join(known, "symbol_id", "left").withColumn("file_id", F.coalesce("file_id", F.substring_index("symbol_id", "::", 1)))
    affected = saved(affected.select("file_id", "symbol_id", "lines", "confidence", "via", "hops"), "impact-affected")
    visited = affected.select(F.col("symbol_id").alias("id")).union(seeds.select("id")).distinct()
    return {
        "affected": affected,
        "boundaries": boundaries(edges, visited).orderBy("symbol_id", "line", "reason"),
        "sliced_vars": sorted(r[0] for r in sliced.select("var").distinct().collect()),
        "max_hops_reached": bool(cut_symbols.first()[0] or cut_files.first()[0]),
    }


def analyze(tables: dict[str, DataFrame], file: str, start: int, end: int | None = None, max_depth: int = MAX_DEPTH, root: str = "") -> dict:
    """The impact of lines ``start`` to ``end`` of ``file``: affected, boundaries (DataFrames),
    origin, sliced_vars and max_hops_reached; or error. tables: files, symbols, edges,
    defuses."""
    start, end = min(start, end or start), max(start, end or start)
    file_id = normalize_file(tables["files"], file, root)
    if file_id is None:
        return {"error": f"unknown file: {file!r} is not part of the analyzed project"}
    query = {"file": file_id, "start_line": start, "end_line": end, "depth": max_depth}
    (origin,) = _origins(tables, [(0, file_id, start, end)])
    if "error" in origin:
        return origin | {"query": query}
    return {"query": query, "origin": origin, **_impact(tables, [(0, file_id, start, end, origin["symbol_id"], origin["kind"])], max_depth)}


def grouped(affected: DataFrame) -> DataFrame:
    """(file_id, min_hops, symbols): nested by file, in order of hops and name."""
    nested = affected.groupBy("file_id").agg(F.min("hops").alias("min_hops"), F.array_sort(F.collect_list(F.struct("hops", "symbol_id", "lines", "confidence", "via"))).alias("symbols"))
    return nested.orderBy("min_hops", "file_id")


def merge_ranges(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, start, end): ranges that overlap or touch become one."""
    from pyspark.sql import Window

    before = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, 0)
    begins = F.coalesce((F.col("start") > F.max("end").over(before) + 1).cast("int"), F.lit(1))
    islands = ranges.withColumn("begins", begins).withColumn("island", F.sum("begins").over(upto))
    return islands.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")


def analyze_diff(tables: dict[str, DataFrame], hunks: list[dict], max_depth: int = MAX_DEPTH) -> dict:
    """The impact of all analysed ``hunks(file, start, end, status, reason)``, merged: one walk
    for all of them, whose jobs do not grow with their number."""
    seen = [dict(h) for h in hunks]
    asked = [i for i, h in enumerate(seen) if h["status"] == "analyzed"]
    ids = normalize_files(tables["files"], [seen[i]["file"] for i in asked])
    known = [(i, ids[seen[i]["file"]], seen[i]["start"], seen[i]["end"]) for i in asked if seen[i]["file"] in ids]
    found = {k[0]: o for k, o in zip(known, _origins(tables, known) if known else [])}
    for i in asked:
        error = found[i].get("error") if i in found else f"unknown file: {seen[i]['file']!r} is not part of the analyzed project"
        if error:
            seen[i] |= {"status": "skipped", "reason": error}
    wanted = [(*k, found[k[0]]["symbol_id"], found[k[0]]["kind"]) for k in known if "error" not in found[k[0]]]
    if not wanted:
        reasons: dict[str, int] = {}
        for hunk in seen:
            reasons[hunk.get("reason") or "none"] = reasons.get(hunk.get("reason") or "none", 0) + 1
        return {"error": "no analyzable hunks: " + (", ".join(f"{r} ({n})" for r, n in sorted(reasons.items())) or "the diff is empty"), "hunks": seen}
    origins = list({found[w[0]]["symbol_id"]: found[w[0]] for w in wanted}.values())
    return {"hunks": seen, "origins": origins, **_impact(tables, wanted, max_depth)}
