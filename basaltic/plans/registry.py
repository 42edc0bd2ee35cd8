"""Named queries over the star-schema tables, with their SQL twins.

The tables hold no source trees, so each operator runs over a relation of the same shape: the
successor graph of parts and the trade graph of nations for files and symbols, events for
commits, documents for sources, orders for snapshots and spans, page urls for paths.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basaltic.functions import text
from basaltic.operators import churn, compare, graph, impact, metrics, resolve
from basaltic.plans import generated
from basaltic.plans.project import sized
from basaltic.plans.tables import LOG_SQL, SUCCESSOR_SQL, TRADE_SQL, change_log, log_blocks, successor_graph, table, text_files, trade_graph
from basaltic.sources import sinks
from basaltic.sources.extract import fact_table
from basaltic.storage import saved

QUERIES: dict = {}
SQL: dict[str, str] = {}
#: Rounds that the SQL twins write out; both converge or reach their end sooner.
RANK_ROUNDS, LABEL_ROUNDS = 40, 10


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fan counts of the successor graph, the most used first."""
    return fan_metrics(spark, sf_dir).orderBy(F.desc("fan_in"), "id").limit(20)


# graph operators


@query(f"""WITH {SUCCESSOR_SQL},
i AS (SELECT dst AS id, count(*) AS fan_in FROM se WHERE dst IN (SELECT id FROM sn) GROUP BY 1),
o AS (SELECT src AS id, count(*) FILTER (dst IN (SELECT id FROM sn)) AS fan_out, count(*) FILTER (dst NOT IN (SELECT id FROM sn)) AS fan_out_external FROM se GROUP BY 1)
SELECT id, coalesce(fan_in, 0) AS fan_in, coalesce(fan_out, 0) AS fan_out, coalesce(fan_out_external, 0) AS fan_out_external FROM sn LEFT JOIN i USING (id) LEFT JOIN o USING (id)""")
def fan_metrics(spark, sf_dir):
    return graph.fan_metrics(*successor_graph(spark, sf_dir))


@query(f"""WITH {SUCCESSOR_SQL},
d AS (SELECT id, sum(i)::BIGINT AS in_degree, sum(o)::BIGINT AS out_degree FROM (SELECT src AS id, 0 AS i, 1 AS o FROM se UNION ALL SELECT dst, 1, 0 FROM se) GROUP BY 1)
SELECT id, coalesce(in_degree, 0) AS in_degree, coalesce(out_degree, 0) AS out_degree,
  round((coalesce(in_degree, 0) + coalesce(out_degree, 0)) / greatest((SELECT count(*) FROM sn) - 1, 1)::DOUBLE, 6) AS degree_centrality FROM sn LEFT JOIN d USING (id)""")
def degree_centrality(spark, sf_dir):
    return graph.degrees(*successor_graph(spark, sf_dir))


_LABELS = (
    f"WITH {SUCCESSOR_SQL}, ue AS MATERIALIZED (SELECT src AS a, dst AS b FROM se WHERE src IN (SELECT id FROM sn) AND dst IN (SELECT id FROM sn) UNION SELECT dst, src FROM se WHERE src IN (SELECT id FROM sn) AND dst IN (SELECT id FROM sn)), c0 AS (SELECT id, id AS component FROM sn)"
    + "".join(f", c{i + 1} AS MATERIALIZED (SELECT c.id, least(c.component, min(o.component)) AS component FROM c{i} c LEFT JOIN ue ON ue.a = c.id LEFT JOIN c{i} o ON o.id = ue.b GROUP BY c.id, c.component)" for i in range(LABEL_ROUNDS))
    + f", wc AS (SELECT id, component FROM c{LABEL_ROUNDS}), pe AS (SELECT count(*) // 2 AS m FROM ue)"
)


@query(_LABELS + " SELECT id, component FROM wc")
def weak_components(spark, sf_dir):
    return graph.weak_components(*successor_graph(spark, sf_dir))


@query(
    _LABELS
    + """, ie AS (SELECT count(*) AS m FROM se WHERE src IN (SELECT id FROM sn) AND dst IN (SELECT id FROM sn)) SELECT (SELECT count(*) FROM sn) AS nodes, (SELECT m FROM ie) AS edges,
  round((SELECT m FROM ie) / ((SELECT count(*) FROM sn) * ((SELECT count(*) FROM sn) - 1))::DOUBLE, 6) AS density,
  round((SELECT m FROM ie) / (SELECT count(*) FROM sn)::DOUBLE, 6) AS avg_degree,
  (SELECT count(DISTINCT component) FROM wc) AS wcc_count, (SELECT max(n) FROM (SELECT count(*) AS n FROM wc GROUP BY component)) AS wcc_largest"""
)
def network_summary(spark, sf_dir):
    return graph.network_summary(*successor_graph(spark, sf_dir))


_STRONG = f"""WITH RECURSIVE {TRADE_SQL},
r(a, b) AS (SELECT src, dst FROM te UNION SELECT r.a, te.dst FROM r JOIN te ON r.b = te.src),
s AS (SELECT x.a AS id, min(x.b) AS component FROM r x JOIN r y ON x.a = y.b AND x.b = y.a GROUP BY x.a),
sc AS (SELECT id, component FROM s WHERE component IN (SELECT component FROM s GROUP BY 1 HAVING count(*) > 1))"""


@query(_STRONG + " SELECT id, component FROM sc")
def strong_components(spark, sf_dir):
    return graph.strong_components(*trade_graph(spark, sf_dir))


@query(_STRONG + " SELECT array_to_string(list_sort(list(id)), ',') AS members FROM sc GROUP BY component")
def cycles(spark, sf_dir):
    return graph.cycles(*trade_graph(spark, sf_dir)).select(F.array_join(F.transform("cycle", lambda x: x.cast("string")), ",").alias("members"))


@query(f"""WITH RECURSIVE {SUCCESSOR_SQL},
b(id, hops) AS (SELECT min(dst), 0 FROM se UNION SELECT se.src, b.hops + 1 FROM b JOIN se ON se.dst = b.id WHERE b.hops < 10)
SELECT id, min(hops) AS hops FROM b GROUP BY id""")
def reverse_reach(spark, sf_dir):
    _, edges = successor_graph(spark, sf_dir)
    return graph.reverse_bfs(edges, edges.agg(F.min("dst").alias("id")))


@query(f"""WITH RECURSIVE {TRADE_SQL},
a(name, ancestor) AS (SELECT src, src FROM te UNION SELECT dst, dst FROM te UNION SELECT a.name, te.dst FROM a JOIN te ON a.ancestor = te.src)
SELECT name, ancestor FROM a""")
def ancestor_closure(spark, sf_dir):
    _, edges = trade_graph(spark, sf_dir)
    return graph.ancestors(edges.select(F.col("src").alias("name"), F.col("dst").alias("base")))


def _rank_sql(rounds: int) -> str:
    steps = [f"WITH {SUCCESSOR_SQL}, te AS MATERIALIZED (SELECT src, dst FROM se WHERE src IN (SELECT id FROM sn) AND dst IN (SELECT id FROM sn)), live AS (SELECT src AS id FROM te UNION SELECT dst FROM te), n AS (SELECT count(*) AS n FROM live), outs AS (SELECT src AS id, count(*) AS k FROM te GROUP BY 1), r0 AS (SELECT live.id, k, 1.0::DOUBLE / n AS rank FROM live CROSS JOIN n LEFT JOIN outs USING (id))"]
    for i in range(rounds):
        steps.append(
            f"d{i} AS (SELECT coalesce(sum(rank) FILTER (k IS NULL), 0) AS d FROM r{i}), g{i} AS (SELECT dst AS id, sum(rank / k) AS got FROM te JOIN r{i} ON r{i}.id = te.src GROUP BY 1), "
            f"r{i + 1} AS MATERIALIZED (SELECT id, k, 0.15::DOUBLE / n + 0.85::DOUBLE * (coalesce(got, 0) + d / n) AS rank FROM r{i} LEFT JOIN g{i} USING (id) CROSS JOIN d{i} CROSS JOIN n)"
        )
    return ", ".join(steps) + f" SELECT id, round(coalesce(rank, 0), 6) AS pagerank FROM sn LEFT JOIN r{rounds} USING (id)"


@query(_rank_sql(RANK_ROUNDS))
def page_rank(spark, sf_dir):
    ranks = graph.page_rank(*successor_graph(spark, sf_dir))
    return ranks.select("id", F.round("pagerank", 6).alias("pagerank"))


_LEVELS = 12
_PATHS = (
    f"WITH {TRADE_SQL}, p0 AS MATERIALIZED (SELECT id AS source, id, 0 AS dist, 1.0::DOUBLE AS paths FROM tn)"
    + "".join(
        f", p{i + 1} AS MATERIALIZED (SELECT * FROM p{i} UNION ALL SELECT source, te.dst, {i + 1}, sum(paths) FROM (SELECT * FROM p{i} WHERE dist = {i}) f JOIN te ON te.src = f.id WHERE NOT EXISTS (SELECT 1 FROM p{i} s WHERE s.source = f.source AND s.id = te.dst) GROUP BY source, te.dst)"
        for i in range(_LEVELS)
    )
    + f", sp AS (SELECT * FROM p{_LEVELS})"
)


@query(_PATHS + " SELECT source, id, dist, paths FROM sp")
def shortest_paths(spark, sf_dir):
    return graph.shortest_paths(*trade_graph(spark, sf_dir))


@query(_PATHS + " SELECT tn.id, round(coalesce(sum(1.0::DOUBLE / dist) FILTER (dist > 0), 0) / ((SELECT count(*) FROM tn) - 1), 6) AS closeness FROM tn LEFT JOIN sp ON sp.id = tn.id GROUP BY tn.id")
def closeness(spark, sf_dir):
    nodes, edges = trade_graph(spark, sf_dir)
    found = graph.closeness(nodes, graph.shortest_paths(nodes, edges))
    return found.select("id", F.round("closeness", 6).alias("closeness"))


@query(
    _PATHS
    + """, through AS (
  SELECT m.id, sum(a.paths * b.paths / t.paths) AS total FROM sp t JOIN sp a ON a.source = t.source JOIN tn m ON m.id = a.id JOIN sp b ON b.source = m.id AND b.id = t.id
  WHERE m.id <> t.source AND m.id <> t.id AND a.dist + b.dist = t.dist GROUP BY m.id)
SELECT id, round(coalesce(total, 0) / (((SELECT count(*) FROM tn) - 1) * ((SELECT count(*) FROM tn) - 2)), 6) AS betweenness FROM tn LEFT JOIN through USING (id)"""
)
def betweenness(spark, sf_dir):
    nodes, edges = trade_graph(spark, sf_dir)
    found = graph.betweenness(nodes, edges, graph.shortest_paths(nodes, edges))
    return found.select("id", F.round("betweenness", 6).alias("betweenness"))


@query(f"WITH {SUCCESSOR_SQL} SELECT DISTINCT src AS id FROM se WHERE dst IN (SELECT min(dst) FROM se)")
def predecessors(spark, sf_dir):
    _, edges = successor_graph(spark, sf_dir)
    return graph.neighbours(edges, edges.agg(F.min("dst")).first()[0], incoming=True)


@query()
def impact_walk(spark, sf_dir):
    """Who depends on the first part that follows another, with lines and certainty; tested
    against a queue by hand."""
    _, edges = successor_graph(spark, sf_dir)
    marked = edges.select("src", "dst", (F.col("src") % 7 + 1).cast("int").alias("line"), ((F.col("src") + F.col("dst")) % 3 != 0).alias("certain"))
    return graph.reverse_walk(marked, edges.agg(F.min("dst").alias("id")))[0]


# change history


@query("""SELECT 'u' || user_id || '/' || event_type AS file_id, count(*) AS churn_commits, sum(coalesce(floor(value), 0))::BIGINT AS churn_added, sum(coalesce(floor(value)::BIGINT % 7, 0))::BIGINT AS churn_deleted,
  strftime(make_timestamp(max(floor(epoch(ts))::BIGINT) * 1000000), '%Y-%m-%d') AS last_commit FROM events GROUP BY 1""")
def churn_by_file(spark, sf_dir):
    return churn.churn(churn.parse_numstat(log_blocks(spark, sf_dir)))


_HOT = f"""WITH {LOG_SQL}, c AS (SELECT path AS file_id, count(*) AS churn_commits, sum(added)::BIGINT % 50 AS cc_total FROM log GROUP BY 1),
h AS (SELECT file_id, cc_total, churn_commits, CASE WHEN cc_total = 0 THEN 0.0::DOUBLE ELSE round(cume_dist() OVER (ORDER BY churn_commits) * cume_dist() OVER (ORDER BY cc_total), 4) END AS hotspot FROM c)"""


def _scored(spark, sf_dir):
    changes = churn.churn(change_log(spark, sf_dir))
    return churn.with_hotspots(changes.select("file_id", (F.col("churn_added") % 50).alias("cc_total")), changes).select("file_id", "cc_total", "churn_commits", "hotspot")


@query(_HOT + " SELECT * FROM h")
def hotspots(spark, sf_dir):
    return _scored(spark, sf_dir)


@query(_HOT + " SELECT * FROM h WHERE hotspot > 0 ORDER BY hotspot DESC, file_id LIMIT 20")
def top_hotspots(spark, sf_dir):
    return churn.top_hotspots(_scored(spark, sf_dir))


# comparison of two snapshots: orders of two half-years by customer


def _snapshot(spark, sf_dir, even: bool):
    orders = table(spark, sf_dir, "orders").where((F.month("o_orderdate") <= 6) == even)
    return orders.groupBy(F.col("o_custkey").alias("file_id")).agg(F.count(F.lit(1)).alias("functions"), F.max(F.floor("o_totalprice").cast("long")).alias("loc_total"), F.min(F.length("o_orderpriority").cast("long")).alias("fan_in"))


_SNAP = """WITH o AS (SELECT o_custkey AS file_id, month(o_orderdate) <= 6 AS early, count(*) AS functions, max(floor(o_totalprice)::BIGINT) AS loc_total, min(length(o_orderpriority))::BIGINT AS fan_in FROM orders GROUP BY 1, 2),
a AS (SELECT * FROM o WHERE early), b AS (SELECT * FROM o WHERE NOT early)"""


@query(
    _SNAP
    + """, x AS (SELECT file_id, unnest(['functions', 'loc_total', 'fan_in']) AS key, unnest([a.functions, a.loc_total, a.fan_in])::DOUBLE AS old_value, unnest([b.functions, b.loc_total, b.fan_in])::DOUBLE AS new_value FROM a JOIN b USING (file_id))
SELECT * FROM x WHERE abs(old_value - new_value) > 1e-9"""
)
def compare_files(spark, sf_dir):
    old, new = _snapshot(spark, sf_dir, True), _snapshot(spark, sf_dir, False)
    return compare.changed_values(old, new, ["file_id"], compare.file_keys(old, new))


@query(_SNAP + " SELECT coalesce(a.file_id, b.file_id) AS file_id, CASE WHEN a.file_id IS NULL THEN 'added' ELSE 'removed' END AS status FROM a FULL JOIN b USING (file_id) WHERE a.file_id IS NULL OR b.file_id IS NULL")
def compare_presence(spark, sf_dir):
    return compare.presence(_snapshot(spark, sf_dir, True), _snapshot(spark, sf_dir, False), ["file_id"])


@query(
    _SNAP
    + """, t AS (SELECT early, count(*) AS files, sum(loc_total)::BIGINT AS loc_total, sum(functions)::BIGINT AS functions FROM o GROUP BY 1),
x AS (SELECT unnest(['files', 'loc_total', 'functions']) AS key, unnest([a.files, a.loc_total, a.functions])::DOUBLE AS old_value, unnest([b.files, b.loc_total, b.functions])::DOUBLE AS new_value FROM t a, t b WHERE a.early AND NOT b.early)
SELECT * FROM x WHERE abs(old_value - new_value) > 1e-9"""
)
def project_delta(spark, sf_dir):
    total = [F.count(F.lit(1)).alias("files"), F.sum("loc_total").alias("loc_total"), F.sum("functions").alias("functions")]
    return compare.project_delta(_snapshot(spark, sf_dir, True).agg(*total), _snapshot(spark, sf_dir, False).agg(*total))


def _half_edges(spark, sf_dir, early: bool):
    orders = table(spark, sf_dir, "orders").where((F.month("o_orderdate") <= 6) == early)
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    supplied = orders.join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return supplied.select(F.col("o_custkey").alias("src"), F.col("l_suppkey").alias("dst"), F.lit("import").alias("kind"))


_EDGES = """WITH e AS (SELECT DISTINCT month(o_orderdate) <= 6 AS early, o_custkey AS src, l_suppkey AS dst, 'import' AS kind FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
a AS (SELECT src, dst, kind FROM e WHERE early), b AS (SELECT src, dst, kind FROM e WHERE NOT early)"""


@query(_EDGES + " SELECT *, 'added' AS status FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)")
def compare_edges(spark, sf_dir):
    return compare.import_edges(_half_edges(spark, sf_dir, True), _half_edges(spark, sf_dir, False))


def _cycles_of(spark, sf_dir, early: bool):
    """For each customer the priorities and states of its orders of a half-year, in no order."""
    orders = table(spark, sf_dir, "orders").where((F.month("o_orderdate") <= 6) == early)
    return orders.groupBy("o_custkey").agg(F.array_distinct(F.collect_list(F.concat("o_orderpriority", F.lit("/"), "o_orderstatus"))).alias("cycle")).select("cycle")


@query(
    """WITH c AS (SELECT DISTINCT early, cycle FROM (SELECT month(o_orderdate) <= 6 AS early, array_to_string(list_sort(list(DISTINCT o_orderpriority || '/' || o_orderstatus)), ',') AS cycle FROM orders GROUP BY 1, o_custkey)),
a AS (SELECT cycle FROM c WHERE early), b AS (SELECT cycle FROM c WHERE NOT early)
SELECT cycle, 'added' AS status FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT cycle, 'removed' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""
)
def compare_cycles(spark, sf_dir):
    found = compare.cycle_changes(_cycles_of(spark, sf_dir, True), _cycles_of(spark, sf_dir, False))
    return found.select(F.array_join("cycle", ",").alias("cycle"), "status")


def _hot_of(spark, sf_dir, odd: bool):
    log = change_log(spark, sf_dir).where((F.minute(F.timestamp_seconds("ts")) % 2 == 1) == odd)
    changes = churn.churn(log)
    return churn.top_hotspots(churn.with_hotspots(changes.select("file_id", (F.col("churn_added") % 50).alias("cc_total")), changes)).select("file_id")


@query(
    f"""WITH {LOG_SQL}, c AS (SELECT minute(make_timestamp(ts * 1000000)) % 2 = 1 AS odd, path AS file_id, count(*) AS n, sum(added)::BIGINT % 50 AS cc FROM log GROUP BY 1, 2),
h AS (SELECT odd, file_id, CASE WHEN cc = 0 THEN 0.0::DOUBLE ELSE round(cume_dist() OVER (PARTITION BY odd ORDER BY n) * cume_dist() OVER (PARTITION BY odd ORDER BY cc), 4) END AS hotspot FROM c),
t AS (SELECT * FROM h WHERE hotspot > 0 QUALIFY row_number() OVER (PARTITION BY odd ORDER BY hotspot DESC, file_id) <= 20),
a AS (SELECT file_id FROM t WHERE odd), b AS (SELECT file_id FROM t WHERE NOT odd)
SELECT file_id, 'new' AS status FROM (SELECT * FROM b EXCEPT SELECT * FROM a) UNION ALL SELECT file_id, 'resolved' FROM (SELECT * FROM a EXCEPT SELECT * FROM b)"""
)
def compare_hotspots(spark, sf_dir):
    """The top hotspots of even minutes against those of odd ones."""
    return compare.hotspot_changes(_hot_of(spark, sf_dir, True), _hot_of(spark, sf_dir, False))


# names to definitions: lineitems call parts, which suppliers define


_CALLS = """WITH c AS (SELECT l_orderkey * 10 + l_linenumber AS call_id, min(l_suppkey) AS own, min(s_nationkey) AS bound, min('T' || l_partkey % 60) AS name FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1),
d AS (SELECT DISTINCT p_partkey % 40 + 1 AS home, p_partkey % 25 AS nation, 'T' || p_partkey % 57 AS name, 'D' || p_partkey % 301 AS dst FROM part),
h AS (SELECT DISTINCT call_id, dst, 1 AS tier FROM c JOIN d ON c.own = d.home AND c.name = d.name
  UNION ALL SELECT DISTINCT call_id, dst, 2 FROM c JOIN d ON c.bound = d.nation AND c.name = d.name UNION ALL SELECT DISTINCT call_id, dst, 3 FROM c JOIN d ON c.name = d.name),
b AS (SELECT * FROM h QUALIFY tier = min(tier) OVER (PARTITION BY call_id)),
j AS (SELECT call_id, dst, tier, count(*) OVER (PARTITION BY call_id) AS n FROM b UNION ALL SELECT DISTINCT call_id, 'unresolved:' || name, 4, 1 FROM c WHERE call_id NOT IN (SELECT call_id FROM h)),
v AS (SELECT call_id, dst, CASE WHEN tier = 4 THEN 'unresolved' WHEN n = 1 AND tier < 3 THEN 'certain' ELSE 'inferred' END AS confidence, n > 1 AS ambiguous FROM j)"""


def _called(spark, sf_dir):
    """Calls and the steps that resolve them. The least name of a call is found by its rank among
    all names, since Spark aggregates numbers by hashing but sorts for texts. Few lines share a
    call, so they are dealt by it before they are aggregated, not merged in each task first."""
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("target_file"))
    names = sorted(f"T{m}" for m in range(-59, 60))
    rank = F.get(F.lit([names.index(f"T{m}") for m in range(-59, 60)]), (F.col("l_partkey") % 60 + 59).cast("int"))
    call = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    lines = table(spark, sf_dir, "lineitem").join(supplier, "l_suppkey").select(call.alias("call_id"), "l_suppkey", "target_file", rank.alias("rank"))
    least = lines.repartition("call_id").groupBy("call_id").agg(F.min("l_suppkey").alias("file_id"), F.min("target_file").alias("target_file"), F.min("rank").alias("rank"))
    calls = least.select("call_id", "file_id", "target_file", F.get(F.lit(names), F.col("rank")).alias("name"))
    p = F.col("p_partkey")
    named = table(spark, sf_dir, "part").select((p % 40 + 1).alias("file_id"), (p % 25).cast("int").alias("target_file"), F.concat(F.lit("T"), (p % 57).cast("string")).alias("name"), F.concat(F.lit("D"), (p % 301).cast("string")).alias("dst"))
    steps = [resolve.Step("file", ["file_id", "name"], named), resolve.Step("import", ["target_file", "name"], named), resolve.Step("proj", ["name"], named)]
    return resolve.placed(calls, steps), steps


@query(_CALLS + " SELECT DISTINCT call_id, dst, confidence, ambiguous FROM v")
def tiered_resolution(spark, sf_dir):
    calls, steps = _called(spark, sf_dir)
    return resolve.candidates(resolve.spread(saved(resolve.judged(calls), "placed")), steps, "confidence", "ambiguous")


_COUNTS = "count(*) AS total, count(*) FILTER (confidence = 'certain') AS certain, count(*) FILTER (confidence = 'inferred') AS inferred, count(*) FILTER (confidence = 'unresolved') AS unresolved, count(*) FILTER (ambiguous) AS ambiguous, round(count(*) FILTER (confidence = 'certain') * 100.0::DOUBLE / count(*), 1) AS certain_pct, round(count(*) FILTER (ambiguous) * 100.0::DOUBLE / count(*), 1) AS ambiguous_pct"


@query(_CALLS + f", w AS (SELECT DISTINCT call_id, dst, confidence, ambiguous, call_id % 3 AS kind FROM v) SELECT kind, {_COUNTS} FROM w GROUP BY kind")
def confidence_counts(spark, sf_dir):
    """Each call counts as the edges that it has, which aren't made one by one."""
    calls, _ = _called(spark, sf_dir)
    return metrics.confidence_counts(resolve.judged(calls).withColumn("kind", F.col("call_id") % 3), "kind", weight="n")


@query(
    """WITH e AS (SELECT CASE l_linenumber WHEN 1 THEN 'external:' WHEN 2 THEN 'unresolved:' ELSE '' END || l_partkey AS dst, l_returnflag = 'R' AS conditional FROM lineitem)
SELECT count(*) AS total, count(*) FILTER (NOT starts_with(dst, 'external:') AND NOT starts_with(dst, 'unresolved:')) AS certain, count(*) FILTER (starts_with(dst, 'unresolved:')) AS unresolved,
  count(*) FILTER (starts_with(dst, 'external:')) AS "external", count(*) FILTER (conditional) AS conditional FROM e"""
)
def import_counts(spark, sf_dir):
    prefix = F.when(F.col("l_linenumber") == 1, "external:").when(F.col("l_linenumber") == 2, "unresolved:").otherwise("")
    return metrics.import_counts(table(spark, sf_dir, "lineitem").select(F.lit("import").alias("kind"), F.concat(prefix, F.col("l_partkey").cast("string")).alias("dst"), (F.col("l_returnflag") == "R").alias("conditional")))


@query(
    """WITH h AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS href FROM pages)
SELECT page_id, href, CASE WHEN href IN (SELECT url FROM pages) THEN 'internal' WHEN contains(href, '://') THEN 'external' ELSE 'unresolved' END AS dst_class FROM h"""
)
def import_classes(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    links = pages.select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("href")).distinct()
    known = pages.select(F.col("url").alias("href"), F.lit(True).alias("known")).distinct()
    target = F.when(F.col("known"), F.col("href")).when(F.col("href").contains("://"), F.concat(F.lit("external:"), "href")).otherwise(F.concat(F.lit("unresolved:"), "href"))
    return links.join(known, "href", "left").select("page_id", "href", graph.dst_class(target).alias("dst_class"))


# sizes and complexity of texts


_PY = r"""(?:\"\"\"[\s\S]*?(?:\"\"\"|\z))|(?:'''[\s\S]*?(?:'''|\z))|"(?:[^"\\]|\\[\s\S])*(?:"|\\?\z)|'(?:[^'\\]|\\[\s\S])*(?:'|\\?\z)|#[^\n]*|\n|[^\n#"']+"""


@query(
    """WITH f AS (SELECT doc_id::VARCHAR AS id, coalesce(text, '') AS s, regexp_extract_all(coalesce(text, ''), '%s') AS ts FROM documents),
t AS (SELECT id, unnest(range(len(ts))) AS pos, unnest(ts) AS token FROM f),
k AS (SELECT id, pos, CASE WHEN token[1] IN ('"', '''') THEN 'string' WHEN token[1] = '#' THEN 'line' WHEN token = chr(10) THEN 'break' ELSE 'code' END AS kind,
  CASE WHEN token[1] IN ('"', '''') AND NOT starts_with(token, '\"\"\"') AND NOT starts_with(token, '''''''''') THEN regexp_replace(token, '\\\\[\\s\\S]', 'xx', 'g') ELSE token END AS token FROM t),
w AS (SELECT *, length(token) - length(replace(token, chr(10), '')) AS breaks FROM k),
p AS (SELECT *, 1 + coalesce(sum(breaks) OVER (PARTITION BY id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM w),
l AS (SELECT id, start + i AS line, kind IN ('string', 'code') AS is_code FROM (SELECT *, unnest(range(breaks + 1)) AS i FROM p)
  WHERE (kind = 'string' AND string_split(token, chr(10))[i + 1] <> '') OR (kind = 'line' AND i = 0) OR (kind = 'code' AND i = 0 AND trim(token, ' ' || chr(9) || chr(13) || chr(11) || chr(12)) <> '')),
b AS (SELECT id, line, bool_or(is_code) AS is_code FROM l GROUP BY 1, 2),
n AS (SELECT id, CASE WHEN s = '' THEN 0 ELSE len(string_split(s, chr(10))) - CASE WHEN ends_with(s, chr(10)) THEN 1 ELSE 0 END END AS loc_total FROM f),
c AS (SELECT n.id, loc_total, count(*) FILTER (is_code AND line <= loc_total) AS loc_code, count(*) FILTER (NOT is_code AND line <= loc_total) AS loc_comment FROM n LEFT JOIN b USING (id) GROUP BY 1, 2)
SELECT id, loc_total::BIGINT AS loc_total, loc_code, loc_comment, loc_total - loc_code - loc_comment AS loc_blank FROM c"""
    % _PY.replace("'", "''")
)
def loc_by_file(spark, sf_dir):
    return metrics.loc(text_files(spark, sf_dir))


_TOKENS = """WITH t AS (SELECT doc_id AS id, unnest(string_split(replace(text, chr(10), ' '), ' ')) AS token, len(string_split(text, chr(10))) AS loc FROM documents),
h AS (SELECT id, any_value(loc) AS loc, count(*) AS n, count(DISTINCT token) AS k FROM t WHERE token <> '' GROUP BY id),
v AS (SELECT id, loc, CASE WHEN k > 1 THEN n * log2(k) ELSE 0.0 END AS volume FROM h)"""


def _volumes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs, metrics.halstead(docs.select(F.col("doc_id").alias("id"), F.explode(F.split(F.replace("text", F.lit("\n"), F.lit(" ")), " ")).alias("token")).where("token <> ''"))


@query(_TOKENS + " SELECT id, round(volume, 4) AS volume FROM v")
def halstead_volume(spark, sf_dir):
    return _volumes(spark, sf_dir)[1].select("id", F.round("volume", 4).alias("volume"))


@query(_TOKENS + " SELECT id, round(greatest(0, least(100, (171 - 5.2::DOUBLE * CASE WHEN volume > 0 THEN ln(volume) ELSE 0 END - 0.23::DOUBLE * (id % 9) - 16.2::DOUBLE * ln(loc)) * 100 / 171)), 4) AS mi FROM v")
def maintainability(spark, sf_dir):
    docs, volumes = _volumes(spark, sf_dir)
    joined = volumes.join(docs.select(F.col("doc_id").alias("id"), F.size(F.split("text", "\n")).alias("loc")), "id")
    return joined.select("id", F.round(text.maintainability(F.col("volume"), F.col("id") % 9, F.col("loc")), 4).alias("mi"))


@query("SELECT lang AS language, count(*) AS files, sum(n_chars)::BIGINT AS loc_code FROM documents GROUP BY 1")
def language_totals(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return metrics.language_totals(docs.select(F.col("doc_id").alias("id"), F.col("lang").alias("language")), docs.select(F.col("doc_id").alias("file_id"), F.col("n_chars").alias("loc_code")))


_PATH = """WITH p AS (SELECT page_id, regexp_extract(url, '://[^/]*/(.*)$', 1) AS path FROM pages), q AS (SELECT *, string_split(path, '/') AS parts, string_split(path, '/')[-1] AS name FROM p)"""


@query(
    _PATH
    + """ SELECT page_id, path, name LIKE '%.html' AS by_glob,
  len(list_filter(parts[:-2], lambda x: x IN ('test', 'tests'))) > 0 OR starts_with(name, 'test_') OR ends_with(string_split(name, '.')[1], '_test')
  OR (len(string_split(name, '.')) >= 3 AND len(list_filter(string_split(name, '.')[2:-2], lambda x: x IN ('spec', 'test'))) > 0) AS is_test FROM q"""
)
def path_predicates(spark, sf_dir):
    path = F.regexp_extract("url", r"://[^/]*/(.*)$", 1)
    pages = table(spark, sf_dir, "pages").select("page_id", path.alias("path"))
    return pages.select("page_id", "path", text.glob_excluded(F.col("path"), ["*.html"]).alias("by_glob"), text.is_test_file(F.col("path")).alias("is_test"))


@query(
    """WITH d AS (SELECT doc_id::VARCHAR AS id, length(text) AS size FROM documents WHERE length(text) <= 200000), r AS (SELECT *, sum(size) OVER (ORDER BY id ROWS UNBOUNDED PRECEDING) AS running FROM d)
SELECT id, size FROM r WHERE running <= 20000000"""
)
def capped_sources(spark, sf_dir):
    """The documents that a report embeds; its caps on sizes are the feature."""
    kept = sinks.kept_sources(text_files(spark, sf_dir).where("source is not null"))
    return kept.select("id", F.length("source").cast("long").alias("size"))


# ranges


_DAYS = "WITH o AS (SELECT o_orderkey, o_custkey, datediff('day', DATE '1990-01-01', o_orderdate::DATE) AS start, datediff('day', DATE '1990-01-01', o_orderdate::DATE) + (o_orderkey % 20)::INT AS stop FROM orders)"


def _spans(spark, sf_dir):
    start = F.date_diff(F.to_date("o_orderdate"), F.to_date(F.lit("1990-01-01")))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("file_id"), start.alias("start"), (start + (F.col("o_orderkey") % 20).cast("int")).alias("end"))


@query(
    _DAYS
    + """, g AS (SELECT *, CASE WHEN start > max(stop) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1 THEN 1 ELSE 0 END AS b FROM o),
i AS (SELECT *, sum(b) OVER (PARTITION BY o_custkey ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM g)
SELECT o_custkey AS file_id, min(start)::INT AS start, max(stop)::INT AS "end" FROM i GROUP BY o_custkey, island"""
)
def merged_ranges(spark, sf_dir):
    return impact.merge_ranges(_spans(spark, sf_dir).select("file_id", "start", "end"), ["file_id"])


@query(
    _DAYS
    + """, m AS (SELECT a.o_orderkey AS range_id, b.o_orderkey AS id, b.stop - b.start AS length FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND b.start <= a.start AND a.start <= b.stop)
SELECT range_id, arg_min(id, (length, id)) AS symbol_id FROM m GROUP BY range_id"""
)
def innermost_symbol(spark, sf_dir):
    spans = _spans(spark, sf_dir)
    symbols = spans.select("file_id", F.col("o_orderkey").alias("id"), F.lit("").alias("name"), F.lit("function").alias("kind"), F.col("start").alias("start_line"), F.col("end").alias("end_line"))
    wanted = spans.select(F.col("o_orderkey").alias("range_id"), "file_id", "start", F.col("start").alias("end"))
    return impact.enclosing_symbols(symbols, wanted).select("range_id", "symbol_id")


@query(
    """WITH e AS (SELECT l_partkey::VARCHAR AS src, CASE WHEN l_returnflag = 'A' THEN 'unresolved:' ELSE '' END || l_suppkey AS dst, l_linenumber AS line, l_returnflag = 'R' AS ambiguous FROM lineitem),
n AS (SELECT src, line, count(DISTINCT dst) AS n FROM e WHERE ambiguous GROUP BY 1, 2)
SELECT DISTINCT src AS symbol_id, CASE WHEN starts_with(dst, 'unresolved:') THEN 'unresolved callee ''' || substr(dst, 12) || '''' ELSE 'ambiguous resolution (' || n || ' candidates)' END AS reason, line
FROM e LEFT JOIN n USING (src, line) WHERE (starts_with(dst, 'unresolved:') OR ambiguous) AND src IN (SELECT p_partkey::VARCHAR FROM part)"""
)
def impact_boundaries(spark, sf_dir):
    flag = F.col("l_returnflag")
    edges = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("src"), F.concat(F.when(flag == "A", "unresolved:").otherwise(""), F.col("l_suppkey").cast("string")).alias("dst"), F.lit("call").alias("kind"), F.lit("inferred").alias("confidence"), (flag == "R").alias("ambiguous"), F.col("l_linenumber").alias("line"))
    visited = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("id"))
    return impact.boundaries(edges, visited)


@query(
    """WITH a AS (SELECT l_partkey::VARCHAR AS symbol_id, l_linenumber AS line, l_returnflag <> 'R' AS certain, CASE WHEN l_linestatus = 'F' THEN 'call' ELSE 'import' END AS via, l_orderkey * 10 + l_linenumber AS seq, (l_orderkey % 9)::INT AS hops, l_suppkey FROM lineitem)
SELECT symbol_id, array_to_string(list_sort(list(DISTINCT line)), ',') AS lines, CASE WHEN bool_or(certain) THEN 'certain' ELSE 'inferred' END AS confidence, arg_min(via, seq * 1000 + l_suppkey) AS via, min(hops) AS hops FROM a GROUP BY 1"""
)
def affected_symbols(spark, sf_dir):
    """Line items as single findings about their part, merged."""
    parts = table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").cast("string").alias("symbol_id"),
        F.array("l_linenumber").alias("lines"),
        F.when(F.col("l_returnflag") != "R", "certain").otherwise("inferred").alias("confidence"),
        F.when(F.col("l_linestatus") == "F", "call").otherwise("import").alias("via"),
        ((F.col("l_orderkey") * 10 + F.col("l_linenumber")) * 1000 + F.col("l_suppkey")).alias("seq"),
        (F.col("l_orderkey") % 9).cast("int").alias("hops"),
    )
    return impact.merge_affected(parts).withColumn("lines", F.array_join("lines", ","))


# source trees made from suppliers: what each file has to give, with {s} for the supplier's
# number and {t} for half of it


def _made_sql(fields: str, rows: list[tuple], select: str, where: str = "") -> str:
    """Each of ``rows``, filled in, for each supplier."""
    values = ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x) for x in r) + ")" for r in rows)
    filled = ", ".join(f"replace(replace({f}, '{{s}}', s::VARCHAR), '{{t}}', (s // 2)::VARCHAR) AS {f}" if isinstance(rows[0][i], str) else f for i, f in enumerate(fields.split(", ")))
    return f"WITH v({fields}) AS (VALUES {values}), n AS (SELECT s_suppkey AS s FROM supplier), m AS (SELECT s, {filled} FROM n CROSS JOIN v {where}) {select}"


_PY, _TS, _JS, _JAVA, _C, _CPP = (path for _, path, _ in generated.FILES)
_SYMBOLS = [
    (_PY, "::<module>", "module", 1, 20, "", 1, 0), (_PY, "::Store{s}", "class", 5, 13, "::<module>", 1, 0), (_PY, "::Store{s}::load", "method", 6, 10, "::Store{s}", 3, 2),
    (_PY, "::Store{s}::pick", "method", 12, 13, "::Store{s}", 1, 2), (_PY, "::make_{s}", "function", 16, 20, "::<module>", 1, 1),
    (_TS, "::<module>", "module", 1, 12, "", 1, 0), (_TS, "::Box{s}", "class", 2, 9, "::<module>", 1, 0), (_TS, "::Box{s}::load", "method", 3, 8, "::Box{s}", 3, 1), (_TS, "::make{s}", "function", 10, 12, "::<module>", 1, 1),
    (_JS, "::<module>", "module", 1, 12, "", 1, 0), (_JS, "::Box{s}", "class", 2, 9, "::<module>", 1, 0), (_JS, "::Box{s}::load", "method", 3, 8, "::Box{s}", 2, 1), (_JS, "::make{s}", "function", 10, 12, "::<module>", 2, 1),
    (_JAVA, "::<module>", "module", 1, 14, "", 1, 0), (_JAVA, "::Box{s}", "class", 4, 14, "::<module>", 1, 0), (_JAVA, "::Box{s}::load", "method", 5, 10, "::Box{s}", 2, 1), (_JAVA, "::Box{s}::step", "method", 11, 13, "::Box{s}", 1, 1),
    (_C, "::<module>", "module", 1, 8, "", 1, 0), (_C, "::make{s}", "function", 3, 8, "::<module>", 3, 1),
    (_CPP, "::<module>", "module", 1, 11, "", 1, 0), (_CPP, "::Box{s}", "class", 3, 11, "::<module>", 1, 0), (_CPP, "::Box{s}::load", "method", 5, 7, "::Box{s}", 2, 1), (_CPP, "::Box{s}::pick", "method", 8, 10, "::Box{s}", 1, 1),
]


def _made(spark, sf_dir, name: str):
    return fact_table(generated.facts(spark, sf_dir), name)


@query(_made_sql("file, own, kind, start_line, end_line, parent, cc, params", _SYMBOLS, "SELECT file || own AS id, kind, start_line, end_line, file || nullif(parent, '') AS parent_id, cc, params FROM m"))
def made_symbols(spark, sf_dir):
    return _made(spark, sf_dir, "symbols").select("id", "kind", "start_line", "end_line", "parent_id", "cc", "params")


_IMPORTS = [
    (_PY, "os", 1, "import", "os", False), (_PY, "store.m{t}", 2, "from", "make_{t},Store{t}", False), (_TS, "./m{t}", 1, "import", "make{t}", False), (_JS, "./m{t}.js", 1, "import", "make{t}", False),
    (_JAVA, "p{s}", 1, "package", "", False), (_JAVA, "p{t}.Box{t}", 2, "java_import", "Box{t}", False), (_JAVA, "java.util.List", 3, "java_import", "List", False),
    (_C, "stdio.h", 1, "include", "", True), (_C, "m{t}.c", 2, "include", "", False), (_CPP, "vector", 1, "include", "", True), (_CPP, "m{t}.cpp", 2, "include", "", False),
]


@query(_made_sql("file_id, raw, line, kind, locals, angle", _IMPORTS, "SELECT file_id, raw, line, kind, locals, angle FROM m"))
def made_imports(spark, sf_dir):
    return _made(spark, sf_dir, "imports").select("file_id", "raw", "line", "kind", F.array_join("names.local", ",").alias("locals"), "angle")


_CALLED = [
    (_PY, "::Store{s}::load", "pick", "self", 9), (_PY, "::Store{s}::pick", "make_{t}", "", 13), (_PY, "::make_{s}", "Store{s}", "", 17), (_PY, "::make_{s}", "load", "box", 18), (_PY, "::make_{s}", "missing_{s}", "", 19),
    (_TS, "::Box{s}::load", "make{t}", "", 5), (_JS, "::Box{s}::load", "make{t}", "", 5), (_JAVA, "::Box{s}::load", "step", "", 7), (_C, "::make{s}", "make{t}", "", 5), (_CPP, "::Box{s}::load", "pick", "", 6),
]


@query(_made_sql("file, own, callee, receiver, line", _CALLED, "SELECT file || own AS caller, callee, receiver, line FROM m"))
def made_calls(spark, sf_dir):
    return _made(spark, sf_dir, "calls").select("caller", "callee", F.coalesce("receiver", F.lit("")).alias("receiver"), "line")


_BASES = [(_PY, "::Store{s}", "Store{t}", 5), (_TS, "::Box{s}", "Box{t}", 2), (_JS, "::Box{s}", "Box{t}", 2), (_JAVA, "::Box{s}", "Box{t}", 4), (_CPP, "::Box{s}", "Box{t}", 3)]


@query(_made_sql("file, own, base, line", _BASES, "SELECT file || own AS class_id, base, line FROM m"))
def made_bases(spark, sf_dir):
    return _made(spark, sf_dir, "inherits").select("class_id", "base", "line")


_DEFUSES = [
    (_PY, "::Store{s}::load", "self", "6", "9", "9", 0), (_PY, "::Store{s}::load", "k", "6", "7,8", "", 1), (_PY, "::Store{s}::load", "total", "7", "8,9,10", "9,10", -1),
    (_PY, "::Store{s}::pick", "self", "12", "", "", 0), (_PY, "::Store{s}::pick", "x", "12", "13", "13", 1), (_PY, "::Store{s}::pick", "make_{t}", "", "13", "13", -1),
    (_PY, "::make_{s}", "y", "16", "18,19", "", 0), (_PY, "::make_{s}", "box", "17", "18,20", "20", -1), (_PY, "::make_{s}", "Store{s}", "", "17", "", -1), (_PY, "::make_{s}", "missing_{s}", "", "19", "", -1),
    (_TS, "::Box{s}::load", "k", "3", "4,5,7", "5,7", 0), (_TS, "::Box{s}::load", "make{t}", "", "5", "5", -1), (_TS, "::make{s}", "y", "10", "11", "11", 0),
    (_JS, "::Box{s}::load", "k", "3", "7", "7", 0), (_JS, "::Box{s}::load", "i", "4", "4,5", "", -1), (_JS, "::Box{s}::load", "make{t}", "", "5", "", -1), (_JS, "::make{s}", "y", "10", "11", "11", 0),
    (_JAVA, "::Box{s}::load", "k", "5,7", "6,7,9", "9", 0), (_JAVA, "::Box{s}::load", "step", "", "7", "", -1), (_JAVA, "::Box{s}::step", "k", "11", "12", "12", 0),
    (_C, "::make{s}", "k", "3", "4,5,7", "5,7", 0), (_C, "::make{s}", "make{t}", "", "5", "5", -1),
    (_CPP, "::Box{s}::load", "k", "5", "6", "6", 0), (_CPP, "::Box{s}::load", "pick", "", "6", "6", -1), (_CPP, "::Box{s}::pick", "k", "8", "9", "9", 0),
]


@query(_made_sql("file, own, var, def_lines, use_lines, return_lines, param_index", _DEFUSES, "SELECT file || own AS symbol_id, var, def_lines, use_lines, return_lines, param_index, param_index >= 0 AS is_param FROM m"))
def made_defuses(spark, sf_dir):
    lines = [F.array_join(c, ",").alias(c) for c in ("def_lines", "use_lines", "return_lines")]
    return _made(spark, sf_dir, "defuses").select("symbol_id", "var", *lines, "param_index", "is_param")


_HINTS = [("::Store{s}::load", "k", "int", "", False), ("::Store{s}::load", "total", "", "", True), ("::make_{s}", "box", "", "Store{s}", False)]


@query(_made_sql("own, name, annos, ctors, other", _HINTS, "SELECT 'store/m' || s || '.py' || own AS scope, 'var' AS slot, name, annos, ctors, other FROM m"))
def made_hints(spark, sf_dir):
    return _made(spark, sf_dir, "hints").select("scope", "slot", "name", *[F.array_join(c, ",").alias(c) for c in ("annos", "ctors")], "other")


_MODULES = [
    (_PY, "external:os", 1), (_PY, "store/m{t}.py", 2), (_TS, "ts/m{t}.ts", 1), (_JS, "js/m{t}.js", 1), (_JAVA, "java/p{t}/Box{t}.java", 2), (_JAVA, "external:java", 3),
    (_C, "external:stdio.h", 1), (_C, "c/m{t}.c", 2), (_CPP, "external:vector", 1), (_CPP, "cpp/m{t}.cpp", 2),
]
#: zero: for supplier 0, whose own half it is; other: for all others; any: for all.
_EDGE_ROWS = [
    (_PY, "::Store{s}", "store/m{t}.py::Store{t}", "inherit", "certain", False, 5, "any"),
    *[(p, "::Box{s}", f"{q}::Box{{t}}", "inherit", "certain" if z else "inferred", not z, line, "zero" if z else "other")
      for p, line in ((_TS, 2), (_JS, 2), (_CPP, 3)) for z in (True, False) for q in ([p] if z else ["ts/m{t}.ts", "js/m{t}.js", "java/p{t}/Box{t}.java", "cpp/m{t}.cpp"])],
    (_JAVA, "::Box{s}", "java/p{t}/Box{t}.java::Box{t}", "inherit", "certain", False, 4, "any"),
    (_PY, "::Store{s}::load", "store/m{s}.py::Store{s}::pick", "call", "certain", False, 9, "any"), (_PY, "::Store{s}::pick", "store/m{t}.py::make_{t}", "call", "certain", False, 13, "any"),
    (_PY, "::make_{s}", "store/m{s}.py::Store{s}", "call", "certain", False, 17, "any"), (_PY, "::make_{s}", "store/m{s}.py::Store{s}::load", "call", "certain", False, 18, "any"),
    (_PY, "::make_{s}", "unresolved:missing_{s}", "call", "unresolved", False, 19, "any"),
    (_TS, "::Box{s}::load", "ts/m{t}.ts::make{t}", "call", "certain", False, 5, "any"), (_JS, "::Box{s}::load", "js/m{t}.js::make{t}", "call", "certain", False, 5, "any"),
    (_JAVA, "::Box{s}::load", "java/p{s}/Box{s}.java::Box{s}::step", "call", "certain", False, 7, "any"), (_CPP, "::Box{s}::load", "cpp/m{s}.cpp::Box{s}::pick", "call", "certain", False, 6, "any"),
    (_C, "::make{s}", "c/m{t}.c::make{t}", "call", "certain", False, 5, "zero"), *[(_C, "::make{s}", f"{q}::make{{t}}", "call", "inferred", True, 5, "other") for q in ("c/m{t}.c", "ts/m{t}.ts", "js/m{t}.js")],
]


def _made_edges(spark, sf_dir):
    facts = generated.facts(spark, sf_dir)
    files = saved(generated.source_tree(spark, sf_dir), "made-files")
    symbols = fact_table(facts, "symbols")
    imports, bindings, _ = resolve.resolve_modules(files, fact_table(facts, "imports"), symbols)
    calls = resolve.resolve_symbols(fact_table(facts, "calls"), fact_table(facts, "inherits"), symbols, saved(bindings, "made-bindings"), fact_table(facts, "hints"))
    return files, facts, symbols, imports, calls


@query(_made_sql("src, dst, line", _MODULES, "SELECT src, dst, line, 'import' AS kind, 'certain' AS confidence FROM m"))
def module_edges(spark, sf_dir):
    return _made_edges(spark, sf_dir)[3].select("src", "dst", "line", "kind", "confidence")


_EDGE_FIELDS, _EDGE_WHERE = "file, own, dst, kind, confidence, ambiguous, line, which", "WHERE which = 'any' OR (s = 0) = (which = 'zero')"


@query(_made_sql(_EDGE_FIELDS, _EDGE_ROWS, "SELECT file || own AS src, dst, kind, confidence, ambiguous, line FROM m", _EDGE_WHERE))
def symbol_edges(spark, sf_dir):
    return _made_edges(spark, sf_dir)[4].select("src", "dst", "kind", "confidence", "ambiguous", "line")


@query(
    _made_sql(_EDGE_FIELDS, _EDGE_ROWS, "", _EDGE_WHERE)
    + f""", l AS (SELECT *, unnest(['calls', CASE WHEN s % 5 <> 0 THEN 'non_test' END, 'language:' || CASE split_part(file, '/', 1) WHEN 'store' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'js' THEN 'javascript' ELSE split_part(file, '/', 1) END]) AS scope FROM m)
SELECT scope, {_COUNTS} FROM l WHERE scope IS NOT NULL GROUP BY scope"""
)
def resolution_scopes(spark, sf_dir):
    files, _, _, imports, calls = _made_edges(spark, sf_dir)
    return metrics.resolution_by_scope(files, imports.unionByName(calls))


_SIZES = [(_PY, 20, 15, 1, 4, 3, 1, 5, 3, 1), (_TS, 12, 12, 0, 0, 2, 1, 4, 3, 0), (_JS, 12, 12, 0, 0, 2, 1, 4, 2, 0), (_JAVA, 14, 14, 0, 0, 2, 1, 3, 2, 1), (_C, 8, 8, 0, 0, 1, 0, 3, 3, 1), (_CPP, 11, 11, 0, 0, 2, 1, 3, 2, 1)]
_SIZE_FIELDS = "file_id, loc_total, loc_code, loc_comment, loc_blank, functions, classes, cc_total, cc_max, fan_out_external"


def _measured(spark, sf_dir):
    files, facts, symbols, imports, calls = _made_edges(spark, sf_dir)
    tokens = fact_table(facts.select(F.transform("tokens", lambda t: F.struct(F.col("file_id").alias("id"), t["token"].alias("token"), t["n"].alias("n"))).alias("tokens")), "tokens")
    return files, *sized(files, files, symbols, saved(imports.unionByName(calls), "made-edges"), tokens)


@query(_made_sql(_SIZE_FIELDS, _SIZES, f"SELECT {_SIZE_FIELDS}, 1 AS fan_out, (SELECT count(*) FROM n x WHERE x.s // 2 = m.s) AS fan_in FROM m"))
def made_file_metrics(spark, sf_dir):
    return _measured(spark, sf_dir)[3].select(*_SIZE_FIELDS.split(", "), "fan_out", "fan_in")


@query(
    _made_sql(
        _SIZE_FIELDS,
        _SIZES,
        """SELECT count(*) AS files, sum(loc_total)::BIGINT AS loc_total, sum(loc_code)::BIGINT AS loc_code, sum(loc_comment)::BIGINT AS loc_comment, sum(loc_blank)::BIGINT AS loc_blank, sum(functions)::BIGINT AS functions,
  sum(classes)::BIGINT AS classes, sum(cc_total) / sum(functions)::DOUBLE AS cc_avg, max(cc_max)::BIGINT AS cc_max, 0::BIGINT AS cycles_count, count(*) FILTER (s % 5 = 0) AS test_files, (sum(loc_code) FILTER (s % 5 = 0))::BIGINT AS test_loc_code FROM m""",
    )
)
def made_project(spark, sf_dir):
    files, imports, _, by_file = _measured(spark, sf_dir)
    return metrics.project_metrics(files, by_file, graph.cycles(files.select("id"), imports).count()).drop("mi_avg")
