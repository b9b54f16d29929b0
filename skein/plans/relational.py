"""The operators on relational tables: each query projects tables to nodes, edges, files or lines and has independent SQL.

Projections, all over whole tables:
P1 hierarchy   order -> customer -> nation -> region and supplier -> nation, one repo
P3 page links  pages and the links in their html
P4 event flow  one repo per user, consecutive event types
P5 documents   a path made of source, number and fixed directories and names, with the text as content
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import detect, globs, paths, text
from ..operators import graph as G
from ..operators import recurse, resolve, rules, structural, symbols
from ..sources import scan
from ..sources.config import DEFAULT_VENDOR_GLOBS, Rule
from . import commands, render

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _id(prefix: str, col: str) -> Column:
    return F.concat(F.lit(prefix + "/"), F.col(col).cast("string"))


# --- P1


def p1_edges(spark: SparkSession, d: str) -> DataFrame:
    pair = lambda df, a, b: df.select(F.lit("shop").alias("repo"), a.alias("src"), b.alias("dst"), F.lit("local").alias("kind"))
    return (
        pair(t(spark, d, "orders"), _id("orders", "o_orderkey"), _id("customer", "o_custkey"))
        .unionByName(pair(t(spark, d, "customer"), _id("customer", "c_custkey"), _id("nation", "c_nationkey")))
        .unionByName(pair(t(spark, d, "supplier"), _id("supplier", "s_suppkey"), _id("nation", "s_nationkey")))
        .unionByName(pair(t(spark, d, "nation"), _id("nation", "n_nationkey"), _id("region", "n_regionkey")))
    )


def p1_nodes(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, key in (("orders", "o_orderkey"), ("customer", "c_custkey"), ("supplier", "s_suppkey"), ("nation", "n_nationkey"), ("region", "r_regionkey")):
        own = t(spark, d, name).select(F.lit("shop").alias("repo"), _id(name, key).alias("path"), F.lit(name).alias("lang"))
        out = own if out is None else out.unionByName(own)
    return out


_P1 = """WITH RECURSIVE e AS (
  SELECT 'orders/' || o_orderkey AS src, 'customer/' || o_custkey AS dst FROM orders UNION ALL
  SELECT 'customer/' || c_custkey, 'nation/' || c_nationkey FROM customer UNION ALL
  SELECT 'supplier/' || s_suppkey, 'nation/' || s_nationkey FROM supplier UNION ALL
  SELECT 'nation/' || n_nationkey, 'region/' || n_regionkey FROM nation),
n AS (
  SELECT 'orders/' || o_orderkey AS path FROM orders UNION ALL SELECT 'customer/' || c_custkey FROM customer UNION ALL
  SELECT 'supplier/' || s_suppkey FROM supplier UNION ALL SELECT 'nation/' || n_nationkey FROM nation UNION ALL SELECT 'region/' || r_regionkey FROM region)
"""


@query(_P1 + """SELECT n.path, (SELECT count(DISTINCT src) FROM e WHERE dst = n.path) AS in_deg, (SELECT count(DISTINCT dst) FROM e WHERE src = n.path) AS out_deg FROM n""")
def degrees_e3(spark, d):
    return G.degrees(p1_nodes(spark, d), p1_edges(spark, d)).select("path", "in_deg", "out_deg")


@query(_P1 + """SELECT path, in_deg AS dependents FROM (SELECT n.path, count(DISTINCT e.src) AS in_deg FROM n LEFT JOIN e ON e.dst = n.path GROUP BY n.path) ORDER BY in_deg DESC, path LIMIT 20""")
def heaviest_q8(spark, d):
    return G.heaviest(p1_nodes(spark, d), p1_edges(spark, d), 20).select("path", "dependents")


@query(_P1 + """SELECT path FROM n WHERE path NOT IN (SELECT dst FROM e)""")
def roots_e6(spark, d):
    return G.roots(p1_nodes(spark, d), p1_edges(spark, d)).select("path")


@query("""SELECT 'customer/' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)
UNION ALL SELECT 'tests/' || s_suppkey FROM supplier UNION ALL SELECT 'nation/' || n_nationkey FROM nation""")
def isolated_e7(spark, d):
    nodes, edges, _ = _sparse(spark, d)
    return G.isolated(nodes, edges).select("path")


def _sparse(spark, d):
    """Orders and customers as the only edges; suppliers as test files and nations as nodes without any."""
    edges = t(spark, d, "orders").select(F.lit("shop").alias("repo"), _id("orders", "o_orderkey").alias("src"), _id("customer", "o_custkey").alias("dst"), F.lit("local").alias("kind"))
    nodes = None
    for table, prefix, key in (("orders", "orders", "o_orderkey"), ("customer", "customer", "c_custkey"), ("supplier", "tests", "s_suppkey"), ("nation", "nation", "n_nationkey")):
        own = t(spark, d, table).select(F.lit("shop").alias("repo"), _id(prefix, key).alias("path"))
        nodes = own if nodes is None else nodes.unionByName(own)
    return nodes, edges, structural.tests(nodes)


@query("""SELECT 'customer/' || c_custkey AS path FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL
SELECT 'nation/' || n_nationkey FROM nation WHERE n_regionkey > 0""")
def orphans_e8(spark, d):
    nodes, edges, tests = _sparse(spark, d)
    kept = t(spark, d, "nation").where("n_regionkey = 0").select(F.lit("shop").alias("repo"), _id("nation", "n_nationkey").alias("path"))
    return G.orphans(nodes, edges, kept, tests).select("path")


@query("""SELECT 'tests/' || s_suppkey AS path FROM supplier WHERE s_nationkey <> 3""")
def test_entries_e9(spark, d):
    nodes, edges, tests = _sparse(spark, d)
    cargo = t(spark, d, "supplier").where("s_nationkey = 3").select(F.lit("shop").alias("repo"), _id("tests", "s_suppkey").alias("path"))
    return G.test_entries(nodes, edges, tests, cargo).select("path")


@query(_P1 + """SELECT DISTINCT src AS path FROM e WHERE dst = 'nation/7'""")
def who_imports_q3(spark, d):
    return G.who_imports(p1_edges(spark, d), "nation/7").select("path")


@query(_P1 + """SELECT dst AS path, 'local' AS kind FROM e WHERE src = 'nation/7'""")
def edges_from_e15(spark, d):
    return G.edges_from(p1_edges(spark, d), "nation/7").select("path", "kind")


@query(_P1 + """, r AS (SELECT dst AS path FROM e WHERE src = 'orders/1' UNION SELECT e.dst FROM e JOIN r ON e.src = r.path) SELECT path FROM r""")
def deps_of_e10(spark, d):
    return recurse.transitive_deps(p1_edges(spark, d), "orders/1").select("path")


@query(_P1 + """, r AS (SELECT src AS path FROM e WHERE dst = 'nation/7' UNION SELECT e.src FROM e JOIN r ON e.dst = r.path) SELECT path FROM r""")
def dependents_e11(spark, d):
    return recurse.transitive_dependents(p1_edges(spark, d), "nation/7").select("path")


@query(_P1 + """, r AS (SELECT src AS path, 1 AS depth FROM e WHERE dst = 'region/2' UNION SELECT e.src, r.depth + 1 FROM e JOIN r ON e.dst = r.path WHERE r.depth < 2)
SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY path""")
def impact_depth_e12(spark, d):
    return recurse.dependents_with_depth(p1_edges(spark, d), "region/2", 2).select("path", "depth")


@query(_P1 + """, r AS (SELECT src AS path, 1 AS depth FROM e WHERE dst = 'region/2' UNION SELECT e.src, r.depth + 1 FROM e JOIN r ON e.dst = r.path WHERE r.depth < 3)
SELECT path, CAST(min(depth) AS INTEGER) AS depth FROM r GROUP BY path""")
def impact_depth_sql_e12(spark, d):
    return recurse.bounded_closure_sql(spark, p1_edges(spark, d), "region/2", 3).select("path", "depth")


@query(_P1 + """, r AS (SELECT src AS path, 1 AS depth FROM e WHERE dst IN ('region/1', 'nation/7', 'nation/12') UNION SELECT e.src, r.depth + 1 FROM e JOIN r ON e.dst = r.path WHERE r.depth < 3)
SELECT path, CAST(min(depth) AS INTEGER) AS depth, path LIKE 'supplier/%' AS calls_symbol FROM r GROUP BY path""")
def impact_multi_q13(spark, d):
    edges = p1_edges(spark, d)
    span = "named_struct('start_line', 1, 'start_col', 0, 'end_line', 1, 'end_col', 1) AS span"
    defs = spark.createDataFrame([("shop", p) for p in ("region/1", "nation/7", "nation/12")], "repo string, path string")
    defs = defs.selectExpr("repo", "path", "0 AS ord", "'origin' AS name", "'function' AS kind", "true AS exported", span)
    calls = p1_nodes(spark, d).where("lang = 'supplier'").selectExpr("repo", "path", "0 AS ord", "'shop.origin' AS callee_raw", span)
    return symbols.impact(defs, calls, edges, "origin", 3).select("path", "depth", "calls_symbol")


@query(_P1 + """SELECT (SELECT count(*) FROM n) AS files, (SELECT count(*) FROM (SELECT DISTINCT * FROM e)) AS edges,
(SELECT count(*) FROM n WHERE path NOT IN (SELECT dst FROM e)) AS entry_points, CAST(0 AS BIGINT) AS cycles, CAST(0 AS BIGINT) AS largest_cycle_size,
(SELECT count(*) FROM n WHERE path NOT IN (SELECT dst FROM e) AND path NOT IN (SELECT src FROM e)) AS orphans,
(SELECT string_agg(path || '=' || c, ',' ORDER BY c DESC, path) FROM (SELECT dst AS path, count(DISTINCT src) AS c FROM e GROUP BY dst ORDER BY c DESC, path LIMIT 3)) AS heaviest""")
def orient_q15(spark, d):
    nodes, edges = p1_nodes(spark, d), recurse.cut(p1_edges(spark, d))
    scc = recurse.cyclic(recurse.components(edges), edges)
    none = nodes.select("repo", "path", F.lit("").alias("package")).where("false")
    row = commands.orient(nodes, edges, scc, G.roots(nodes, edges), G.isolated(nodes, edges), none)
    heavy = F.array_join(F.transform("heaviest", lambda x: F.concat_ws("=", x["file"], x["dependents"].cast("string"))), ",")
    return row.select("files", "edges", F.size("entry_points").cast("long").alias("entry_points"), "cycles", "largest_cycle_size", "orphans", heavy.alias("heaviest"))


# --- P3

_HREF = 'href="([^"]*)"'
_P3 = """WITH x AS (SELECT url, unnest(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS raw, generate_subscripts(regexp_extract_all(html, 'href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
i AS (SELECT url, raw, min(pos) AS ord FROM x GROUP BY url, raw)
"""


def p3_imports(spark: SparkSession, d: str) -> DataFrame:
    """Links as imports: repo web, path the page, raw the link; the first of equal ones per page."""
    rows = t(spark, d, "pages").select(F.lit("web").alias("repo"), F.col("url").alias("path"), F.posexplode(F.regexp_extract_all("html", F.lit(_HREF), F.lit(1))).alias("ord", "raw"))
    return rows.groupBy("repo", "path", "raw").agg(F.min("ord").alias("ord"))


@query(_P3 + """SELECT url AS path, raw, CAST(ord AS INTEGER) AS ord FROM i""")
def import_extract_p3(spark, d):
    return p3_imports(spark, d).select("path", "raw", "ord")


@query(_P3 + """SELECT url AS src, lower(raw) AS dst, first(CASE WHEN raw = lower(raw) THEN 'local' ELSE 'external' END ORDER BY ord) AS kind FROM i GROUP BY url, lower(raw)""")
def edge_collapse_e1(spark, d):
    raw = p3_imports(spark, d)
    kind = F.when(F.col("raw") == F.lower("raw"), "local").otherwise("external")
    return G.collapse_edges(raw.select("repo", F.col("path").alias("src"), F.lower("raw").alias("dst"), "ord", kind.alias("kind"))).select("src", "dst", "kind")


@query(_P3 + """, k AS (SELECT DISTINCT lower(regexp_replace(raw, '[.,]+$', '')) AS key FROM i),
c AS (SELECT url, raw, 0 AS rank, raw AS key FROM i UNION ALL SELECT url, raw, 1, regexp_replace(raw, '[.,]+$', '') FROM i UNION ALL SELECT url, raw, 2, lower(regexp_replace(raw, '[.,]+$', '')) FROM i)
SELECT c.url AS path, c.raw, arg_min(c.key, c.rank) AS target FROM c JOIN k USING (key) GROUP BY c.url, c.raw""")
def resolve_ranked_r(spark, d):
    imports = p3_imports(spark, d)
    bare = F.regexp_replace("raw", "[.,]+$", "")
    known = imports.select("repo", F.lower(bare).alias("key")).distinct().withColumn("target", F.col("key"))
    wanted = imports.select("repo", "path", "raw", F.array(F.col("raw"), bare, F.lower(bare)).alias("candidates"))
    return resolve.ranked_match(wanted, ["path", "raw"], known).select("path", "raw", "target")


@query(_P3 + """SELECT CAST(count(DISTINCT split_part(raw, '::', 1)) AS BIGINT) AS packages, count(*) AS pairs FROM (SELECT DISTINCT url, raw FROM i WHERE raw <> lower(raw))""")
def external_packages_q15(spark, d):
    imports = p3_imports(spark, d).withColumn("kind", F.when(F.col("raw") == F.lower("raw"), "local").otherwise("external"))
    found = G.external_packages(imports)
    return found.agg(F.count_distinct("package").alias("packages"), F.count("*").alias("pairs"))


# --- P4

_P4 = """WITH RECURSIVE s AS (SELECT CAST(user_id AS VARCHAR) AS repo, event_type AS src, lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS dst FROM events),
e AS (SELECT DISTINCT repo, src, dst FROM s WHERE dst IS NOT NULL),
n AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS repo, event_type AS path FROM events),
r AS (SELECT repo, src, dst FROM e UNION SELECT r.repo, r.src, e.dst FROM r JOIN e ON e.repo = r.repo AND e.src = r.dst),
m AS (SELECT n.repo, n.path, coalesce(min(b.src), n.path) AS scc_id FROM n LEFT JOIN (SELECT a.repo, a.src AS path, a.dst AS src FROM r a JOIN r b ON a.repo = b.repo AND a.src = b.dst AND a.dst = b.src) b ON b.repo = n.repo AND b.path = n.path GROUP BY n.repo, n.path),
z AS (SELECT repo, path, least(scc_id, path) AS scc_id FROM m),
q AS (SELECT z.repo, z.path, z.scc_id, count(*) OVER (PARTITION BY z.repo, z.scc_id) AS scc_size, count(*) OVER (PARTITION BY z.repo, z.scc_id) > 1 OR EXISTS (SELECT 1 FROM e WHERE e.repo = z.repo AND e.src = z.path AND e.dst = z.path) AS cyclic FROM z)
"""


def p4_nodes(spark, d) -> DataFrame:
    return t(spark, d, "events").select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("path")).distinct().withColumn("lang", F.lit("python"))


def p4_edges(spark, d) -> DataFrame:
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = t(spark, d, "events").select(F.col("user_id").cast("string").alias("repo"), F.col("event_type").alias("src"), F.lead("event_type").over(order).alias("dst"))
    return rows.where("dst is not null").distinct().withColumn("kind", F.lit("local"))


def _p4(spark, d):
    nodes, edges = p4_nodes(spark, d), recurse.cut(p4_edges(spark, d))
    found = recurse.components(edges)
    scc = nodes.select("repo", "path").join(found, ["repo", "path"], "left").select("repo", "path", F.coalesce("scc_id", "path").alias("scc_id"))
    return nodes, edges, recurse.cut(recurse.cyclic(scc, edges))


@query(_P4 + "SELECT repo, path, scc_id, scc_size, cyclic FROM q")
def scc_e4(spark, d):
    return _p4(spark, d)[2].select("repo", "path", "scc_id", "scc_size", "cyclic")


@query(_P4 + "SELECT DISTINCT e.repo, e.src AS path, z.scc_id FROM e JOIN z ON z.repo = e.repo AND z.path = e.src UNION SELECT e.repo, e.dst, z.scc_id FROM e JOIN z ON z.repo = e.repo AND z.path = e.dst")
def scc_distributed_e4(spark, d):
    return recurse.scc_distributed(recurse.cut(p4_edges(spark, d))).select("repo", "path", "scc_id")


@query(_P4 + "SELECT e.repo, e.src, e.dst FROM e JOIN q a ON a.repo = e.repo AND a.path = e.src JOIN q b ON b.repo = e.repo AND b.path = e.dst WHERE a.scc_id = b.scc_id AND a.cyclic")
def cycle_edges_e5(spark, d):
    _, edges, scc = _p4(spark, d)
    return recurse.cycle_edges(edges, scc).select("repo", "src", "dst")


@query(_P4 + "SELECT repo, scc_id, max(scc_size) AS size, string_agg(path, '>' ORDER BY path) AS members FROM q WHERE cyclic GROUP BY repo, scc_id")
def cycles_q6(spark, d):
    return recurse.cycles(_p4(spark, d)[2]).select("repo", "scc_id", "size", F.array_join("members", ">").alias("members"))


@query(_P4 + """, c AS (SELECT repo, scc_id, max(scc_size) AS size, string_agg(path, '>' ORDER BY path) AS members FROM q WHERE cyclic GROUP BY repo, scc_id)
SELECT repo, size, members FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY size DESC, scc_id) AS k FROM c) WHERE k = 1""")
def largest_cycle_q9(spark, d):
    return recurse.largest_cycle(_p4(spark, d)[2]).select("repo", "size", F.array_join("members", ">").alias("members"))


@query(_P4 + "SELECT repo, src, dst FROM r")
def closure_doubling_e10(spark, d):
    return recurse.closure_doubling(p4_edges(spark, d)).select("repo", "src", "dst")


@query(_P4 + """, w AS (SELECT repo, path AS here, path AS route, 0 AS hops FROM n WHERE path = 'click'
  UNION ALL SELECT w.repo, e.dst, w.route || '>' || e.dst, w.hops + 1 FROM w JOIN e ON e.repo = w.repo AND e.src = w.here WHERE NOT contains('>' || w.route || '>', '>' || e.dst || '>'))
SELECT repo, route FROM (SELECT repo, route, row_number() OVER (PARTITION BY repo ORDER BY hops, route) AS k FROM w WHERE here = 'purchase') WHERE k = 1""")
def shortest_path_e13(spark, d):
    return recurse.shortest_path(p4_edges(spark, d), "click", "purchase").select("repo", F.array_join("route", ">").alias("route"))


@query(_P4 + """SELECT repo, 'click>view' AS cycle FROM n WHERE false UNION ALL
SELECT repo, members FROM (SELECT repo, scc_id, string_agg(path, '>' ORDER BY path) AS members FROM q WHERE cyclic GROUP BY repo, scc_id) WHERE NOT (CAST(repo AS BIGINT) <= 20)""")
def baseline_diff_q18(spark, d):
    cycles = recurse.cut(recurse.cycles(_p4(spark, d)[2]))
    known = cycles.where("cast(repo AS long) <= 20").select("repo", F.reverse("members").alias("members"))
    return rules.new_cycles(cycles, known).select("repo", F.array_join("members", ">").alias("cycle"))


@query(_P4 + """, g AS (SELECT n.repo, n.path, (SELECT count(DISTINCT src) FROM e WHERE e.repo = n.repo AND e.dst = n.path) AS local_in, (SELECT count(DISTINCT dst) FROM e WHERE e.repo = n.repo AND e.src = n.path) AS local_out FROM n)
SELECT g.repo, g.path, local_in, local_out, CASE WHEN q.cyclic THEN 'cycle' WHEN local_in = 0 AND local_out = 0 THEN 'orphan' WHEN local_in = 0 THEN 'entry' ELSE '—' END AS status FROM g JOIN q ON q.repo = g.repo AND q.path = g.path""")
def table_o3(spark, d):
    nodes, edges, scc = _p4(spark, d)
    none = nodes.select("repo", "path").where("false")
    rows = render.table_rows(nodes, edges, scc, G.roots(nodes, edges), G.isolated(nodes, edges), none, none.withColumn("package", F.lit("")))
    return rows.select("repo", "path", "local_in", "local_out", "status")


@query(_P4 + """, l AS (SELECT repo, 0 AS s, '0' AS k, 'digraph dependencies {' AS line FROM n UNION SELECT repo, 0, '1', '  rankdir=LR;' FROM n UNION SELECT repo, 0, '2', '  node [shape=box fontname="monospace" fontsize=10];' FROM n
  UNION SELECT repo, 0, '3', '  edge [arrowsize=0.6];' FROM n UNION SELECT repo, 0, '4', '' FROM n
  UNION SELECT repo, 1, path, '  "' || path || '" [label="' || path || '" color="#3776ab"' || CASE WHEN cyclic THEN ' style=filled fillcolor="#ff000022"' ELSE '' END || '];' FROM q
  UNION SELECT repo, 2, '', '' FROM n
  UNION SELECT e.repo, 3, e.src || ' ' || e.dst, '  "' || e.src || '" -> "' || e.dst || '"' || CASE WHEN a.scc_id = b.scc_id AND a.cyclic THEN ' [color="#ff0000" style=dashed];' ELSE ';' END FROM e JOIN q a ON a.repo = e.repo AND a.path = e.src JOIN q b ON b.repo = e.repo AND b.path = e.dst
  UNION SELECT repo, 4, '', '}' FROM n)
SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY s, k) - 1 AS INTEGER) AS ord, line FROM l""")
def dot_o4(spark, d):
    return render.dot(*_p4(spark, d)).select("repo", "ord", "line")


@query(_P4 + """, i AS (SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) - 1 AS k FROM n),
l AS (SELECT repo, 0 AS s, 0 AS x, 0 AS y, 'graph LR' AS line FROM n UNION SELECT i.repo, 1, k, 0, '  n' || k || '["' || path || '"]' FROM i UNION SELECT repo, 2, 0, 0, '' FROM n
  UNION SELECT e.repo, 3, x.k, y.k, '  n' || x.k || CASE WHEN a.scc_id = b.scc_id AND a.cyclic THEN ' -.-> ' ELSE ' --> ' END || 'n' || y.k FROM e JOIN q a ON a.repo = e.repo AND a.path = e.src JOIN q b ON b.repo = e.repo AND b.path = e.dst JOIN i x ON x.repo = e.repo AND x.path = e.src JOIN i y ON y.repo = e.repo AND y.path = e.dst
  UNION SELECT i.repo, 4, i.k, 0, '  style n' || i.k || ' fill:#ff000022' FROM i JOIN q ON q.repo = i.repo AND q.path = i.path WHERE q.cyclic)
SELECT repo, CAST(row_number() OVER (PARTITION BY repo ORDER BY s, x, y) - 1 AS INTEGER) AS ord, line FROM l""")
def mermaid_o5(spark, d):
    return render.mermaid(*_p4(spark, d)).select("repo", "ord", "line")


@query()
def tree_o2(spark, d):
    nodes, edges, scc = _p4(spark, d)
    none = nodes.select("repo", "path").where("false")
    empty = nodes.select("repo", "path").where("false")
    g = G.DependencyGraph(nodes, empty, empty, empty, edges, scc, G.roots(nodes, edges), G.isolated(nodes, edges), none, none)
    return render.tree(g)


# --- P5

_DIRS = ["src", "tests", "vendor/lib", "app", "core/legacy", "pages", "types"]
_STEMS = ["main", "index", "test_unit", "view.test", "setup", "vite.config", "page", "sw", "job.worker", "card.stories", "util", "global.d"]
_EXTS = ["py", "ts", "rs", "h", "md", "zigzag", "", "JS", "tsx", "hs", "png", "zig", "xyz"]
_HEADS = ["", "#import <a.h>\n", "class A {};\n", "@interface B\n", "std::x\n", "#!/usr/bin/env -S python3.11 -u\n", "#!/bin/bash\n", "subclass_of\n"]


def _sql_list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"


_P5 = f"""WITH f AS (SELECT doc_id, coalesce(source, '') || '/d' || doc_id || '/' || {_sql_list(_DIRS)}[doc_id % {len(_DIRS)} + 1] || '/' || {_sql_list(_STEMS)}[doc_id % {len(_STEMS)} + 1]
  || CASE WHEN {_sql_list(_EXTS)}[doc_id % {len(_EXTS)} + 1] = '' THEN '' ELSE '.' || {_sql_list(_EXTS)}[doc_id % {len(_EXTS)} + 1] END AS path,
  {_sql_list(_HEADS)}[doc_id % {len(_HEADS)} + 1] || coalesce(text, '') AS content FROM documents),
x AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name, CASE WHEN regexp_matches(path, '[^/]\\.[^./]*$') THEN regexp_extract(path, '\\.([^./]*)$', 1) ELSE '' END AS ext,
  regexp_replace(regexp_extract(path, '([^/]*)$', 1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM f)
"""


def p5_sources(spark, d) -> DataFrame:
    pick = lambda xs: F.element_at(F.array(*map(F.lit, xs)), (F.col("doc_id") % len(xs) + 1).cast("int"))
    ext = pick(_EXTS)
    path = F.concat(F.coalesce("source", F.lit("")), F.lit("/d"), F.col("doc_id").cast("string"), F.lit("/"), pick(_DIRS), F.lit("/"), pick(_STEMS), F.when(ext == "", "").otherwise(F.concat(F.lit("."), ext)))
    body = F.concat(pick(_HEADS), F.coalesce("text", F.lit(""))).cast("binary")
    return t(spark, d, "documents").select(F.lit("docs").alias("repo"), path.alias("path"), F.length(body).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime_ns"), body.alias("content"))


_LANG = """CASE ext WHEN 'py' THEN 'python' WHEN 'ts' THEN 'typescript' WHEN 'tsx' THEN 'typescript' WHEN 'rs' THEN 'rust' WHEN 'hs' THEN 'haskell' WHEN 'zig' THEN 'zig'
  WHEN 'h' THEN CASE WHEN regexp_matches(content, '@(class|end|implementation|interface|optional|property|protocol|required|selector)') OR regexp_matches(content, '(^|\\n)[ \\t]*(#import[ <]|[-+] [(])') THEN 'objectivec'
    WHEN contains(content, '::') OR regexp_matches(content, '(^|[^A-Za-z0-9_])(class|constexpr|friend|namespace|noexcept|nullptr|operator|override|private|protected|public|template|typename|virtual)([^A-Za-z0-9_]|$)') THEN 'cpp' ELSE 'c' END
  WHEN '' THEN CASE WHEN starts_with(content, '#!/usr/bin/env -S python3.11') THEN 'python' WHEN starts_with(content, '#!/bin/bash') THEN 'bash' END END"""


@query(_P5 + f"SELECT path, {_LANG} AS lang FROM x")
def lang_detect_l1(spark, d):
    return scan.with_language(p5_sources(spark, d)).select("path", "lang")


@query(_P5 + """SELECT doc_id, CASE WHEN regexp_matches(content, '@(class|end|implementation|interface|optional|property|protocol|required|selector)') OR regexp_matches(content, '(^|\\n)[ \\t]*(#import[ <]|[-+] [(])') THEN 'objectivec'
  WHEN contains(content, '::') OR regexp_matches(content, '(^|[^A-Za-z0-9_])(class|constexpr|friend|namespace|noexcept|nullptr|operator|override|private|protected|public|template|typename|virtual)([^A-Za-z0-9_]|$)') THEN 'cpp' ELSE 'c' END AS lang FROM x""")
def header_sniff_l2(spark, d):
    rows = p5_sources(spark, d)
    return rows.select(F.regexp_extract("path", "/d([0-9]+)/", 1).cast("long").alias("doc_id"), detect.header_language(F.col("content")).alias("lang"))


@query("""SELECT * FROM (VALUES ('#!/usr/bin/env python3', 'python'), ('#!/usr/bin/env -S FOO=1 node20 x', 'javascript'), ('#!/bin/sh -e', 'bash'), ('#!/opt/pypy3.9', 'python'), ('#!/usr/bin/perl', NULL), ('no', NULL), ('#!/usr/bin/env tsx', 'typescript'), ('#! /usr/bin/ruby2.7', 'ruby')) v(line, lang)""")
def shebang_l3(spark, d):
    lines = ["#!/usr/bin/env python3", "#!/usr/bin/env -S FOO=1 node20 x", "#!/bin/sh -e", "#!/opt/pypy3.9", "#!/usr/bin/perl", "no", "#!/usr/bin/env tsx", "#! /usr/bin/ruby2.7"]
    return spark.createDataFrame([(x,) for x in lines], "line string").select("line", detect.shebang_language(F.col("line")).alias("lang"))


@query(_P5 + f""", k AS (SELECT path, ext FROM x WHERE ({_LANG}) IS NULL AND CASE WHEN ext <> '' THEN lower(ext) NOT IN ('md', 'png') ELSE content <> '' AND NOT contains(left(content, 1024), chr(0)) END),
g AS (SELECT path, CASE WHEN ext = '' THEN '(no extension)' ELSE lower(ext) END AS grp FROM k)
SELECT grp AS "group", count(*) AS count, array_to_string(list_slice(list(path ORDER BY string_split(path, '/')), 1, 3), ',') AS sample FROM g GROUP BY grp""")
def skipped_groups_s6(spark, d):
    return scan.skipped_groups(p5_sources(spark, d)).select("group", "count", F.array_join("sample", ",").alias("sample"))


@query(_P5 + """SELECT path FROM x WHERE strlen(content) <= 2048""")
def size_filter_s3(spark, d):
    return p5_sources(spark, d).where(F.col("size") <= 2048).select("path")


@query(_P5 + f"SELECT path, {_LANG} AS lang FROM x WHERE ({_LANG}) IN ('python', 'zig')")
def lang_filter_s4(spark, d):
    return scan.supported(p5_sources(spark, d), ["python", "zig"]).select("path", "lang")


@query(_P5 + """SELECT path FROM x WHERE NOT (contains('/' || path, '/vendor/') OR contains('/' || path, '/core/legacy/'))""")
def exclude_f1(spark, d):
    return p5_sources(spark, d).where(~globs.excluded(F.col("path"), ["**/vendor", "*/core/leg[a-c]cy"])).select("path")


@query(_P5 + """SELECT (SELECT count(*) FROM x WHERE NOT contains(path, '/vendor/')) AS kept, (SELECT count(*) FROM x WHERE contains(path, '/vendor/')) AS excluded""")
def first_party_f2(spark, d):
    rows, out = rules.first_party(p5_sources(spark, d).select("repo", "path"), DEFAULT_VENDOR_GLOBS)
    return rows.groupBy("repo").agg(F.count("*").alias("kept")).join(out, "repo").select("kept", "excluded")


@query(_P5 + """SELECT path, regexp_matches(path, '(^|/)(tests?|specs?|__tests__|__mocks__)(/|$)') OR regexp_matches(stem, '_(test|spec)$') OR regexp_matches(stem, '^(test|spec)_') OR contains(stem, '.test') OR contains(stem, '.spec') AS is_test,
  starts_with(lower(name), 'vite.config') AS is_config, lower(stem) = 'setup' AS is_setup, contains(lower(name), '.stories.') AS is_story,
  NOT regexp_matches(lower(name), '[.]d[.]ts$') AND ((regexp_matches(path, '(^|/)(src|app|client)/[^/]*$') AND lower(stem) IN ('main', 'index')) OR lower(stem) = 'sw' OR regexp_matches(lower(stem), '[.]worker$')) AS is_entry,
  NOT regexp_matches(lower(name), '[.]d[.]ts$') AND (contains(path, '/pages/') OR (contains(path, '/app/') AND lower(stem) = 'page')) AS is_route FROM x""")
def structural_e20(spark, d):
    p = F.col("path")
    return p5_sources(spark, d).select(
        "path", structural.is_test(p).alias("is_test"), structural.is_config(p).alias("is_config"), structural.is_setup(p).alias("is_setup"), structural.is_story(p).alias("is_story"), structural.is_runtime_entry(p).alias("is_entry"), structural.is_route(p).alias("is_route")
    )


_RULES = [Rule("no legacy", "*/*/core/**", "**/vendor/**"), Rule("flat", "*/src/*", "**"), Rule("tests stay out", "**/src/**", "**/{tests,pages}/**", "warn"), Rule("unused", "nowhere/**", "**/app/*")]


def p5_edges(spark, d) -> DataFrame:
    """Each file to the next one by number."""
    rows = p5_sources(spark, d).select("repo", "path", F.regexp_extract("path", "/d([0-9]+)/", 1).cast("long").alias("n"))
    nxt = rows.select("repo", (F.col("n") - 1).alias("n"), F.col("path").alias("dst"))
    return rows.join(nxt, ["repo", "n"]).select("repo", F.col("path").alias("src"), "dst", F.when(F.col("n") % 10 == 0, "external").otherwise("local").alias("kind"))


_P5E = _P5 + """, e AS (SELECT a.path AS src, b.path AS dst FROM x a JOIN x b ON b.doc_id = a.doc_id + 1 WHERE a.doc_id % 10 <> 0),
v AS (SELECT src, dst, regexp_matches(src, '^[^/]*/[^/]*/core/.') AS f1, regexp_matches(dst, '/vendor/.') AS t1, regexp_matches(src, '^[^/]*/src/[^/]*$') AS f2, true AS t2, regexp_matches(src, '(^|/)src/.') AS f3, regexp_matches(dst, '(^|/)(tests|pages)/.') AS t3, starts_with(src, 'nowhere/') AS f4, regexp_matches(dst, '(^|/)app/[^/]*$') AS t4 FROM e)
"""


@query(_P5E + """SELECT 'no legacy' AS rule, src, dst, 'error' AS severity FROM v WHERE f1 AND t1 UNION ALL SELECT 'flat', src, dst, 'error' FROM v WHERE f2 AND t2
UNION ALL SELECT 'tests stay out', src, dst, 'warn' FROM v WHERE f3 AND t3 UNION ALL SELECT 'unused', src, dst, 'error' FROM v WHERE f4 AND t4""")
def rules_q16(spark, d):
    return rules.violations(p5_edges(spark, d), _RULES).select("rule", "src", "dst", "severity")


@query(_P5E + """SELECT * FROM (SELECT 'no legacy' AS rule, count(*) FILTER (f1) AS from_matches, count(*) FILTER (t1) AS to_matches FROM v UNION ALL SELECT 'flat', count(*) FILTER (f2), count(*) FILTER (t2) FROM v
UNION ALL SELECT 'tests stay out', count(*) FILTER (f3), count(*) FILTER (t3) FROM v UNION ALL SELECT 'unused', count(*) FILTER (f4), count(*) FILTER (t4) FROM v) WHERE from_matches = 0 OR to_matches = 0""")
def dead_rules_q17(spark, d):
    return rules.dead_rules(p5_edges(spark, d), _RULES).select("rule", "from_matches", "to_matches")


@query("""WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS p FROM documents), k AS (SELECT doc_id, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM l)
SELECT doc_id, CAST(generate_subscripts(p, 1) AS INTEGER) AS line, unnest(p) AS content FROM k WHERE len(p) > 0""")
def lines_t1(spark, d):
    rows = t(spark, d, "documents").select("doc_id", F.posexplode(text.lines(F.col("text"))).alias("n", "content"))
    return rows.select("doc_id", (F.col("n") + 1).alias("line"), "content")


@query("""WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS p FROM documents)
SELECT doc_id, array_to_string(p[2:4], chr(10)) || CASE WHEN len(p) > 4 THEN chr(10) ELSE '' END AS win FROM l WHERE text IS NOT NULL""")
def slice_q20(spark, d):
    rows = t(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", text.window(F.col("text"), F.lit(2), F.lit(4)).alias("win"))


@query("""WITH l AS (SELECT doc_id, trim(string_split(text, chr(10))[1]) AS s FROM documents WHERE text <> '')
SELECT doc_id, CASE WHEN contains(s, '{') THEN rtrim(split_part(s, '{', 1)) || ' { ... }' ELSE s END AS signature,
  CASE WHEN contains(s, '{') THEN rtrim(split_part(s, '{', 1)) || ' { ... }' WHEN ends_with(s, ':') THEN s || ' ...' ELSE s || ' { ... }' END AS shown FROM l""")
def skeleton_q21(spark, d):
    first = F.get(text.lines(F.col("text")), F.lit(0))
    rows = t(spark, d, "documents").where("text <> ''").select("doc_id", first.alias("s"))
    return rows.select("doc_id", text.signature(F.col("s")).alias("signature"), text.text_signature(F.col("s")).alias("shown"))


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents), k AS (SELECT doc_id, length(line) - length(replace(line, ' ', '')) + 1 AS n FROM l WHERE line <> '')
SELECT doc_id, count(*) AS functions, CAST(sum(n) // count(*) AS BIGINT) AS avg_length, max(n) AS max_length, CAST(count(*) * (sum(n) // count(*)) AS BIGINT) AS score FROM k GROUP BY doc_id ORDER BY score DESC, string_split(CAST(doc_id AS VARCHAR), '/') LIMIT 20""")
def hotspots_q14(spark, d):
    rows = t(spark, d, "documents").select(F.lit("docs").alias("repo"), F.col("doc_id").cast("string").alias("path"), F.explode(F.split("text", "\n")).alias("line")).where("line <> ''")
    lengths = rows.select("repo", "path", F.size(F.split("line", " ")).cast("long").alias("len"))
    return symbols.hotspots_of(lengths, 20).select(F.col("path").cast("long").alias("doc_id"), "functions", "avg_length", "max_length", "score")


def p5_words(spark, d) -> tuple[DataFrame, DataFrame]:
    """(definitions, calls): a document defines its first word and calls the others, marks at their ends aside."""
    rows = t(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("repo"), F.col("doc_id").cast("string").alias("path"), F.filter(F.split("text", r"\s+"), lambda w: w != "").alias("w")).where(F.size("w") > 0)
    word = lambda c: F.regexp_replace(c, r"[^A-Za-z0-9]+$", "")
    defs = rows.select("repo", "path", word(F.element_at("w", 1)).alias("name"))
    calls = rows.select("repo", "path", F.explode(F.slice("w", 2, 2**30)).alias("c")).select("repo", "path", word(F.col("c")).alias("callee_raw"))
    return defs, calls


_WORDS = r"""WITH r AS (SELECT coalesce(lang, '') AS repo, CAST(doc_id AS VARCHAR) AS path, list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '') AS w FROM documents),
defs AS (SELECT repo, path, regexp_replace(w[1], '[^A-Za-z0-9]+$', '') AS name FROM r WHERE len(w) > 0),
calls AS (SELECT repo, path, regexp_replace(unnest(w[2:]), '[^A-Za-z0-9]+$', '') AS callee FROM r),
keys AS (SELECT repo, path, callee, unnest(list_distinct([callee] || list_transform(range(1, len(string_split(callee, '.')) + 1), lambda i: array_to_string(string_split(callee, '.')[i:], '.')))) AS name FROM calls),
hits AS (SELECT k.repo, k.name, k.path FROM keys k SEMI JOIN defs d ON d.repo = k.repo AND d.name = k.name)
"""


@query(_WORDS + """, h AS (SELECT DISTINCT repo, name, path, 1 AS own FROM defs), u AS (SELECT hits.repo, hits.name, count(own) AS self_refs, count(*) FILTER (own IS NULL) AS cross_refs FROM hits LEFT JOIN h USING (repo, name, path) GROUP BY hits.repo, hits.name),
z AS (SELECT g.repo, g.name, g.definitions, coalesce(u.self_refs, 0) AS self_refs, coalesce(u.cross_refs, 0) AS cross_refs FROM (SELECT repo, name, count(*) AS definitions FROM defs GROUP BY repo, name) g LEFT JOIN u USING (repo, name))
SELECT *, CASE WHEN cross_refs > 0 AND definitions > 1 THEN 'ambiguous' WHEN cross_refs > 0 THEN 'live_cross_file_references' WHEN self_refs > 0 THEN 'self_only_references' ELSE 'no_references' END AS status,
  CASE WHEN cross_refs > 0 AND definitions > 1 THEN NULL ELSE cross_refs = 0 END AS dead FROM z""")
def dead_q12(spark, d):
    defs, calls = p5_words(spark, d)
    return symbols.dead_verdict(defs, symbols.call_counts(calls, defs))


@query(_WORDS + "SELECT repo, name, count(*) AS refs, count(DISTINCT path) AS files FROM hits GROUP BY repo, name")
def refs_q11(spark, d):
    defs, calls = p5_words(spark, d)
    hits = symbols.call_counts(calls, defs)
    return hits.groupBy("repo", "name").agg(F.sum("n").alias("refs"), F.count("*").alias("files"))


@query(_WORDS + """SELECT repo, path, name FROM (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY string_split(path, '/')) AS k FROM defs WHERE name = 'The') WHERE k = 1""")
def show_q19(spark, d):
    defs, _ = p5_words(spark, d)
    span = "named_struct('start_line', 1, 'start_col', 0, 'end_line', 1, 'end_col', 1) AS span"
    rows = defs.selectExpr("repo", "path", "0 AS ord", "name", "'function' AS kind", "true AS exported", span)
    sources = t(spark, d, "documents").select(F.coalesce("lang", F.lit("")).alias("repo"), F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    return symbols.show(rows, sources, "The").where("body is not null").select("repo", "path", "name")


@query(_WORDS + "SELECT DISTINCT name FROM defs WHERE contains(lower(name), 'the') ORDER BY name LIMIT 5")
def suggestions_q19(spark, d):
    return symbols.suggestions(p5_words(spark, d)[0], "The")


# --- scalar functions on literals


@query("""SELECT * FROM (VALUES ('a.b', true), ('b', true), ('x::b', true), ('ab', false), ('p->b', false), ('o:b', false), ('b.c', false)) v(callee, hit)""")
def callee_match_f5(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("a.b", "b", "x::b", "ab", "p->b", "o:b", "b.c")], "callee string")
    return rows.select("callee", text.callee_matches(F.col("callee"), "b").alias("hit"))


@query("""SELECT * FROM (VALUES ('src/a/../../x/./y.ts', 'x/y.ts'), ('../x', '../x'), ('a/../../x', '../x'), ('./a//b', 'a/b'), ('..', '..'), ('a/..', ''), ('../../a/../b', '../../b')) v(path, norm)""")
def path_norm_r16(spark, d):
    rows = spark.createDataFrame([(x,) for x in ("src/a/../../x/./y.ts", "../x", "a/../../x", "./a//b", "..", "a/..", "../../a/../b")], "path string")
    return rows.select("path", paths.normalize(F.col("path")).alias("norm"))


@query("""SELECT * FROM (VALUES ('c,a,b', 'a,b,c'), ('a', 'a'), ('b,c,a', 'a,b,c'), ('a,c,b', 'a,c,b')) v(cycle, rotated)""")
def cycle_rotate_t11(spark, d):
    rows = spark.createDataFrame([("c,a,b",), ("a",), ("b,c,a",), ("a,c,b",)], "cycle string")
    return rows.select("cycle", F.array_join(text.rotate_cycle(F.split("cycle", ",")), ",").alias("rotated"))


@query(r"""SELECT doc_id, replace(replace(s, '\', '\\'), '"', '\"') AS dot, replace(replace(replace(replace(s, '#', '#35;'), '"', '#quot;'), '<', '#lt;'), '>', '#gt;') AS mermaid
FROM (SELECT doc_id, coalesce(text, '') || '"<\#>"' AS s FROM documents)""")
def escape_t7_t8(spark, d):
    s = F.concat(F.coalesce("text", F.lit("")), F.lit('"<\\#>"'))
    return t(spark, d, "documents").select("doc_id", text.dot_escape(s).alias("dot"), text.mermaid_escape(s).alias("mermaid"))


@query("""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS name, regexp_replace(url, '/[^/]*$', '') AS parent, regexp_extract(regexp_extract(url, '([^/]*)$', 1), '^.+[.]([^.]*)$', 1) AS ext,
regexp_replace(regexp_extract(url, '([^/]*)$', 1), '^(.+)[.][^.]*$', '\\1') AS stem FROM pages""")
def path_parts_t9(spark, d):
    u = F.col("url")
    return t(spark, d, "pages").select("page_id", paths.name(u).alias("name"), paths.parent(u).alias("parent"), paths.extension(u).alias("ext"), paths.stem(u).alias("stem"))


@query("""SELECT page_id, row_number() OVER (ORDER BY string_split(url, '/'), page_id) AS nr FROM pages""")
def path_sort_k1(spark, d):
    return t(spark, d, "pages").select("page_id", F.row_number().over(W.orderBy(paths.sort_key(F.col("url")), "page_id")).cast("long").alias("nr"))


@query("""SELECT doc_id, CAST(doc_id AS VARCHAR) || ':' || length(text) || ':' || coalesce(lang, '') || ':' || coalesce(source, '') AS id FROM documents WHERE text IS NOT NULL""")
def definition_id_t6(spark, d):
    rows = t(spark, d, "documents").where("text is not null")
    return rows.select("doc_id", text.definition_id(F.col("doc_id").cast("string"), F.char_length("text"), F.coalesce("lang", F.lit("")), F.coalesce("source", F.lit(""))).alias("id"))
