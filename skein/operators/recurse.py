"""Recursion over edges: closures, depths, shortest paths and strongly connected components.

Frontier loops keep one row per (repo, source, node), expand only new rows, and cut lineage with a written table a
round. The number of rounds is the depth of the answer; `closure_doubling` needs its logarithm.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: str | None = None


def _folder(spark: SparkSession) -> str:
    """The folder that all executors share; a temporary one only where the session names none and the master is local."""
    global _own
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if _own is None:
        _own = tempfile.mkdtemp(prefix="skein-rounds-")
    return _own


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written and read back."""
    path = f"{_folder(df.sparkSession)}/rounds/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def reach_with_depth(edges: DataFrame, sources: DataFrame, max_depth: int | None = None, reverse: bool = False) -> DataFrame:
    """sources: (repo, source). Gives (repo, source, path, depth): fewest hops from each source, which itself isn't returned.

    reverse=True follows edges backwards (dependents). A source is seen from the start, so cycles don't bring it back.
    """
    ends = ("dst", "src") if reverse else ("src", "dst")
    steps = cut(edges.select("repo", F.col(ends[0]).alias("at"), F.col(ends[1]).alias("path")).distinct())
    frontier = cut(sources.select("repo", "source", F.col("source").alias("path")).distinct())
    seen = frontier.withColumn("depth", F.lit(0))
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        nxt = frontier.withColumnRenamed("path", "at").join(steps, ["repo", "at"]).select("repo", "source", "path").distinct()
        frontier = cut(nxt.join(seen.select("repo", "source", "path"), ["repo", "source", "path"], "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier.withColumn("depth", F.lit(depth)))
        if depth % 8 == 0:
            seen = cut(seen)
    return seen.where("depth > 0")


def one_source(df: DataFrame, path: str) -> DataFrame:
    """(repo, source) of a path in every repository that has it as a node or an edge's end."""
    cols = [c for c in ("path", "src", "dst") if c in df.columns]
    found = df.select("repo", F.explode(F.array(*cols)).alias("source")).where(F.col("source") == path)
    return found.distinct()


def transitive_deps(edges: DataFrame, path: str, max_depth: int | None = None) -> DataFrame:
    return reach_with_depth(edges, one_source(edges, path), max_depth).select("repo", "path")


def transitive_dependents(edges: DataFrame, path: str) -> DataFrame:
    return reach_with_depth(edges, one_source(edges, path), reverse=True).select("repo", "path")


def dependents_with_depth(edges: DataFrame, path: str, max_depth: int | None = None) -> DataFrame:
    return reach_with_depth(edges, one_source(edges, path), max_depth, reverse=True).select("repo", "path", "depth")


def impact_with_depth(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Several sources at once: the fewest hops from any of them. A source can be a dependent of another one."""
    return reach_with_depth(edges, sources, max_depth, reverse=True).groupBy("repo", "path").agg(F.min("depth").alias("depth"))


def closure_doubling(edges: DataFrame) -> DataFrame:
    """All (repo, src, dst) with a path from src to dst, by squaring: as many rounds as the depth has binary digits."""
    reach = cut(edges.select("repo", "src", "dst").distinct())
    size = reach.count()
    while True:
        left, right = reach.withColumnRenamed("dst", "mid"), reach.withColumnRenamed("src", "mid")
        reach = cut(reach.unionByName(left.join(right, ["repo", "mid"]).select("repo", "src", "dst")).distinct())
        new = reach.count()
        if new == size:
            return reach
        size = new


#: Levels up to which reverse reachability is one SQL statement: level n holds those before it, so the plan has n * (n + 1) / 2 joins.
SQL_LEVELS = 6


def bounded_closure_sql(spark: SparkSession, edges: DataFrame, path: str, max_depth: int) -> DataFrame:
    """Reverse reachability of small known depth as one query, a common table for each level; deeper ones take the loop.

    Not WITH RECURSIVE: that can't be distinct in Spark, so it counts every route, and it ends at a million rows.
    """
    if not 0 < max_depth <= SQL_LEVELS:
        return dependents_with_depth(edges, path, max_depth)
    view = f"edges_{uuid.uuid4().hex}"
    edges.createOrReplaceTempView(view)
    levels = [f"up1 AS (SELECT DISTINCT repo, src AS path FROM {view} WHERE dst = :start)"]
    for n in range(2, max_depth + 1):
        levels.append(f"up{n} AS (SELECT DISTINCT e.repo, e.src AS path FROM {view} e JOIN up{n - 1} u ON e.repo = u.repo AND e.dst = u.path)")
    every = " UNION ALL ".join(f"SELECT repo, path, {n} AS depth FROM up{n}" for n in range(1, max_depth + 1))
    found = spark.sql(f"WITH {', '.join(levels)} SELECT repo, path, min(depth) AS depth FROM ({every}) WHERE path <> :start GROUP BY repo, path", args={"start": path})
    spark.catalog.dropTempView(view)  # the plan has it by now
    return found


def shortest_path(edges: DataFrame, start: str, end: str) -> DataFrame:
    """(repo, route): a path of fewest edges, the lexicographically least of them; from == to is one node; none: no row.

    Each round keeps one route per node, the least of those that reach it first, and a prefix of a least shortest path
    is one itself.
    """
    steps = cut(edges.select("repo", "src", "dst").where("src <> dst").distinct())
    at = one_source(edges, start).select("repo", F.col("source").alias("path"), F.array("source").alias("route"))
    frontier = cut(at)
    seen = frontier.select("repo", "path")
    done = frontier.where(F.col("path") == end)
    while not frontier.isEmpty():
        rest = frontier.join(done.select("repo").distinct(), "repo", "left_anti")
        nxt = rest.join(steps, (rest.repo == steps.repo) & (rest.path == steps.src)).select(rest.repo, steps.dst.alias("path"), F.concat("route", F.array("dst")).alias("route"))
        nxt = nxt.join(seen, ["repo", "path"], "left_anti").groupBy("repo", "path").agg(F.min("route").alias("route"))
        frontier = cut(nxt)
        seen = cut(seen.unionByName(frontier.select("repo", "path")))
        done = cut(done.unionByName(frontier.where(F.col("path") == end)))
    return done.select("repo", "route")


# --- strongly connected components


def _tarjan(pairs: list[tuple[str, str]]) -> dict[str, str]:
    """node -> least member of its component, without recursion."""
    after: dict[str, list[str]] = {}
    for a, b in pairs:
        after.setdefault(a, []).append(b)
        after.setdefault(b, [])
    index: dict[str, int] = {}
    low: dict[str, int] = {}
    stack: list[str] = []
    on: set[str] = set()
    out: dict[str, str] = {}
    for root in after:
        if root in index:
            continue
        index[root] = low[root] = len(index)
        stack.append(root)
        on.add(root)
        work = [(root, iter(after[root]))]
        while work:
            node, rest = work[-1]
            for nxt in rest:
                if nxt not in index:
                    index[nxt] = low[nxt] = len(index)
                    stack.append(nxt)
                    on.add(nxt)
                    work.append((nxt, iter(after[nxt])))
                    break
                if nxt in on:
                    low[node] = min(low[node], index[nxt])
            else:
                work.pop()
                if work:
                    low[work[-1][0]] = min(low[work[-1][0]], low[node])
                if low[node] == index[node]:
                    members = []
                    while True:
                        m = stack.pop()
                        on.discard(m)
                        members.append(m)
                        if m == node:
                            break
                    least = min(members)
                    out.update(dict.fromkeys(members, least))
    return out


def scc_by_repo(edges: DataFrame) -> DataFrame:
    """(repo, path, scc_id): one task per repository, for many repositories of ordinary size. scc_id: the least member."""

    def run(pdf):
        import pandas as pd

        found = _tarjan(list(zip(pdf["src"], pdf["dst"], strict=True)))
        return pd.DataFrame({"repo": [pdf["repo"].iloc[0]] * len(found), "path": list(found), "scc_id": list(found.values())})

    return edges.select("repo", "src", "dst").distinct().groupBy("repo").applyInPandas(run, "repo string, path string, scc_id string")


def scc_distributed(edges: DataFrame) -> DataFrame:
    """The same for repositories too large for one task: trim nodes outside any cycle, colour the rest with the least label
    that reaches them, take backward what has its root's colour, repeat on what is left."""
    nodes = cut(edges.select("repo", F.explode(F.array("src", "dst")).alias("path")).distinct())
    left = cut(edges.select("repo", "src", "dst").where("src <> dst").distinct())
    done = None
    while True:
        while True:  # only nodes with edges in and out can be on a cycle
            ins, outs = left.select("repo", F.col("dst").alias("src")).distinct(), left.select("repo", F.col("src").alias("dst")).distinct()
            kept = cut(left.join(ins, ["repo", "src"], "left_semi").join(outs, ["repo", "dst"], "left_semi"))
            before, after = left.count(), kept.count()
            left = kept
            if before == after:
                break
        if not after:
            break
        colour = cut(left.select("repo", F.explode(F.array("src", "dst")).alias("path")).distinct().withColumn("colour", F.col("path")))
        while True:
            seen = left.join(colour.select("repo", F.col("path").alias("src"), F.col("colour").alias("c")), ["repo", "src"]).groupBy("repo", F.col("dst").alias("path")).agg(F.min("c").alias("c"))
            new = cut(colour.join(seen, ["repo", "path"], "left").select("repo", "path", F.least("colour", F.coalesce("c", "colour")).alias("colour"), F.col("colour").alias("old")))
            same = new.where("colour <> old").isEmpty()
            colour = new.drop("old")
            if same:
                break
        inside = left.join(colour.select("repo", F.col("path").alias("src"), F.col("colour").alias("a")), ["repo", "src"]).join(colour.select("repo", F.col("path").alias("dst"), F.col("colour").alias("b")), ["repo", "dst"]).where("a = b")
        roots = colour.where("path = colour").select("repo", F.col("path").alias("source"))
        back = reach_with_depth(inside.select("repo", "src", "dst"), roots, reverse=True)
        found = cut(back.select("repo", "path", F.col("source").alias("scc_id")).unionByName(roots.select("repo", F.col("source").alias("path"), F.col("source").alias("scc_id"))))
        done = found if done is None else done.unionByName(found)
        gone = found.select("repo", F.col("path").alias("src"))
        left = cut(left.join(gone, ["repo", "src"], "left_anti").join(gone.withColumnRenamed("src", "dst"), ["repo", "dst"], "left_anti"))
    if done is None:
        return nodes.withColumn("scc_id", F.col("path"))
    return nodes.join(done, ["repo", "path"], "left").select("repo", "path", F.coalesce("scc_id", "path").alias("scc_id"))


#: Repositories with more distinct edges than this take the distributed form: about a gigabyte in one task.
TASK_EDGES = 2_000_000


def components(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """(repo, path, scc_id) of all nodes with edges: by repository where one fits a task, distributed beyond that."""
    sizes = cut(edges.groupBy("repo").agg(F.count("*").alias("n")))
    large = sizes.where(F.col("n") > task_edges).select("repo")
    small = scc_by_repo(edges.join(large, "repo", "left_anti"))
    return small if large.isEmpty() else small.unionByName(scc_distributed(edges.join(large, "repo", "left_semi")))


def cyclic(scc: DataFrame, edges: DataFrame) -> DataFrame:
    """(repo, path, scc_id, scc_size, cyclic): cyclic if the component has several members or its node a self loop."""
    sizes = scc.groupBy("repo", "scc_id").agg(F.count("*").alias("scc_size"))
    loops = edges.where("src = dst").select("repo", F.col("src").alias("path"), F.lit(True).alias("loop")).distinct()
    out = scc.join(sizes, ["repo", "scc_id"]).join(loops, ["repo", "path"], "left")
    return out.select("repo", "path", "scc_id", "scc_size", ((F.col("scc_size") > 1) | F.coalesce("loop", F.lit(False))).alias("cyclic"))


def cycle_edges(edges: DataFrame, scc: DataFrame) -> DataFrame:
    """Edges inside a cyclic component. scc: from cyclic()."""
    on = scc.where("cyclic").select("repo", "path", "scc_id")
    a, b = on.withColumnsRenamed({"path": "src", "scc_id": "a"}), on.withColumnsRenamed({"path": "dst", "scc_id": "b"})
    return edges.join(a, ["repo", "src"]).join(b, ["repo", "dst"]).where("a = b").select("repo", "src", "dst", "kind")


def cycles(scc: DataFrame) -> DataFrame:
    """(repo, scc_id, size, members): one row per cycle, members in order."""
    return scc.where("cyclic").groupBy("repo", "scc_id").agg(F.max("scc_size").alias("size"), F.array_sort(F.collect_list("path")).alias("members"))


def largest_cycle(scc: DataFrame) -> DataFrame:
    """Per repository the cycle with most members, of equal ones that with the least first member."""
    rank = F.struct(F.col("scc_size").alias("n"))
    top = scc.where("cyclic").groupBy("repo").agg(F.max(rank)["n"].alias("scc_size"))
    least = scc.where("cyclic").join(top, ["repo", "scc_size"]).groupBy("repo").agg(F.min("scc_id").alias("scc_id"))
    return cycles(scc.join(least, ["repo", "scc_id"], "left_semi"))
