"""Trees and precedence graphs: paths, inherited context, cascades, fan-out.

A frontier is advanced one step at a time by a join of the reached nodes with the edges, each node being reached once at
its least depth. Steps are bounded by the longest path; reached sets are stored in the session's checkpoint folder every
few steps, so that plans stay short and lost executors cost a reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.operators.scan import scratch

CUT_EVERY = 4  # steps between checkpoints


def _cut(df: DataFrame) -> DataFrame:
    return scratch(df, "graph")


def edges_from_lists(nodes: DataFrame, id_col: str, list_col: str) -> DataFrame:
    """(src, dst) of comma or semicolon separated successors that exist among the nodes."""
    parts = F.filter(F.transform(F.split(F.regexp_replace(list_col, ";", ","), ","), lambda x: F.trim(x)), lambda x: x != "")
    flat = nodes.select(F.col(id_col).alias("src"), F.explode(parts).alias("dst"))
    return flat.join(nodes.select(F.col(id_col).alias("dst")), "dst", "left_semi").select("src", "dst").distinct()


def reached(edges: DataFrame, roots: DataFrame, absorbed: DataFrame | None = None, max_steps: int = 10_000) -> DataFrame:
    """(root, node, depth) of all nodes that edges lead to from each root, at their least depth; the root itself counts
    only where a cycle returns to it. Absorbed nodes are neither reached nor passed. Paths of more than max_steps are an error."""
    if absorbed is not None:
        edges = edges.join(absorbed.select(F.col("node").alias("dst")), "dst", "left_anti")
    edges = _cut(edges.select("src", "dst").distinct())
    front = roots.select(F.col("root"), F.col("root").alias("node"))
    seen, depth = None, 0
    while True:
        depth += 1
        step = front.join(edges, front["node"] == edges["src"]).select("root", F.col("dst").alias("node")).distinct()
        if seen is not None:
            step = step.join(seen.select("root", "node"), ["root", "node"], "left_anti")
        front = _cut(step)
        if front.isEmpty():
            break
        if depth > max_steps:
            raise RuntimeError(f"a path has more than {max_steps} steps")
        new = front.withColumn("depth", F.lit(depth))
        seen = new if seen is None else seen.unionByName(new)
        if depth % CUT_EVERY == 0:
            seen = _cut(seen)
    return seen if seen is not None else front.withColumn("depth", F.lit(0))


def cascade(activities: DataFrame, edges: DataFrame, root, delay_days: int, completed: DataFrame | None = None) -> DataFrame:
    """Activities that a delay of one shifts: depth, planned and shifted finish, whether nothing follows (milestone)."""
    spark = activities.sparkSession
    hit = reached(edges, spark.createDataFrame([(root,)], "root " + dict(activities.dtypes)["activity_id"]), completed)
    leads = edges.select(F.col("src").alias("activity_id")).distinct().withColumn("leads", F.lit(True))
    out = hit.select(F.col("node").alias("activity_id"), "depth").join(activities, "activity_id").join(leads, "activity_id", "left")
    return out.select(
        "activity_id", "depth", "planned_finish", F.date_add("planned_finish", delay_days).alias("shifted_finish"), F.col("leads").isNull().alias("milestone")
    )


def cascade_summary(hit: DataFrame, delay_days: int) -> DataFrame:
    n = F.count("*")
    text = F.format_string("%d %s affected, up to %d days", n, F.when(n == 1, "activity").otherwise("activities"), F.lit(delay_days))
    return hit.agg(n.alias("affected"), F.max("depth").alias("deepest"), F.count_if("milestone").alias("milestones"), text.alias("summary"))


def fan_out(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, fan_out): how many activities each one leads to, directly or not."""
    got = reached(edges, nodes.select(F.col("node").alias("root"))).groupBy("root").agg(F.count("*").alias("fan_out"))
    return nodes.join(got, nodes["node"] == got["root"], "left").select("node", F.coalesce("fan_out", F.lit(0)).alias("fan_out"))


def tree_paths(nodes: DataFrame, separator: str = " > ") -> DataFrame:
    """nodes(node, parent, name) with level (1 at a root) and path. A parent that is missing or the node itself makes a root;
    nodes on a cycle have no root above them and are left out."""
    known = nodes.select(F.col("node").alias("parent"), F.lit(True).alias("known"))
    t = nodes.join(known, "parent", "left")
    root = F.col("known").isNull() | F.col("parent").eqNullSafe(F.col("node"))
    front = _cut(t.where(root).select("node", F.lit(1).alias("level"), F.col("name").alias("path")))
    rest = t.where(~root).select("node", "parent", "name")
    out, depth = front, 1
    while not front.isEmpty():
        depth += 1
        up = front.select(F.col("node").alias("parent"), "path")
        front = _cut(rest.join(up, "parent").select("node", F.lit(depth).alias("level"), F.concat_ws(separator, "path", "name").alias("path")))
        out = out.unionByName(front)
    return out


def inherited(nodes: DataFrame, column: str) -> DataFrame:
    """(node, value): the node's own value of column, else that of its nearest ancestor that has one; null without any."""
    todo = _cut(nodes.select("node", F.col("parent").alias("up"), F.col(column).alias("value")))
    above = nodes.select(F.col("node").alias("up"), F.col("parent").alias("next"), F.col(column).alias("found"))
    done, steps = todo.where("value is not null or up is null or up = node").select("node", "value"), 0
    todo = todo.where("value is null and up is not null and up <> node")
    limit = nodes.count()
    while not todo.isEmpty() and steps <= limit:  # a cycle can't be longer
        steps += 1
        met = _cut(todo.join(above, "up", "left"))
        stop = F.col("found").isNotNull() | F.col("next").isNull() | (F.col("next") == F.col("up"))
        done = done.unionByName(met.where(stop).select("node", F.col("found").alias("value")))
        todo = met.where(~stop).select("node", F.col("next").alias("up"), F.lit(None).cast(dict(nodes.dtypes)[column]).alias("value"))
        if steps % CUT_EVERY == 0:
            todo = _cut(todo)
    return done.unionByName(todo.select("node", "value"))


def outline_parents(rows: DataFrame) -> DataFrame:
    """Outline numbers (1.2.3) with the parent that their prefix names, if it is there."""
    prefix = F.nullif(F.regexp_extract("outline", r"^(.*)\.[^.]+$", 1), F.lit(""))
    there = rows.select(F.col("outline").alias("parent")).distinct()
    return rows.withColumn("prefix", prefix).join(there, F.col("prefix") == F.col("parent"), "left").select("outline", "parent")


def wbs_nodes(codes: DataFrame, separator: str = ".") -> DataFrame:
    """(code, parent, name, level, path, discipline, location, made) of all nodes that dotted codes(code, name, discipline,
    location) name, and of every ancestor that none names.

    A node's discipline and location are its own, else what its nearest ancestor has; path has the names from the root
    down, made says that no row names the node. Ancestors are read off the code itself, so that there is no round for each
    level: a node meets its ancestors by their codes, one join. Of rows that repeat a code the least name counts, and of
    each field the least value. Blank codes are left out.
    """
    c = codes.where(F.trim("code") != "").select(F.trim("code").alias("code"), F.nullif("name", F.lit("")).alias("name"), F.nullif("discipline", F.lit("")).alias("discipline"), F.nullif("location", F.lit("")).alias("location"))
    c = c.groupBy("code").agg(F.min("name").alias("name"), F.min("discipline").alias("discipline"), F.min("location").alias("location"), F.lit(True).alias("named"))
    parts = F.split("code", f"[{separator}]")
    up = c.select(F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), separator))).alias("code")).distinct()
    nodes = _cut(up.join(c, "code", "left"))
    steps = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(parts, F.lit(1), n), separator).alias("of")))
    chain = nodes.select("code", F.explode(steps).alias("s")).select("code", "s.depth", "s.of")
    met = chain.join(nodes.select(F.col("code").alias("of"), "name", "discipline", "location"), "of")
    last = lambda v: F.max_by(v, F.when(F.col(v).isNotNull(), F.col("depth")))
    got = met.groupBy("code").agg(
        F.max("depth").alias("level"), F.array_sort(F.collect_list(F.struct("depth", F.coalesce("name", "of").alias("n")))).alias("names"),
        last("discipline").alias("discipline"), last("location").alias("location"), F.max(F.when(F.col("of") == F.col("code"), F.col("name"))).alias("name"),
    )
    got = got.join(nodes.select("code", "named"), "code")
    parent = F.nullif(F.regexp_extract("code", f"^(.*)[{separator}][^{separator}]*$", 1), F.lit(""))
    return got.select("code", parent.alias("parent"), F.coalesce("name", "code").alias("name"), "level", F.array_join(F.col("names.n"), " > ").alias("path"), "discipline", "location", F.col("named").isNull().alias("made"))
