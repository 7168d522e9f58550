"""Process forests: descendants of seeds, topmost ancestors, bounded ancestor walks.

Every loop continues from a written table, so plans stay short and a lost executor costs one round at most.
Keys carry the run, so forests of all runs are walked together.
"""

from functools import reduce

from pyspark.sql import functions as F

from hosttrace.functions.text import last_part
from hosttrace.session import materialize


def descendants(edges, seeds, child="child", parent="parent"):
    """Seeds and everything below them. ``edges`` may give a child several parents; cycles end the walk.

    "A seed is above me" doubles along children of one parent, so a chain of n takes log2(n) rounds of joins over the
    rows still open. Children of several parents stop the walk: they are joined to the tops of their parents, and only
    this condensed graph, which forests do not have, is walked level by level.
    """
    edges = materialize(edges.select(F.col(child).alias("node"), F.col(parent).alias("up"))
                        .where("node IS NOT NULL AND up IS NOT NULL").distinct(), "edges")
    seeds = materialize(seeds.select(F.col(seeds.columns[0]).alias("node")).where("node IS NOT NULL").distinct(), "seeds")
    parents = edges.join(seeds, "node", "left_anti").groupBy("node").agg(F.count(F.lit(1)).alias("n"), F.min("up").alias("up"))
    start = seeds.select("node", F.lit(None).cast(edges.schema["up"].dataType).alias("up"), F.lit(True).alias("hit")).unionByName(
        parents.select("node", F.when(F.col("n") == 1, F.col("up")).alias("up"), F.lit(False).alias("hit")))
    # A row is closed when it is hit, ends at an unlogged parent (top NULL), or below a child of several parents (top).
    start = materialize(start.withColumn("top", F.when(F.col("up").isNull() & ~F.col("hit"), F.col("node"))), "below")
    done, live = [start.where("up IS NULL")], start.where("up IS NOT NULL")
    reach, n = 1, live.count()
    most = n
    while n and reach <= most:  # beyond, what is open lies on a cycle or leads into one, without a seed
        every = reduce(lambda x, y: x.unionByName(y), [*done, live])
        above = every.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("hit").alias("_hit"), F.col("top").alias("_top"))
        step = materialize(live.drop("hit", "top").join(above, "up", "left").select(
            "node", F.col("_up").alias("up"), F.coalesce("_hit", F.lit(False)).alias("hit"), F.col("_top").alias("top")), "below")
        done = _folded([*done, step.where("up IS NULL")])
        live, reach, n = step.where("up IS NOT NULL"), reach * 2, step.where("up IS NOT NULL").count()
    closed = reduce(lambda x, y: x.unionByName(y), done)
    several = parents.where("n > 1").select("node")
    if several.isEmpty():
        return closed.where("hit").select("node")
    above = edges.join(several, "node", "left_semi").join(
        closed.select(F.col("node").alias("up"), "hit", "top"), "up").where("hit OR top IS NOT NULL")
    links = materialize(above.select("node", "hit", "top").distinct(), "condensed")
    frontier = materialize(links.where("hit").select("node").distinct(), "frontier")
    reached = [frontier]
    while not frontier.isEmpty():  # every round adds nodes or is the last
        step = links.join(frontier.withColumnRenamed("node", "top"), "top", "left_semi").select("node").distinct()
        for known in reached:
            step = step.join(known, "node", "left_anti")
        frontier = materialize(step, "frontier")
        reached = _folded([*reached, frontier])
    tops = reduce(lambda x, y: x.unionAll(y), reached).withColumnRenamed("node", "top")
    return closed.where("hit").select("node").unionAll(closed.where("NOT hit").join(tops, "top", "left_semi").select("node"))


def _folded(tables, limit=6):
    """Keep the tables of a round few: many small rounds merge into one written table."""
    if len(tables) < limit:
        return tables
    return [materialize(reduce(lambda a, b: a.unionAll(b), tables), "reached")]


def left_join_on(df, other, key):
    """Left join on one key in which rows without it pass by: they would all meet in one task of the shuffle."""
    found = df.where(F.col(key).isNotNull()).join(other, key, "left")
    return found.unionByName(df.where(F.col(key).isNull()), allowMissingColumns=True)


def _jump(nodes, every):
    """One doubling of open (node, up, root, dist) rows; where ``up`` becomes NULL the walk has ended."""
    above = every.select(F.col("node").alias("up"), F.col("up").alias("_up2"), F.col("root").alias("_root2"),
                         F.col("dist").alias("_dist2"))
    joined = nodes.join(above, "up", "left")
    return joined.select("node", F.col("_up2").alias("up"), F.coalesce("_root2", "root").alias("root"),
                         (F.col("dist") + F.coalesce("_dist2", F.lit(0))).alias("dist"))


def _climb(nodes):
    """Double until every open node lies on, or leads into, a cycle. Returns (table, any open left)."""
    done, live, before = [nodes.where("up IS NULL")], nodes.where("up IS NOT NULL"), None
    while True:
        every = reduce(lambda a, b: a.unionByName(b), [*done, live])
        n = live.count()
        if n == 0 or n == before:
            return every, n > 0
        # Only open nodes are joined and written again; a round adds the table of those it ends.
        before, step = n, materialize(_jump(live, every), "climb")
        done.append(step.where("up IS NULL"))
        live = step.where("up IS NOT NULL")


def topmost(processes, node="node", parent="parent"):
    """Topmost observed ancestor and its distance for every node, in log2(depth) joins.

    A node on a cycle is its own top; a node that leads into a cycle ends where it enters it.
    """
    p = processes.select(F.col(node).alias("node"), F.col(parent).alias("up")).where("node IS NOT NULL")
    known = p.select(F.col("node").alias("up"), F.lit(True).alias("_known"))
    start = materialize(
        left_join_on(p, known, "up").select("node", F.when(F.col("_known"), F.col("up")).alias("up"))
        .withColumns({"root": F.coalesce("up", "node"), "dist": F.when(F.col("up").isNotNull(), 1).otherwise(0)}),
        "forest")
    climbed, cyclic = _climb(start)
    if cyclic:
        # A jump maps the open nodes onto fewer and fewer nodes until exactly the cycle members remain.
        rest, size = climbed.where("up IS NOT NULL"), None
        while True:
            members = rest.select("up").distinct()
            n = members.count()
            if n == size:
                break
            size, rest = n, materialize(_jump(rest, rest), "climb")
        on_cycle = members.select(F.col("up").alias("node"), F.lit(True).alias("_cycle"))
        cut = start.join(on_cycle, "node", "left").select(
            "node", F.when(F.col("_cycle").isNull(), F.col("up")).alias("up"),
            F.when(F.col("_cycle"), F.col("node")).otherwise(F.col("root")).alias("root"),
            F.when(F.col("_cycle"), 0).otherwise(F.col("dist")).alias("dist"))
        climbed, _ = _climb(materialize(cut, "forest"))
    return climbed.select(F.col("node").alias(node), "root", "dist")


def ancestor_paths(processes, length, node="node", parent="parent", value="value"):
    """For every node the list of (node, value) from itself upwards, at most ``length`` long, cut before a repeat.

    Paths double per join, so 16 ancestors take 4 joins. Paths are bounded by ``length``, whatever the tree.
    """
    paths = processes.select(
        F.col(node).alias("node"), F.col(parent).alias("up"),
        F.array(F.struct(F.col(node).alias("node"), F.col(value).alias("value"))).alias("path")
    ).where("node IS NOT NULL")
    have = 1
    while have < length:
        above = paths.select(F.col("node").alias("up"), F.col("up").alias("_up2"), F.col("path").alias("_path2"))
        paths = materialize(left_join_on(paths, above, "up").select(
            "node", F.col("_up2").alias("up"),
            F.slice(F.concat("path", F.coalesce("_path2", F.array().cast(paths.schema["path"].dataType))), 1,
                    length).alias("path")), "paths")
        have *= 2

    def extend(seen, step):
        stop = seen["done"] | F.exists(seen["path"], lambda x: x["node"] == step["node"])
        return F.struct(F.when(stop, seen["path"]).otherwise(F.array_append(seen["path"], step)).alias("path"),
                        stop.alias("done"))

    empty = F.struct(F.slice("path", 1, 0).alias("path"), F.lit(False).alias("done"))
    return paths.select(F.col("node").alias(node), F.aggregate("path", empty, extend)["path"].alias("path"))


def chain_text(processes, length=12, node="node", parent="parent", image="Image"):
    """Ancestor images as `child < parent < grandparent`."""
    p = processes.withColumn("_img", F.when(F.coalesce(last_part(F.col(image)), F.lit("")) != "",
                                            last_part(F.col(image))).otherwise("?"))
    paths = ancestor_paths(p, length, node, parent, "_img")
    return paths.select(node, F.array_join(F.transform("path", lambda s: s["value"]), " < ").alias("lineage_chain"))


def depth_and_root_image(processes, cap=20, node="node", parent="parent", image="Image"):
    """Levels up to the end of the walk and the image found there.

    A named parent that was never logged counts one level, and the last logged process keeps its own image as root.
    The walk stops after ``cap`` levels and before it meets a process twice.
    """
    p = processes.select(F.col(node).alias("node"), F.col(parent).alias("parent"), F.col(image).alias("image"))
    paths = ancestor_paths(p.withColumn("v", F.struct("parent", "image")), cap + 1, "node", "parent", "v")
    # An empty image at the top falls back to the nearest non-empty one below it.
    images = F.filter(F.transform("path", lambda s: s["value"]["image"]), lambda i: F.coalesce(i, F.lit("")) != "")
    steps = F.size("path") - 1
    top_parent = F.element_at("path", -1)["value"]["parent"]
    seen = F.exists("path", lambda s: s["node"] == top_parent)
    unlogged = top_parent.isNotNull() & ~F.coalesce(seen, F.lit(False)) & (steps < cap)
    return paths.select(
        F.col("node").alias(node), (steps + F.when(unlogged, 1).otherwise(0)).alias("ancestor_depth"),
        F.coalesce(F.try_element_at(images, F.lit(-1)), F.lit("")).alias("root_image"))


def parent_status(processes, node="node", parent="parent"):
    """observed / parent_not_logged / no_parent_info per process."""
    known = processes.select(F.col(node).alias(parent), F.lit(True).alias("_known")).distinct()
    return left_join_on(processes, known, parent).withColumn(
        "parent_status", F.when(F.col(parent).isNull(), "no_parent_info")
        .when(F.col("_known"), "observed").otherwise("parent_not_logged")).drop("_known")


def lineage_status(created, roots, shells, node="node", parent="parent", parent_image="ParentImage", cap=60):
    """Three-valued origin of every created process: 1 below a root, 0 visibly elsewhere, -1 unknown.

    Unknown means that the visible chain is deeper than ``cap``, or leaves the log through a script host or through
    an unnamed parent.
    """
    below = descendants(created, roots, node, parent).select(F.col("node").alias(node), F.lit(True).alias("_below"))
    top = topmost(created, node, parent)
    through = created.select(F.col(node).alias("root"), F.lower(F.coalesce(parent_image, F.lit(""))).alias("_pi"))
    shell = reduce(lambda a, b: a | b, [F.col("_pi").endswith(s) for s in shells])
    status = (F.when(F.col("_below"), 1).when(F.col("dist") > cap, -1)
              .when(shell | (F.col("_pi") == ""), -1).otherwise(0))
    walked = top.join(through, "root", "left").join(below, node, "full_outer")
    return walked.select(node, status.alias("status"))
