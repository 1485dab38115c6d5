"""Iterative graph operators: connected components and parent-child hierarchies.

Both keep their state in narrow tables of ids, shrink the working set every round, write each round to the shared folder, and
need a number of rounds that grows with the logarithm of the longest chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from threadloom.workspace import Workspace


def connected_components(edges: DataFrame, left: str = "src", right: str = "dst", max_rounds: int = 100) -> DataFrame:
    """``node, label`` for every end of an edge; ``label`` is the smallest node of its component.

    Each round propagates minimum labels across the edges (every node takes the smallest neighbour below itself), follows those
    labels by pointer jumping until none changes, and contracts the edges to the labels. Edges that fall inside a label
    disappear, so later rounds are small. All neighbours of a hot node meet in an aggregate with a map-side combine, never in one
    group.

    Nulls at either end: the edge links nothing and is ignored. A self edge makes its node a component of its own. Repeated and
    turned-round edges count once. Empty input gives an empty result. Any orderable id type works.
    """
    spark = edges.sparkSession
    work = Workspace(spark, "components")
    given = edges.select(F.col(left).alias("src"), F.col(right).alias("dst")).where("src is not null and dst is not null")
    given = given.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct()
    current = work.save(given)
    first, maps = current, []
    for _ in range(max_rounds):
        live = current.where("src > dst")
        # dst < src always, so a node hooks to its smallest neighbour exactly when it stands on the src side.
        hooks, seen = work.save_and_count(live.groupBy("src").agg(F.min("dst").alias("label")).withColumnRenamed("src", "node"), some=F.lit(True))
        if not seen["some"]:
            break
        flat = _jumped(work, hooks)
        a, b = flat.select(F.col("node").alias("src"), F.col("label").alias("_ls")), flat.select(F.col("node").alias("dst"), F.col("label").alias("_ld"))
        moved = live.join(a, "src", "left").join(b, "dst", "left").select(F.coalesce("_ls", "src").alias("x"), F.coalesce("_ld", "dst").alias("y"))
        after = work.save(moved.where("x <> y").select(F.greatest("x", "y").alias("src"), F.least("x", "y").alias("dst")).distinct())
        maps.append(flat)
        if current is not first:
            work.drop(current)
        current = after
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    final: DataFrame | None = None
    for flat in reversed(maps):
        if final is None:
            final = flat
        else:
            up = final.select(F.col("node").alias("label"), F.col("label").alias("_up"))
            final = flat.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label")).unionByName(final)
            final = work.save(final)
    # A node in the maps never labels itself; the smallest nodes and self edges come from the first edges.
    roots = first.select(F.col("dst").alias("node")).distinct()
    if final is None:
        return roots.select("node", F.col("node").alias("label"))
    alone = roots.join(final.select("node"), "node", "left_anti")
    return work.save(final.unionByName(alone.select("node", F.col("node").alias("label"))))


def _jumped(work: Workspace, hooks: DataFrame) -> DataFrame:
    """Follows ``node -> label`` until every label is a node that has none: pointer jumping, distances double each round.

    Only labels that moved in the last round can move again, so the pointers at rest leave the working set.
    """
    done: list[DataFrame] = []
    moving = hooks
    while True:
        up = moving.select(F.col("node").alias("label"), F.col("label").alias("_up"))
        if done:
            # A pointer at rest ends at a root, which is not a node of the table; one that ends at a node at rest moves once more.
            for x in done:
                up = up.unionByName(x.select(F.col("node").alias("label"), F.col("label").alias("_up")))
        step = moving.join(up, "label", "left").select("node", F.coalesce("_up", "label").alias("label"), F.col("_up").isNotNull().alias("_moved"))
        step, seen = work.save_and_count(step, moved=F.col("_moved"))
        rest = step.where("not _moved").select("node", "label")
        still = step.where("_moved").select("node", "label")
        done.append(rest)
        if not seen["moved"]:
            break
        moving = still
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out


def hierarchy(df: DataFrame, node: Column, parent: Column, with_path: bool = False) -> DataFrame:
    """The forest that parent links form: one row per node, ``node, parent, root, depth, in_cycle`` and, if asked, ``path``.

    ``node`` must be unique and not null, and both must be of one orderable type. A node whose parent is null or absent is a root:
    depth 0, its own root. ``in_cycle`` 1: going up never ends; ``root`` is then the smallest node on the cycle and ``depth`` the
    steps up to the cycle, 0 on it. ``path`` runs from the topmost node (or the node of the cycle that is reached first) to the
    node itself. A self link is a cycle of one. Empty input gives an empty result.

    Frontier joins by level, with levels that double: after round k every unresolved node holds its ancestor 2**k steps up, so
    a chain of any length d takes log2(d) rounds. Nodes resolved in a round are written out; only those some unresolved node
    still points at stay in the working set. A round that resolves nothing leaves exactly the nodes that never reach a root.
    Many children of one parent are skew on the probe side only, which adaptive execution splits.
    """
    work = Workspace(df.sparkSession, "hierarchy")
    rows = work.save(df.select(node.alias("node"), parent.alias("parent")))
    present = rows.select(F.col("node").alias("parent"), F.lit(True).alias("_present"))
    links = work.save(rows.where("parent is not null").join(present, "parent", "inner").select("node", "parent"))
    trees, stuck = _climb(work, links, with_path)
    parts = list(trees)
    if stuck is not None:
        parts += _cycles(work, stuck, with_path)
    empty = rows.select("node", F.col("node").alias("root"), F.lit(0).alias("depth"), F.lit(0).alias("in_cycle"), *([F.array("node").alias("path")] if with_path else []))
    linked = links.select("node")
    out = empty.join(linked, "node", "left_anti")
    for x in parts:
        out = out.unionByName(x)
    return out.join(rows, "node", "inner").select("node", "parent", "root", "depth", "in_cycle", *(["path"] if with_path else []))


def _climb(work: Workspace, links: DataFrame, with_path: bool) -> tuple[list[DataFrame], DataFrame | None]:
    """Resolved parts, and the links of the nodes that never reach a node without a link (None if there are none).

    ``up`` is the ancestor reached so far, ``dist`` the steps to it, ``trail`` the nodes passed, the node itself last.
    """
    trail = [F.array("node").alias("trail")] if with_path else []
    state = links.select("node", F.col("parent").alias("up"), F.lit(1).alias("dist"), F.lit(False).alias("done"), *trail)
    parts: list[DataFrame] = []
    previous: DataFrame | None = None
    while True:
        other = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("dist").alias("_dist"), F.col("done").alias("_done"), *([F.col("trail").alias("_trail")] if with_path else []))
        step = (
            state.where("not done")
            .join(other, "up", "left")
            .select(
                "node",
                F.coalesce("_up", "up").alias("up"),
                (F.col("dist") + F.coalesce("_dist", F.lit(0))).alias("dist"),
                F.coalesce("_done", F.lit(True)).alias("done"),
                *([F.when(F.col("_trail").isNull(), F.col("trail")).otherwise(F.concat("_trail", "trail")).alias("trail")] if with_path else []),
            )
        )
        step, seen = work.save_and_count(step, left=~F.col("done"), newly=F.col("done"))
        resolved = step.where("done")
        parts.append(resolved.select("node", F.col("up").alias("root"), F.col("dist").alias("depth"), F.lit(0).alias("in_cycle"), *([F.concat(F.array("up"), "trail").alias("path")] if with_path else [])))
        if not seen["left"]:
            return parts, None
        if not seen["newly"]:
            parts.pop()
            stuck = step.select("node").join(links, "node", "inner")
            return parts, work.save(stuck)
        still = step.where("not done")
        needed = still.select(F.col("up").alias("node")).distinct()
        kept = resolved if previous is None else resolved.unionByName(previous)
        kept = work.save(kept.join(needed, "node", "left_semi"))
        previous = kept
        state = still.unionByName(kept)


def _cycles(work: Workspace, links: DataFrame, with_path: bool) -> list[DataFrame]:
    """Rows for nodes whose way up ends in a cycle. Every parent in ``links`` is a node of ``links``.

    The images of all nodes under 2**k steps shrink until they are the nodes on the cycles; the minimum over the steps taken
    then settles as the smallest node of each cycle. Tails climb to the cycle as trees climb to their roots.
    """
    state = links.select("node", F.col("parent").alias("up"), F.least("node", "parent").alias("low"))
    size = None
    while True:
        reached = state.select(F.col("up").alias("node")).distinct()
        now = reached.count()
        if now == size:
            break
        size = now
        state = work.save(_doubled(state))
    ring = work.save(state.join(reached, "node", "left_semi"))
    while True:
        after, seen = work.save_and_count(_doubled(ring, keep=True), changed=F.col("low") != F.col("_low"))
        ring = after.drop("_low")
        if not seen["changed"]:
            break
    on = ring.select("node", F.col("low").alias("root"))
    parts = [on.select("node", "root", F.lit(0).alias("depth"), F.lit(1).alias("in_cycle"), *([F.array("node").alias("path")] if with_path else []))]
    tails, seen = work.save_and_count(links.join(on.select("node"), "node", "left_anti"), some=F.lit(True))
    if seen["some"]:
        climbed, _ = _climb(work, tails, with_path)
        low = on.select(F.col("node").alias("root"), F.col("root").alias("_low"))
        for x in climbed:
            parts.append(x.join(low, "root").select("node", F.col("_low").alias("root"), "depth", F.lit(1).alias("in_cycle"), *(["path"] if with_path else [])))
    return parts


def _doubled(state: DataFrame, keep: bool = False) -> DataFrame:
    other = state.select(F.col("node").alias("up"), F.col("up").alias("_up"), F.col("low").alias("_l"))
    return state.join(other, "up").select("node", F.col("_up").alias("up"), F.least("low", "_l").alias("low"), *([F.col("low").alias("_low")] if keep else []))


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """``ancestor, descendant, distance`` from a hierarchy with paths: every pair above one another within a tree.

    One explode of each path, no join. A tree that hangs below a cycle counts, with the node of the cycle that bears it as its root; nodes of
    one cycle are above one another without end and give no pairs among themselves.
    """
    rows = tree.where("depth > 0").select("node", "depth", F.posexplode("path").alias("_pos", "ancestor"))
    return rows.where("_pos < depth").select("ancestor", F.col("node").alias("descendant"), (F.col("depth") - F.col("_pos")).alias("distance"))
