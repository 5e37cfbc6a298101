"""Trees and graphs: flattening with inheritance, reachability, components, counts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import Scratch


def flatten_tree(nodes: DataFrame, inherited: list[str]) -> DataFrame:
    """Pre-order leaves and inner nodes with inherited attributes.

    nodes: (doc_id, node, parent, ord, ...inherited). A node's own value goes first,
    else the nearest ancestor's. path sorts in pre-order. A level a job: each joins
    children to the nodes of the last one until there are none, so a cycle, which no
    root reaches where nodes have one parent, is left out. A tree that is deeper than it
    has rows has a cycle below a root and is an error.
    """
    scratch = Scratch(nodes.sparkSession, "tree")
    top = nodes.where("parent is null")
    level = top.select("doc_id", "node", "parent", *inherited, F.lit(0).alias("depth"), F.array(F.col("ord").cast("long")).alias("path"))
    reached = level = scratch.save(level, "level-0")
    for depth in range(1, nodes.count() + 1):
        up = level.select("doc_id", F.col("node").alias("parent"), *[F.col(c).alias(f"up_{c}") for c in inherited], F.col("path").alias("up_path"))
        level = nodes.join(up, ["doc_id", "parent"]).select("doc_id", "node", "parent", *[F.coalesce(c, f"up_{c}").alias(c) for c in inherited], F.lit(depth).alias("depth"), F.concat("up_path", F.array(F.col("ord").cast("long"))).alias("path"))
        level = scratch.save(level, f"level-{depth}")
        if level.isEmpty():
            return reached
        reached = reached.unionByName(level)
    if level.isEmpty():
        return reached
    raise ValueError("a root reaches a cycle")


def visible_descendants(nodes: DataFrame, open_: str) -> DataFrame:
    """(doc_id, node, visible): signed counts of the descendants that show, negative
    where the node itself is closed.

    nodes: (doc_id, node, parent, ord, and the flag). A node shows below an ancestor if
    all nodes between them are open, so each node counts for its ancestors from the
    deepest closed one on.
    """
    tree = flatten_tree(nodes.select("doc_id", "node", "parent", "ord"), [])
    flags = nodes.select("doc_id", "node", F.col(open_).alias("open_"))
    shut = tree.join(flags, ["doc_id", "node"]).where("not open_").select("doc_id", "path")
    steps = tree.select("doc_id", "node", "path", F.explode_outer(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("up")).where("size(up) < size(path)")
    closed = steps.join(shut.withColumnRenamed("path", "up"), ["doc_id", "up"]).groupBy("doc_id", "node").agg(F.max(F.size("up")).alias("deepest_"))
    counts = steps.join(closed, ["doc_id", "node"], "left").where("size(up) >= coalesce(deepest_, 1)").groupBy("doc_id", F.col("up").alias("path")).agg(F.count(F.lit(1)).alias("n_"))
    told = tree.join(counts, ["doc_id", "path"], "left").join(flags, ["doc_id", "node"])
    return told.select("doc_id", "node", (F.coalesce("n_", F.lit(0)) * F.when(F.col("open_"), 1).otherwise(-1)).alias("visible"))


def reachable(edges: DataFrame, roots: DataFrame, barrier: DataFrame | None = None, max_rounds: int = 1000) -> DataFrame:
    """(node, hops) of what the roots reach over edges (src, dst); a barrier stops there.

    Semi-naive: each round joins only what the last one found, and the visited set is
    anti-joined, so cycles end. Each round is a table in the shared folder.
    """
    scratch = Scratch(edges.sparkSession, "reach")
    edges = scratch.save(edges.select("src", "dst"), "edges")  # read once a round
    blocked = barrier.select("node").distinct() if barrier is not None else None
    keep = (lambda df: df.join(blocked, "node", "left_anti")) if blocked is not None else (lambda df: df)
    found = frontier = scratch.save(keep(roots.select("node").distinct()).withColumn("hops", F.lit(0)), "round-0")
    for k in range(1, max_rounds):
        step = frontier.join(edges, F.col("node") == F.col("src")).select(F.col("dst").alias("node")).distinct()
        frontier = scratch.save(keep(step).join(found.select("node"), "node", "left_anti").withColumn("hops", F.lit(k)), f"round-{k}")
        if frontier.isEmpty():
            return found
        found = found.unionByName(frontier)
    raise ValueError(f"no end after {max_rounds} rounds")


def _strong(nodes: list, edges: list[tuple]) -> dict:
    """Node to the smallest node of its strongly connected component (path-based, iterative)."""
    out: dict = {n: [] for n in nodes}
    for a, b in edges:
        out[a].append(b)
    number, label, open_, bounds = {}, {}, [], []
    for root in sorted(out):
        if root in number:
            continue
        work = [(root, iter(sorted(out[root])))]
        number[root] = len(number)
        open_.append(root)
        bounds.append(root)
        while work:
            node, rest = work[-1]
            for other in rest:
                if other not in number:
                    number[other] = len(number)
                    open_.append(other)
                    bounds.append(other)
                    work.append((other, iter(sorted(out[other]))))
                    break
                if other not in label:
                    while number[bounds[-1]] > number[other]:
                        bounds.pop()
            else:
                work.pop()
                if bounds[-1] == node:
                    bounds.pop()
                    members = [open_.pop()]
                    while members[-1] != node:
                        members.append(open_.pop())
                    least = min(members)
                    label.update(dict.fromkeys(members, least))
    return label


def strong_components(edges: DataFrame, group: str = "doc_id") -> DataFrame:
    """(group, node, component, size): components of each group's graph of (src, dst).

    References don't cross documents, so a group is one document's graph and its size is
    bounded by the document.
    """

    def per_group(pdf: pd.DataFrame) -> pd.DataFrame:
        pairs = list(pdf[["src", "dst"]].itertuples(index=False, name=None))
        nodes = {n for p in pairs for n in p}
        label = _strong(list(nodes), pairs)
        sizes = pd.Series(label).value_counts()
        return pd.DataFrame({group: pdf[group].iloc[0], "node": list(label), "component": list(label.values()), "size": [int(sizes[c]) for c in label.values()]})

    kind = edges.schema[group].dataType.simpleString()
    return edges.select(group, "src", "dst").groupBy(group).applyInPandas(per_group, f"{group} {kind}, node long, component long, size long")


def subtree_counts(tree: DataFrame) -> DataFrame:
    """Add descendants of each node of flatten_tree(): every node counts for its ancestors."""
    steps = tree.select("doc_id", F.explode(F.expr("transform(sequence(1, size(path)), k -> slice(path, 1, k))")).alias("path"))
    return tree.join(steps.groupBy("doc_id", "path").agg((F.count(F.lit(1)) - 1).alias("descendants")), ["doc_id", "path"])


def visible_counts(items: list[dict]) -> Iterator[tuple[int, int]]:
    """(item, signed count of visible descendants): negative where the item is closed.

    items: (id, parent, open) of one outline, parents before children.
    """
    kids: dict = {}
    for x in items:
        kids.setdefault(x["parent"], []).append(x)
    shown: dict = {}
    for x in reversed(items):
        shown[x["id"]] = sum(1 + (shown[k["id"]] if k["open"] else 0) for k in kids.get(x["id"], []))
    for x in items:
        yield x["id"], shown[x["id"]] if x["open"] else -shown[x["id"]]
