"""Import graphs: edge resolution and strongly connected components."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkloupe.session import discard, stored

#: Edges up to which components are found on the driver; an import graph of a large tree has far fewer.
DRIVER_EDGES = 1_000_000


def resolve_edges(imports: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): `module.name` if it is a node, else `module`; outside targets and self edges go."""
    full, plain = nodes.select(F.col("dotted").alias("_full")), nodes.select(F.col("dotted").alias("_plain"))
    joined = imports.withColumn("_t", F.concat_ws(".", "module", "name")).join(full, F.col("_t") == F.col("_full"), "left").join(plain, F.col("module") == F.col("_plain"), "left")
    edges = joined.select("src", F.coalesce("_full", "_plain").alias("dst"))
    return edges.where(F.col("dst").isNotNull() & (F.col("src") != F.col("dst"))).distinct()


def strong_components(edges: list[tuple[str, str]]) -> list[list[str]]:
    """Components of more than one node, members sorted; forward and backward reach by finishing order."""
    forward: dict[str, list[str]] = {}
    backward: dict[str, list[str]] = {}
    for a, b in edges:
        forward.setdefault(a, []).append(b)
        backward.setdefault(b, []).append(a)
    seen: set[str] = set()
    finished: list[str] = []
    for root in sorted({*forward, *backward}):
        todo = [(root, False)]
        while todo:
            node, done = todo.pop()
            if done:
                finished.append(node)
            elif node not in seen:
                seen.add(node)
                todo.append((node, True))
                todo.extend((x, False) for x in forward.get(node, ()) if x not in seen)
    taken: set[str] = set()
    out = []
    for root in reversed(finished):
        group, todo = [], [root]
        while todo:
            node = todo.pop()
            if node not in taken:
                taken.add(node)
                group.append(node)
                todo.extend(x for x in backward.get(node, ()) if x not in taken)
        if len(group) > 1:
            out.append(sorted(group))
    return sorted(out)


def _lowest(edges: DataFrame, name: str) -> DataFrame:
    """(node, label) of all ends of edges (src, dst): the smallest node from which each can be reached, itself included.

    Every round takes the lowest label over incoming edges, then the label of the node that the label names, which reaches the
    node too, so that labels come farther in every round.
    """
    labels = stored(edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct().select("node", F.col("node").alias("label"), F.col("node").alias("old")), name)
    while True:
        known = labels.select("node", "label")
        pushed = edges.join(known, F.col("src") == F.col("node")).groupBy("dst").agg(F.min("label").alias("low"))
        near = known.join(pushed, F.col("node") == F.col("dst"), "left").select("node", F.col("label").alias("old"), F.least("label", "low").alias("via"))
        far = known.select(F.col("node").alias("via"), "label")
        last, labels = labels, stored(near.join(far, "via").select("node", "label", "old"), name)
        discard(last)
        if labels.where("label <> old").isEmpty():
            return labels


def _between(edges: DataFrame, labels: DataFrame, name: str) -> DataFrame:
    """Edges (src, dst) whose ends have the same label, with it as the column called name."""
    a, b = labels.select(F.col("node").alias("src"), F.col("label").alias(name)), labels.select(F.col("node").alias("dst"), F.col("label").alias("_other"))
    return edges.join(a, "src").join(b, "dst").where(F.col(name) == F.col("_other")).drop("_other")


def cycle_nodes(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(node, label) of the nodes in strongly connected components of more than one node; label is one of them.

    Edges (src, dst); null ends, self edges and repeated edges do not matter.  While there are more edges than the driver takes,
    each round colours every node by the smallest node that reaches it and, inside a colour, by the smallest that it reaches:
    where both are one node, that node's component is found.  Edges between colours are in no cycle and go, so that a
    round ends at least one component of every colour.  Nodes are ordered by a digest: along a chain in the order of its names
    a label would otherwise move by one node a round.
    """
    spark = edges.sparkSession
    mixed = lambda c: F.concat(F.substring(F.md5(c), 1, 8), c).alias(c)
    name = lambda c: F.substr(c, F.lit(9)).alias(c)
    left = stored(edges.where("src <> dst").select(mixed("src"), mixed("dst")).distinct(), "cycles-edges")
    found = []
    while left.count() > driver_edges:
        fore = _lowest(left, "cycles-fore")
        inner = stored(_between(left, fore, "root"), "cycles-inner")
        back = _lowest(inner.select(F.col("dst").alias("src"), F.col("src").alias("dst")), "cycles-back")
        both = fore.select("node", "label").join(back.select("node", F.col("label").alias("end")), "node")
        found.append(stored(both.where("label = end").select("node", "label"), "cycles-found"))
        last, left = left, stored(_between(inner, back, "end").where("root <> end").select("src", "dst"), "cycles-edges")
        discard(last, fore, inner, back)
    groups = strong_components([(r.src, r.dst) for r in left.toLocalIterator()])
    discard(left)
    rest = spark.createDataFrame([(n, g[0]) for g in groups for n in g], "node string, label string")
    if found:
        whole = reduce(DataFrame.union, found)
        several = whole.groupBy("label").agg(F.count("*").alias("n")).where("n > 1").select("label")
        rest = rest.union(whole.join(several, "label").select("node", "label"))
    return rest.select(name("node"), name("label"))


def cycles(edges: DataFrame, driver_edges: int = DRIVER_EDGES) -> DataFrame:
    """(members, key): strongly connected components of more than one node; key joins the sorted members.

    A row holds all members of its component, as a report needs them; where one may be too large for that, use cycle_nodes.
    """
    groups = cycle_nodes(edges, driver_edges).groupBy("label").agg(F.array_sort(F.collect_list("node")).alias("members"))
    return groups.select("members", F.array_join("members", " <-> ").alias("key"))


def ratchet(found: DataFrame, allowed: DataFrame) -> DataFrame:
    """Adds blocking: the cycle is not in allowed (key)."""
    known = allowed.select("key", F.lit(True).alias("_known")).distinct()
    return found.join(known, "key", "left").withColumn("blocking", F.col("_known").isNull()).drop("_known")
