"""Walks down trees of rows, with values inherited from the nearest ancestor that has one.

All branches of all trees go down a level at a time: the nodes that a level
reached are joined with their links, and what they reach is written before the
next level, so lineage doesn't grow. A walk ends at `max_depth`, so there are at
most so many joins whatever the number of nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import stage


def walk(roots: DataFrame, links: DataFrame, attributes: DataFrame, inherited: list[str], max_depth: int, max_kids: int = 10_000) -> DataFrame:
    """tree, node, parent, depth, path, outcome and the inherited columns: a row for each node that is reached, and for each that is turned away.

    roots: tree, node. links: tree, parent, node, ord (from 0). attributes: tree,
    node and the inherited columns; nodes without a row there have nothing of
    their own. path: the ords from the root, so its order is that of a walk depth
    first. outcome: `inner` or `leaf`; or, for what a link leads to but no walk
    enters, `cycle` (the node was entered before, in the same branch or by a path
    that comes first), `too deep` (beyond max_depth), `too many` (ord not below
    max_kids, whose links are not counted one by one but as one row with the first ord).

    A node that several links lead to is entered by the path that comes first,
    as depth first does; where a deeper path comes first and its own links are cut
    by max_depth, they are not taken up again from the other path. A link to a
    node of its own branch is a cycle and never followed, so every walk ends. Null
    trees, nodes and ords: a tree may be null, a null node is never entered, null
    ords stand first. Repeated links are walked once.
    """
    many = links.filter(F.col("ord") >= max_kids).groupBy("tree", "parent").agg(F.min("ord").alias("ord"), F.min_by("node", "ord").alias("node"))
    few = links.filter((F.col("ord") < max_kids) | F.col("ord").isNull()).filter("node is not null").groupBy("tree", "parent", "node").agg(F.min("ord").alias("ord"))
    own = attributes.filter("node is not null").groupBy("tree", "node").agg(*(F.max(c).alias(c) for c in inherited))
    few = few.join(own.select(F.col("tree").alias("own_tree"), F.col("node").alias("own_node"), *inherited), F.col("tree").eqNullSafe(F.col("own_tree")) & (F.col("node") == F.col("own_node")), "left")
    few = stage(few.select("tree", "parent", "node", "ord", F.struct(*inherited).alias("own")), "tree-links")
    start = roots.filter("node is not null").select("tree", "node").distinct()
    start = start.join(own.select(F.col("tree").alias("own_tree"), F.col("node").alias("own_node"), F.struct(*inherited).alias("got")), F.col("tree").eqNullSafe(F.col("own_tree")) & (F.col("node") == F.col("own_node")), "left")
    none = F.lit(None).cast(few.schema["own"].dataType)
    start = start.select("tree", "node", F.lit(None).cast(few.schema["parent"].dataType).alias("parent"), F.expr("cast(array() as array<bigint>)").alias("path"), F.array("node").alias("branch"), F.coalesce("got", none).alias("got"))
    reached = stage(start, "tree-level")
    levels, met_levels = [reached], []
    for _ in range(max_depth + 1):
        of = few.select(F.col("tree").alias("of_tree"), F.col("parent").alias("of_parent"), F.col("node").alias("kid"), "ord", "own")
        met = reached.join(of, reached["tree"].eqNullSafe(of["of_tree"]) & (reached["node"] == of["of_parent"]))
        nearer = F.struct(*(F.coalesce(F.col("own")[c], F.col("got")[c]).alias(c) for c in inherited))
        met = met.select("tree", F.col("kid").alias("node"), F.col("node").alias("parent"), F.concat("path", F.array(F.col("ord").cast("long"))).alias("path"),
                         F.array_contains("branch", F.col("kid")).alias("back"), F.concat("branch", F.array("kid")).alias("branch"), nearer.alias("got"))
        met = stage(met, "tree-level")
        met_levels.append(met)
        # of all paths to a node so far, the one that comes first holds
        entered = met.filter((~F.col("back")) & (F.size("path") <= max_depth)).groupBy("tree", "node")
        first = entered.agg(F.min_by(F.struct("parent", "path", "branch", "got"), "path").alias("x")).select("tree", "node", "x.*")
        known = reduce(DataFrame.unionByName, levels).select(F.col("tree").alias("of_tree"), F.col("node").alias("of_node"), F.col("path").alias("of_path"))
        first = first.join(known, first["tree"].eqNullSafe(known["of_tree"]) & (first["node"] == known["of_node"]) & (known["of_path"] <= first["path"]), "left_anti")
        reached = stage(first, "tree-level")
        if reached.isEmpty():
            break
        levels.append(reached)
    best = reduce(DataFrame.unionByName, levels).groupBy("tree", "node").agg(F.min_by(F.struct("parent", "path", "got"), "path").alias("x"))
    best = stage(best.select("tree", "node", "x.*"), "tree-best")
    refused = reduce(DataFrame.unionByName, met_levels)
    columns = ["tree", "node", "parent", "depth", "path", "outcome", *inherited]
    parents = few.select(F.col("tree").alias("of_tree"), F.col("parent").alias("of_parent")).distinct()
    found = best.join(parents, best["tree"].eqNullSafe(parents["of_tree"]) & (best["node"] == parents["of_parent"]), "left")
    found = found.withColumn("outcome", F.when(F.col("of_parent").isNull(), "leaf").otherwise("inner"))
    held = best.select(F.col("tree").alias("of_tree"), F.col("node").alias("of_node"), F.col("path").alias("of_path"))
    # links of paths that did not hold are the business of the path that did
    via = held.withColumnsRenamed({"of_node": "via_node", "of_tree": "via_tree", "of_path": "via_path"})
    lost = refused.join(via, refused["tree"].eqNullSafe(via["via_tree"]) & (refused["parent"] == via["via_node"]) & (F.slice("path", 1, F.size("path") - 1) == via["via_path"]))
    lost = lost.join(held, lost["tree"].eqNullSafe(held["of_tree"]) & (lost["node"] == held["of_node"]), "left").filter(F.col("of_path").isNull() | (F.col("of_path") != F.col("path")))
    lost = lost.withColumn("outcome", F.when(F.size("path") > max_depth, "too deep").otherwise("cycle"))
    over = many.join(held, many["tree"].eqNullSafe(held["of_tree"]) & (many["parent"] == held["of_node"])).filter(F.size("of_path") < max_depth)
    over = over.select("tree", "node", "parent", F.concat("of_path", F.array(F.col("ord").cast("long"))).alias("path"), F.lit("too many").alias("outcome"), none.alias("got"))
    rows = found.select("tree", "node", "parent", "path", "outcome", "got").unionByName(lost.select("tree", "node", "parent", "path", "outcome", none.alias("got"))).unionByName(over)
    return rows.withColumn("depth", F.size("path")).select("tree", "node", "parent", "depth", "path", "outcome", *(F.col("got")[c].alias(c) for c in inherited)).select(columns)
