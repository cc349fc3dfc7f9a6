"""Nested values as VARIANT, unrolled level by level: which names occur at which nodes, in the order of a scan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.operators.scans import running_sums
from quire.session import stage

MARKERS = ("Type", "Subtype", "S")
DEEPEST = 100


def nodes(values: DataFrame, keys: list[str], value: str, names: list[str], types: list[str], deepest: int = DEEPEST) -> DataFrame:
    """keys, path, found, cut: a row for each object and array inside `value`, a variant.

    path holds the places on the way from the root (members by their key's order),
    so it sorts as a scan goes. found: the names of this node, a type for each
    member among MARKERS that is a string of `types`, a key for each member whose
    key is of `names`. cut: whether nodes more than `deepest` below the root were left
    out here. Scalars, nulls and values that are no JSON have no node.
    """
    given, keys = keys, [f"key_{i}" for i in range(len(keys))]
    level = values.select(*(F.col(k).alias(n) for k, n in zip(given, keys, strict=True)), F.expr("cast(array() as array<int>)").alias("path"), F.col(value).alias("v"))
    levels = []
    for depth in range(deepest + 1):
        open_ = level.select(*keys, "path", F.expr("map_entries(try_variant_get(v, '$', 'map<string,variant>'))").alias("members"), F.expr("try_variant_get(v, '$', 'array<variant>')").alias("items"))
        open_ = stage(open_.filter("members is not null or items is not null"), "nested-level")
        marked = F.filter("members", lambda m: m["key"].isin(*MARKERS) & (F.schema_of_variant(m["value"]) == "STRING"))
        said = F.filter(F.transform(marked, lambda m: m["value"].cast("string")), lambda s: s.isin(types))
        own = F.transform(F.filter("members", lambda m: m["key"].isin(names)), lambda m: m["key"])
        below = F.coalesce(F.transform("members", lambda m: m["value"]), "items")
        last = F.lit(depth == deepest) & (F.size(below) > 0)
        levels.append(open_.select(*keys, "path", F.coalesce(F.concat(said, own), F.expr("cast(array() as array<string>)")).alias("found"), last.alias("cut")))
        if open_.isEmpty():
            break
        level = open_.select(*keys, "path", F.posexplode(below).alias("at", "v")).select(*keys, F.concat("path", F.array("at")).alias("path"), "v")
    return reduce(DataFrame.unionByName, levels).select(*(F.col(n).alias(k) for k, n in zip(given, keys, strict=True)), "path", "found", "cut")


def audit(values: DataFrame, keys: list[str], in_order: list[str], value: str, names: list[str], types: list[str], most: int, deepest: int = DEEPEST) -> tuple[DataFrame, DataFrame]:
    """(keys, name, n) and (keys, nodes, scanned, truncated): the names at the first `most` nodes of each key, in scan order.

    A key's values stand `in_order`; nodes are numbered by running totals, so a
    key with very many nodes is spread over tasks. Keys without any node have no row.
    """
    given, keys, order = keys, [f"of_{i}" for i in range(len(keys))], [f"in_{i}" for i in range(len(in_order))]
    renamed = values.select(*(F.col(c).alias(n) for c, n in zip([*given, *in_order], [*keys, *order], strict=True)), F.col(value).alias("value"))
    found = nodes(renamed, [*keys, *order], "value", names, types, deepest)
    counted = stage(running_sums(found, keys, [*order, "path"], {"number": "nodes"}, number=F.lit(1).cast("long")), "nested-nodes")
    seen = counted.filter(F.col("number") <= most)
    sums = seen.select(*keys, F.explode("found").alias("name")).groupBy(*keys, "name").agg(F.count(F.lit(1)).alias("n"))
    whole = counted.groupBy(*keys).agg(F.max("nodes").alias("nodes"), F.max("cut").alias("cut"))
    named = [F.col(n).alias(k) for n, k in zip(keys, given, strict=True)]
    return sums.select(*named, "name", "n"), whole.select(*named, "nodes", F.least("nodes", F.lit(most)).alias("scanned"), ((F.col("nodes") > most) | F.col("cut")).alias("truncated"))
