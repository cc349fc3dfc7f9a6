"""Running values over ordered rows, where no task ever needs all rows of a key.

Rows are dealt to pieces by sampled ranges of (keys, order) and written, which
fixes the dealing. A piece is sorted by itself; what stands before a piece is
known from one row for each key and piece. Sums, positions and "the last that
isn't null" need no more than that. Values with an operator of their own, which
has to be associative but not commutative, are folded in blocks of BLOCK rows,
the blocks' totals in blocks again, and so on up, and carried down again.

Order columns should tell all rows of a key apart; rows that tie stand in any
order. Nulls in keys are a key, nulls in order columns stand first. Sums of
doubles depend on how the rows are dealt; sums of integers and decimals don't.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import stage, unused

BLOCK = 128


def same(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> Column:
    """Equal in all pairs of columns, where null is equal to null."""
    cond = F.lit(True)
    for a, b in pairs:
        cond = cond & left[a].eqNullSafe(right[b])
    return cond


def in_pieces(df: DataFrame, keys: list[str], order: list[str]) -> tuple[DataFrame, str]:
    """df dealt to sampled ranges of keys and order and written, and the name of its column with the piece's number."""
    piece = unused(df, "piece")
    return stage(df.repartitionByRange(*keys, *order).withColumn(piece, F.spark_partition_id()), "pieces"), piece


def running_sums(df: DataFrame, keys: list[str], order: list[str], whole: dict[str, str] | None = None, **sums: Column) -> DataFrame:
    """df with a column for each of sums: its total over the key's rows up to and with this one. A null adds nothing.

    whole: of a sum's name, the name of a column with the key's total.
    """
    names = list(sums)
    for name, value in sums.items():
        df = df.withColumn(name, F.coalesce(value, F.lit(0)))
    rows, piece = in_pieces(df, keys, order)
    totals = rows.groupBy(*keys, piece).agg(*(F.sum(n).alias(n) for n in names))
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    renamed = {c: unused(rows, f"of_{i}") for i, c in enumerate([*keys, piece, *names])}
    ahead = [F.coalesce(F.sum(n).over(before), F.lit(0)).alias(renamed[n]) for n in names]
    all_ = [F.sum(n).over(Window.partitionBy(*keys)).alias(to) for n, to in (whole or {}).items()]
    totals = totals.select(*(F.col(c).alias(renamed[c]) for c in [*keys, piece]), *ahead, *all_)
    inside = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for n in names:
        rows = rows.withColumn(n, F.sum(n).over(inside))
    joined = rows.join(totals, same(rows, totals, [(c, renamed[c]) for c in [*keys, piece]]))
    return joined.select(*((F.col(c) + F.col(renamed[c])).alias(c) if c in names else F.col(c) for c in df.columns), *(whole or {}).values())


def last_seen(df: DataFrame, keys: list[str], order: list[str], value: str, to: str) -> DataFrame:
    """df with `to`, the last `value` that isn't null in the key's rows up to and with this one."""
    rows, piece = in_pieces(df, keys, order)
    inside = Window.partitionBy(*keys, piece).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    place = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = rows.groupBy(*keys, piece).agg(F.max_by(F.struct(value), place).alias("end"))
    before = Window.partitionBy(*keys).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)
    renamed = {c: unused(rows, f"of_{i}") for i, c in enumerate([*keys, piece, value])}
    # the struct around the value is null for a piece without one, which `last` skips
    ends = ends.select(*(F.col(c).alias(renamed[c]) for c in [*keys, piece]), F.last("end", ignorenulls=True).over(before)[value].alias(renamed[value]))
    rows = rows.withColumn(to, F.last(value, ignorenulls=True).over(inside))
    joined = rows.join(ends, same(rows, ends, [(c, renamed[c]) for c in [*keys, piece]]))
    return joined.select(*df.columns, F.coalesce(to, renamed[value]).alias(to))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_on: str, right_on: str, to: str = "found") -> DataFrame:
    """left with `to`, a struct of the last row of right with the same keys and right_on <= left_on; null if there is none.

    Of right rows that tie in keys and right_on, the greatest by its other
    columns is found. Left rows with a null in left_on find nothing.
    """
    rest = [c for c in right.columns if c not in keys]
    found = right.filter(F.col(right_on).isNotNull()).groupBy(*keys, F.col(right_on).alias("on")).agg(F.max(F.struct(*rest)).alias("row"))
    key = F.struct(*keys).alias("key") if keys else F.lit(0).alias("key")
    marks = found.select(key, "on", F.lit(0).alias("side"), "row", F.lit(None).cast(left.select(F.struct("*")).schema[0].dataType).alias("own"), F.lit(0).cast("long").alias("tie"))
    asks = left.select(key, F.col(left_on).cast(found.schema["on"].dataType).alias("on"), F.lit(1).alias("side"), F.lit(None).cast(found.schema["row"].dataType).alias("row"), F.struct("*").alias("own"))
    asks = asks.withColumn("tie", F.xxhash64("own"))
    seen = last_seen(marks.unionByName(asks), ["key"], ["on", "side", "tie"], "row", "last")
    return seen.filter("side = 1").select("own.*", F.when(F.col("on").isNotNull(), F.col("last")).alias(to))


def scan(df: DataFrame, keys: list[str], order: list[str], item: Column, combine: Callable[[Column, Column], Column], to: str, before: str | None = None, block: int = BLOCK) -> DataFrame:
    """df with `to`, combine over the items of the key's rows up to and with this one, and `before`, the same without this one (null for the first).

    combine has to be associative and is written over columns; it may not be
    null. Memory of a task holds `block` rows of a key at a time.
    """
    place, held = unused(df, "place"), unused(df, "held")
    numbered = running_sums(df.withColumn(held, item), keys, order, **{place: F.lit(1).cast("long")})
    rows = numbered.select(*(F.col(k).alias(f"k{i}") for i, k in enumerate(keys)), (F.col(place) - 1).alias("place"), F.col(held).alias("item"), F.struct(*df.columns).alias("row"))
    rows = stage(rows, "scan-rows")
    most = rows.agg(F.max("place")).first()[0] or 0
    out = _scanned(rows, [f"k{i}" for i in range(len(keys))], combine, most, block)
    return out.select("row.*", F.col("whole").alias(to), *([F.col("ahead").alias(before)] if before else []))


def _scanned(rows: DataFrame, keys: list[str], combine, most: int, block: int) -> DataFrame:
    """rows (keys, place from 0, item, row) with `whole` and `ahead`."""
    nothing = F.filter(F.transform("rows", lambda r: r["item"]), lambda _: F.lit(False))
    packed = rows.groupBy(*keys, F.floor(F.col("place") / block).alias("block")).agg(F.array_sort(F.collect_list(F.struct("place", "item", "row"))).alias("rows"))
    folded = F.aggregate("rows", nothing, lambda acc, r: F.when(F.size(acc) == 0, F.array(r["item"])).otherwise(F.concat(acc, F.array(combine(F.element_at(acc, -1), r["item"])))))
    packed = packed.withColumn("wholes", folded)
    base = F.lit(None).cast(rows.schema["item"].dataType)
    if most >= block:
        packed = stage(packed, "scan-blocks")
        totals = packed.select(*keys, F.col("block").alias("place"), F.element_at("wholes", -1).alias("item"), F.struct(F.lit(0).alias("none")).alias("row"))
        above = _scanned(totals, keys, combine, most // block, block).select(*(F.col(k).alias(f"of_{k}") for k in keys), F.col("place").alias("of_block"), F.col("ahead").alias("base"))
        packed = packed.join(above, same(packed, above, [*((k, f"of_{k}") for k in keys), ("block", "of_block")]))
        base = F.col("base")
    packed = packed.withColumn("from", base)
    packed = packed.withColumn("wholes", F.when(F.col("from").isNull(), F.col("wholes")).otherwise(F.transform("wholes", lambda w: combine(F.col("from"), w))))
    each = F.transform("rows", lambda r, i: F.struct(r["place"].alias("place"), r["row"].alias("row"), F.get("wholes", i).alias("whole"), F.when(i == 0, F.col("from")).otherwise(F.get("wholes", i - 1)).alias("ahead")))
    return packed.select(*keys, F.explode(each).alias("x")).select(*keys, "x.*")


# -- 2x3 matrices: [a, b, c, d, e, f] maps (x, y) to (a x + c y + e, b x + d y + f)


def multiplied(left: Column, right: Column) -> Column:
    """The matrix that applies right, then left."""
    m, n = [left[i] for i in range(6)], [right[i] for i in range(6)]
    across = [(m[0] * n[2 * j] + m[2] * n[2 * j + 1], m[1] * n[2 * j] + m[3] * n[2 * j + 1]) for j in range(3)]
    return F.array(*across[0], *across[1], across[2][0] + m[4], across[2][1] + m[5])


def running_products(df: DataFrame, keys: list[str], order: list[str], matrix: Column, to: str = "product") -> DataFrame:
    """df with the product of the key's matrices up to and with this row's, each applied before those in front of it."""
    return scan(df, keys, order, matrix.cast("array<double>"), multiplied, to)


# -- stacks


def _then(first: Column, second: Column) -> Column:
    """Depths as functions x -> min(high, max(low, x + step)); one after the other is such a function again."""
    held = lambda x: F.least(second["high"], F.greatest(second["low"], x + second["step"]))
    return F.struct((first["step"] + second["step"]).alias("step"), held(first["low"]).alias("low"), held(first["high"]).alias("high"))


def paired(df: DataFrame, keys: list[str], order: list[str], opens: Column, closes: Column, cap: int) -> DataFrame:
    """df's opening and closing rows with outcome, level, pair, mate: what a stack of at most `cap` makes of them.

    outcome: `open` or `close` of a pair, `left open`, `unmatched` (a close on an
    empty stack, which does nothing) or `over cap` (an open on a full one, which
    does nothing either, so that the next close is another's). level and pair, the
    number of the open at this level of the key, are the same for a pair's two
    rows and null for those without an open that counts; mate is an open's close as a
    struct of the order's columns. Depths come from a scan
    of clamped steps, pairs from running counts by level, so a key is never one
    task's.
    """
    kind, ahead, depth = unused(df, "kind"), unused(df, "ahead"), unused(df, "depth")
    rows = df.withColumn(kind, F.when(opens, 1).when(closes, -1).otherwise(0).cast("long")).filter(F.col(kind) != 0)
    long = lambda x: F.lit(x).cast("long")
    rows = scan(rows, keys, order, F.struct(F.col(kind).alias("step"), long(0).alias("low"), long(cap).alias("high")), _then, depth, ahead)
    at = F.coalesce(F.least(F.col(ahead)["high"], F.greatest(F.col(ahead)["low"], F.col(ahead)["step"])), long(0))
    rows = rows.withColumn(depth, at).drop(ahead)
    counts = F.when(F.col(kind) == 1, F.col(depth) < cap).otherwise(F.col(depth) > 0)
    level = F.when(counts, F.col(depth) + (F.col(kind) == 1).cast("long"))
    rows = rows.withColumn("level", level)
    on = rows.filter("level is not null")
    on = running_sums(on, [*keys, "level"], order, pair=(F.col(kind) == 1).cast("long"))
    closed = on.filter(F.col(kind) == -1).select(*(F.col(k).alias(f"of_{i}") for i, k in enumerate([*keys, "level", "pair"])), F.struct(*order).alias("mate"))
    on = on.join(closed, same(on, closed, [(k, f"of_{i}") for i, k in enumerate([*keys, "level", "pair"])]), "left")
    on = on.withColumn("outcome", F.when(F.col(kind) == -1, "close").when(F.col("mate").isNotNull(), "open").otherwise("left open"))
    on = on.withColumn("mate", F.when(F.col(kind) == 1, F.col("mate")))
    off = rows.filter("level is null").withColumn("pair", long(None)).withColumn("mate", F.lit(None).cast(on.schema["mate"].dataType)).withColumn("outcome", F.when(F.col(kind) == 1, "over cap").otherwise("unmatched"))
    columns = [*df.columns, "outcome", "level", "pair", "mate"]
    return on.select(columns).unionByName(off.select(columns))
