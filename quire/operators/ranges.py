"""Values looked up in ranges, the one defined last first, without writing ranges out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import stage

#: Levels at a time. Rows beyond which no table is broadcast: staged files are far smaller than their rows.
STRIDE, SMALL = 8, 100_000


def meetings(values: DataFrame, ranges: DataFrame, keys: list[str], value: str, first: str, last: str) -> DataFrame:
    """key_0 ..., value, low, high, range: every distinct value with every range that holds it; range is a struct of ranges' other columns.

    A range stands at the level whose buckets are the smallest not below its
    length, so it touches at most two of them, however long it is; a value is asked
    for once at each level that there is (at most 64), whatever its number of
    rows. So the join is by equality of bucket, with the range test beside it.
    Ranges without an end or ending before they begin have no values; null keys
    are a key; null values meet nothing.
    """
    rest = [c for c in ranges.columns if c not in keys]
    named = [f"key_{i}" for i in range(len(keys))]
    long = lambda c: F.col(c).cast("long")
    of = [F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]
    spans = ranges.select(*of, long(first).alias("low"), long(last).alias("high"), F.struct(*rest).alias("range")).filter("low <= high")
    # as bits: a range of length n needs as many as n - 1 has; one that overflows is two buckets of the top level
    length = F.try_subtract(F.col("high"), F.col("low"))
    level = F.when(length.isNull(), 63).when(length == 0, 0).otherwise(F.length(F.bin(length)))
    spans = spans.withColumn("level", level.cast("int"))
    levels = [r[0] for r in spans.select("level").distinct().collect()]
    bucket = lambda c: F.expr(f"shiftright({c}, level)")
    spans = spans.withColumn("bucket", F.explode(F.array_distinct(F.array(bucket("low"), bucket("high")))))
    asked = values.select(*of, long(value).alias("value")).filter("value is not null").distinct()
    asked = asked.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels)).cast("array<int>"))).withColumn("bucket", bucket("value"))
    cond = (asked["level"] == spans["level"]) & (asked["bucket"] == spans["bucket"]) & F.col("value").between(F.col("low"), F.col("high"))
    for n in named:
        cond = cond & asked[n].eqNullSafe(spans[n])
    return asked.join(spans, cond).select(*(asked[n].alias(n) for n in named), "value", "low", "high", "range")


def _blocks(spans: DataFrame, named: list[str]) -> DataFrame:
    """key_0 ..., level, bucket, number: of each block of 2^level values that a range takes up whole, the greatest number.

    A range is cut where its ends differ first, as bits. What is on the left of the
    cut is blocks of growing size up to it, what is on the right shrinking ones, at
    most 126 in all. Ends that a long can't pass are never stepped over.
    """
    bit = lambda name, k: F.expr(f"shiftrightunsigned({name}, {k}) & 1L") == 1
    cut = F.expr("low ^ high")
    rows = spans.select(*named, "number", "low", "high", F.when(cut == 0, 0).otherwise(F.length(F.bin(cut)) - 1).cast("int").alias("top"))
    rows = rows.withColumn("mask", F.expr("~shiftleft(-1L, top)"))
    # how many values less one there are on either side; a side that is a whole block is that block alone
    rows = rows.withColumn("left", F.expr("~low & mask")).withColumn("right", F.expr("high & mask"))
    rows = rows.withColumn("s", F.when(F.col("left") != F.col("mask"), F.col("left") + 1)).withColumn("t", F.when(F.col("right") != F.col("mask"), F.col("right") + 1))
    rows = rows.withColumn("level", F.explode(F.sequence(F.lit(0), "top")))
    whole = F.col("level") == F.col("top")
    up = F.when(F.col("s").isNull(), F.when(whole, F.expr("shiftright(low, level)"))).when(bit("s", "level"), F.expr("shiftright(low + (s & ~shiftleft(-1L, level)), level)"))
    down = F.when(F.col("t").isNull(), F.when(whole, F.expr("shiftright(high, level)")))
    down = down.when(bit("t", "level"), F.expr("shiftright((high & ~mask) + shiftleft(shiftrightunsigned(t, level + 1), level + 1), level)"))
    rows = rows.select(*named, "number", "level", F.explode(F.array(up, F.when(F.col("low") != F.col("high"), down))).alias("bucket"))
    return rows.filter("bucket is not null").groupBy(*named, "level", "bucket").agg(F.max("number").alias("number"))


def look_up(values: DataFrame, ranges: DataFrame, keys: list[str], value: str, first: str, last: str, order: str, to: str = "found") -> DataFrame:
    """values with `to`, a struct of the range with the same keys, first <= value <= last and the greatest order; null if none has it.

    Of equal orders the range that is the greatest as a struct holds. Ranges are
    numbered in that order, so that sums and joins carry one number, and cut into
    whole blocks (`_blocks`), of which the greatest number is kept: a value in a
    thousand ranges costs no more than one in a single range. Blocks are handed
    down STRIDE levels at a time, from those of many values to the values that
    are asked for, so that a block, however large, meets at most 2^STRIDE rows.
    """
    rest = [c for c in ranges.columns if c not in keys]
    named = [f"key_{i}" for i in range(len(keys))]
    of = [F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]
    spans = ranges.select(*of, F.col(first).cast("long").alias("low"), F.col(last).cast("long").alias("high"), F.col(order).alias("place"), F.struct(*rest).alias("row")).filter("low <= high")
    spans = spans.repartitionByRange("place", "row").sortWithinPartitions("place", "row")
    spans = stage(spans.select(*named, "low", "high", "row", F.monotonically_increasing_id().alias("number")), "ranges-numbered")
    blocks = stage(_blocks(spans, named), "ranges-blocks")
    levels = sorted(r[0] for r in blocks.select("level").distinct().collect())
    asked = stage(values.select(*of, F.col(value).cast("long").alias("value")).filter("value is not null").distinct(), "ranges-asked")
    spread = (lambda df: df.hint("merge")) if max(asked.count(), blocks.count(), spans.count()) > SMALL else (lambda df: df)
    best = asked.select(*named, F.col("value").alias("chunk"), F.lit(None).cast("long").alias("number")).limit(0)
    highest = max(levels, default=0) // STRIDE * STRIDE
    for base in range(highest, -1, -STRIDE):
        above, top = best.select(*named, F.lit(base + STRIDE).alias("level"), F.col("chunk").alias("bucket"), "number"), base + STRIDE
        here = blocks.filter(F.col("level").between(base, top - 1)).unionByName(above).withColumnsRenamed({n: f"of_{n}" for n in [*named, "level", "bucket"]})
        chunks = asked.select(*named, F.expr(f"shiftright(value, {base})").alias("chunk"))
        chunks = chunks.distinct() if base else chunks
        tried = chunks.withColumn("level", F.explode(F.array(*(F.lit(x) for x in levels if base <= x < top), *([F.lit(top)] if base < highest else [])).cast("array<int>")))
        tried = tried.withColumn("bucket", F.expr(f"shiftright(chunk, level - {base})"))
        on = (F.col("level") == F.col("of_level")) & (F.col("bucket") == F.col("of_bucket"))
        for n in named:
            on = on & F.col(n).eqNullSafe(F.col(f"of_{n}"))
        best = tried.join(spread(here), on).groupBy(*named, "chunk").agg(F.max("number").alias("number"))
    best = best.join(spread(spans.select("number", "row")), "number").select(*(F.col(n).alias(f"of_{n}") for n in named), F.col("chunk").alias("of_value"), F.col("row").alias("of_row"))
    asks = values.select(F.struct("*").alias("own"), *of, F.col(value).cast("long").alias("value"))
    on = F.col("value") == F.col("of_value")
    for n in named:
        on = on & F.col(n).eqNullSafe(F.col(f"of_{n}"))
    return asks.join(spread(best), on, "left").select("own.*", F.col("of_row").alias(to))


def mapped(values: DataFrame, definitions: DataFrame, keys: list[str], value: str, to: str) -> DataFrame:
    """values with `to`, the target that the last definition gives: its own plus how far the value stands behind its first.

    definitions: keys, first, last (null for a single code), target, ord.
    """
    found = look_up(values, definitions.withColumn("last", F.coalesce("last", "first")), keys, value, "first", "last", "ord", to)
    return found.withColumn(to, F.col(to)["target"] + F.col(value) - F.col(to)["first"])


def widths(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """keys, first, last, width, ord: ranges of width arrays, which are rows of keys, ord, first and either `list` (a width for each code) or last and width."""
    place = lambda i: F.struct(F.col("ord").cast("long").alias("at"), i.alias("i")).alias("ord")
    listed = arrays.filter(F.col("list").isNotNull()).select(*keys, "ord", F.col("first").cast("long").alias("first"), F.posexplode("list").alias("i", "width"))
    code = F.col("first") + F.col("i")
    listed = listed.filter("width is not null").select(*keys, code.alias("first"), code.alias("last"), F.col("width").cast("double").alias("width"), place(F.col("i")))
    spans = arrays.filter(F.col("list").isNull() & F.col("width").isNotNull())
    spans = spans.select(*keys, F.col("first").cast("long").alias("first"), F.col("last").cast("long").alias("last"), F.col("width").cast("double").alias("width"), place(F.lit(0)))
    return listed.unionByName(spans)
