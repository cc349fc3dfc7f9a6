"""Image rows freed of their predictors: prefix sums modulo 256 along rows and down columns, folds where a pixel needs both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.scans import running_sums, same
from quire.session import stage, unused

NONE, SUB, UP, AVERAGE, PAETH = range(5)


def tiff(rows: DataFrame, keys: list[str], colours: int, row: str = "row", data: str = "data") -> DataFrame:
    """rows of predictor 2: each byte is a difference from the same colour's byte to the left."""
    return png(rows.withColumn(unused(rows, "filter"), F.lit(SUB)), keys, colours, row, data, unused(rows, "filter")).drop(unused(rows, "filter"))


def png(rows: DataFrame, keys: list[str], colours: int, row: str = "row", data: str = "data", kind: str = "filter") -> DataFrame:
    """rows with `data` (bytes as an array of int) as it was before predictors 10 to 15 were applied.

    kind: the row's filter, 0 to 4; any other and null are none. Rows of an image
    stand by `row`, which has to tell them apart; what is above the first, to the
    left of the first, or beyond a shorter row counts as 0; null data is no bytes.

    Rows without a filter and of Sub need nothing above them, so each begins a
    chain. A chain that goes on with Up only is a sum along its first row and then
    sums down each column, in windows over pixels: no task needs more than a row,
    or a column of a chain. Only chains with Average or Paeth, whose pixels wait for
    those to the left and above, or with rows of several lengths are folded row by row, a chain in one task.
    """
    chain, code, first, folded, place = (unused(rows, n) for n in ("chain", "code", "first", "folded", "place"))
    least = rows.groupBy(*keys).agg(F.min(row).alias(first))
    renamed = least.select(*(F.col(k).alias(f"of_{i}") for i, k in enumerate(keys)), first)
    known = F.when(F.col(kind).isin(SUB, UP, AVERAGE, PAETH), F.col(kind)).otherwise(NONE).cast("int")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"of_{i}"))
    marked = rows.withColumn(data, F.coalesce(data, F.expr("cast(array() as array<int>)")).cast("array<int>")).join(renamed, on).drop(*(f"of_{i}" for i in range(len(keys))))
    marked = marked.withColumn(code, F.when((F.col(row) == F.col(first)) & (known == UP), NONE).otherwise(known))
    begins = (F.col(row) == F.col(first)) | F.col(code).isin(NONE, SUB)
    chained = stage(running_sums(marked, keys, [row], **{chain: begins.cast("long")}).drop(first), "predictor-chains")
    whole = chained.groupBy(*(F.col(c).alias(f"of_{i}") for i, c in enumerate([*keys, chain])))
    hard = whole.agg(F.max(F.col(code).isin(AVERAGE, PAETH)).alias("waits"), (F.min(F.size(data)) != F.max(F.size(data))).alias("ragged")).filter("waits or ragged")
    pairs = [(c, f"of_{i}") for i, c in enumerate([*keys, chain])]
    folds = chained.join(hard, same(chained, hard, pairs), "left_semi")
    sums = chained.join(hard, same(chained, hard, pairs), "left_anti")
    out = _summed(sums, [*keys, chain], colours, row, data, code, place).unionByName(_folded(folds, [*keys, chain], colours, row, data, code))
    return out.select(rows.columns)


def _summed(rows: DataFrame, keys: list[str], colours: int, row: str, data: str, code: str, place: str) -> DataFrame:
    """Chains of one row without a filter or of Sub, and rows of Up: sums over exploded pixels."""
    value, rest = unused(rows, "value"), [c for c in rows.columns if c not in (*keys, row, data)]
    empty = rows.filter(F.size(data) == 0)
    pixels = rows.select(*keys, row, code, F.posexplode(data).alias(place, value))
    along = Window.partitionBy(*keys, row, F.col(place) % colours).orderBy(place).rowsBetween(Window.unboundedPreceding, 0)
    pixels = pixels.withColumn(value, F.when(F.col(code) == SUB, F.sum(value).over(along)).otherwise(F.col(value)))
    down = Window.partitionBy(*keys, place).orderBy(row).rowsBetween(Window.unboundedPreceding, 0)
    pixels = pixels.withColumn(value, F.pmod(F.sum(value).over(down), F.lit(256)).cast("int"))
    whole = pixels.groupBy(*keys, row).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, value))), lambda p: p[value]).alias(data))
    other = rows.filter(F.size(data) > 0).select(*(F.col(c).alias(f"of_{i}") for i, c in enumerate([*keys, row])), *rest)
    met = whole.join(other, same(whole, other, [(c, f"of_{i}") for i, c in enumerate([*keys, row])]))
    return met.select(rows.columns).unionByName(empty)


def _predicted(code: Column, left: Column, up: Column, corner: Column) -> Column:
    guess = left + up - corner
    off = [F.abs(guess - x) for x in (left, up, corner)]
    paeth = F.when((off[0] <= off[1]) & (off[0] <= off[2]), left).when(off[1] <= off[2], up).otherwise(corner)
    return F.when(code == SUB, left).when(code == UP, up).when(code == AVERAGE, F.floor((left + up) / 2).cast("int")).when(code == PAETH, paeth).otherwise(0)


def _folded(rows: DataFrame, keys: list[str], colours: int, row: str, data: str, code: str) -> DataFrame:
    """Chains row by row, each row byte by byte."""
    rest = [c for c in rows.columns if c not in keys]
    empty = F.expr("cast(array() as array<int>)")
    zero = lambda c: F.coalesce(c, F.lit(0))
    back = lambda array, at: zero(F.when(at >= colours, F.get(array, at - colours)))

    def fold(above: Column, r: Column) -> Column:
        def byte(done: Column, x: Column) -> Column:
            at = F.size(done)
            near = _predicted(r[code], back(done, at), zero(F.get(above, at)), back(above, at))
            return F.concat(done, F.array(F.pmod(x + near, F.lit(256)).cast("int")))

        return F.aggregate(r[data], empty, byte)

    packed = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(row, F.struct(*rest).alias("rest")))).alias("rows"))
    lines = F.aggregate("rows", F.expr("cast(array() as array<array<int>>)"), lambda done, r: F.concat(done, F.array(fold(F.coalesce(F.get(done, F.size(done) - 1), empty), r["rest"]))))
    each = packed.withColumn("lines", lines).select(*keys, F.posexplode("rows").alias("i", "r"), "lines")
    return each.select(*keys, *(F.get("lines", F.col("i")).alias(c) if c == data else F.col("r.rest")[c].alias(c) for c in rest)).select(rows.columns)
