"""Paths made of lines and curves, and which points a fill or a clip of them holds: winding numbers by a grid.

A point's winding number is that of its cell's upper right corner, plus what is
crossed on the way there: along the point's line to the cell's right side, and
up that side. So a point meets only the edges of its own cell. Corners' numbers
come from sums along the rows of corners, where they are constant over ranges of
cells, and a cell finds the ranges that hold it by buckets. Neither all edges of
a line of cells nor all shapes meet all points.

All decisions are signs of products of differences, which are exact for integers
and multiples of 1/2 below 2^25. A point on an edge counts as a little to the
right of it, and of a level edge as a little above, which is the same for points
and corners.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.ranges import meetings
from quire.session import stage

#: Points of a cell that meet its pieces together, and pairs of points and pieces of a task.
DENSE, TASK = 4096, 4_000_000


def flattened(curves: DataFrame, pieces: int = 16) -> DataFrame:
    """curves (other columns, x0, y0 ... x3, y3) as lines: other columns, piece, x0, y0, x1, y1."""
    rest = [c for c in curves.columns if c not in {f"{a}{i}" for a in "xy" for i in range(4)}]

    def at(axis: str, t: Column) -> Column:
        p, u = [F.col(f"{axis}{i}").cast("double") for i in range(4)], 1 - t
        return F.when(t == 0, p[0]).when(t == 1, p[3]).otherwise(u * u * u * p[0] + 3 * u * u * t * p[1] + 3 * u * t * t * p[2] + t * t * t * p[3])

    def piece(i: Column) -> Column:
        a, b = (i - 1) / F.lit(float(pieces)), i / F.lit(float(pieces))
        return F.struct(i.alias("piece"), at("x", a).alias("x0"), at("y", a).alias("y0"), at("x", b).alias("x1"), at("y", b).alias("y1"))

    return curves.select(*rest, F.explode(F.transform(F.sequence(F.lit(1), F.lit(pieces)), piece)).alias("line")).select(*rest, "line.*")


def closed(corners: DataFrame, shape: list[str], subpath: list[str], order: str) -> DataFrame:
    """shape, x0, y0, x1, y1: the edges of subpaths given by their corners (x, y) in order, each closed as a fill closes it."""
    w = Window.partitionBy(*shape, *subpath).orderBy(order)
    ends = [F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).cast("double").alias(f"{c}1") for c in ("x", "y")]
    rows = corners.filter("x is not null and y is not null")
    return rows.select(*shape, F.col("x").cast("double").alias("x0"), F.col("y").cast("double").alias("y0"), *ends)


def _side(x: Column, y: Column) -> Column:
    """Above 0 where (x, y) is to the left of the edge."""
    return (F.col("x1") - F.col("x0")) * (y - F.col("y0")) - (x - F.col("x0")) * (F.col("y1") - F.col("y0"))


def _rising(y: Column) -> Column:
    """1 or -1 where the edge crosses the level y going up or down, else 0."""
    return F.when((F.col("y0") <= y) & (y < F.col("y1")), 1).when((F.col("y1") <= y) & (y < F.col("y0")), -1).otherwise(0)


def _right_of(x: Column, y: Column) -> Column:
    """1 where an edge that crosses the level y does so right of x."""
    return (_side(x, y) * _rising(y) > 0).cast("int")


def _over(x: Column, y: Column) -> Column:
    """1 where an edge that crosses the upright x does so above y."""
    way, side = F.signum(F.col("x1") - F.col("x0")), _side(x, y)
    return F.when(side == 0, (F.col("y1") - F.col("y0")) * way > 0).otherwise(side * way < 0).cast("int")


def winding(points: DataFrame, edges: DataFrame, keys: list[str], shape: list[str], cell: int = 16) -> DataFrame:
    """points' columns with shape's and `winding`: a row for each point and shape whose number there isn't 0.

    points: x, y, keys and any others. edges: keys, shape and x0, y0, x1, y1 of
    closed subpaths. A fill or clip by the nonzero rule holds the rows' points; by
    the even-odd rule those whose winding is odd. Points without x or y are in no
    shape; null keys meet null keys; repeated points have a row each, repeated
    edges count each. cell: the grid's width, for edges of about that length.
    """
    at = lambda v: F.floor((v + 0.5) / cell)
    border = lambda i: (i + 1) * cell - F.lit(0.5)
    named, marks = [f"key_{i}" for i in range(len(keys))], [f"shape_{i}" for i in range(len(shape))]
    lines = edges.select(*(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), *(F.col(s).alias(n) for s, n in zip(shape, marks, strict=True)), *(F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")))
    lines = stage(lines.filter("x0 is not null and y0 is not null and x1 is not null and y1 is not null and (x0 <> x1 or y0 <> y1)"), "shape-edges")
    low, high = F.least("y0", "y1"), F.greatest("y0", "y1")

    # corners: where edges cross the rows of corners, summed from the left
    rows = F.sequence((F.ceil((low + 0.5) / cell) - 1).cast("long"), (F.ceil((high + 0.5) / cell) - 2).cast("long"))
    crossing = lines.filter((F.ceil((low + 0.5) / cell) - 1) <= (F.ceil((high + 0.5) / cell) - 2)).withColumn("cy", F.explode(rows))
    level = border(F.col("cy"))
    meets = F.col("x0") + (level - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0"))
    crossing = crossing.withColumn("near", (F.ceil((meets + 0.5) / cell) - 1).cast("long"))
    # the first corner that the crossing isn't right of, whatever rounding made of it
    right = lambda i: _right_of(border(F.col("near") + i), level) == 1
    cx = F.when(~right(-1), F.col("near") - 1).when(right(0), F.col("near") + 1).otherwise(F.col("near"))
    crossed = crossing.select(*named, *marks, "cy", cx.alias("cx"), _rising(level).alias("up")).groupBy(*named, *marks, "cy", "cx").agg(F.sum("up").alias("up"))
    along = Window.partitionBy(*named, *marks, "cy").orderBy("cx")
    ranges = crossed.select(*named, *marks, "cy", F.col("cx").alias("low"), (F.lead("cx").over(along) - 1).alias("high"), (-F.sum("up").over(along.rowsBetween(Window.unboundedPreceding, 0))).alias("winding"))
    ranges = ranges.filter("winding <> 0")

    given = points.select(F.struct("*").alias("point"), *(F.col(k).alias(n) for k, n in zip(keys, named, strict=True)), F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.monotonically_increasing_id().alias("row"))
    given = given.filter("px is not null and py is not null").withColumn("cx", at(F.col("px"))).withColumn("cy", at(F.col("py")))
    given = stage(given, "shape-points")
    # a cell's points are dealt to groups of about DENSE, each of which gets the cell's pieces
    cells = given.groupBy(*named, "cx", "cy").agg(F.count(F.lit(1)).alias("points")).withColumn("groups", F.ceil(F.col("points") / DENSE).cast("int"))
    cells = stage(cells.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).withColumn("cell", F.monotonically_increasing_id()), "shape-cells")
    inside = meetings(cells.filter("group = 0").select(*named, "cx", "cy"), ranges, [*named, "cy"], "cx", "low", "high")
    of = [*(f"of_{i}" for i in range(len(named))), "of_cy", "of_cx"]
    corner = inside.select(*(F.col(f"key_{i}").alias(n) for i, n in enumerate(of[:-1])), F.col("value").alias("of_cx"), *(F.col("range")[m].alias(m) for m in marks), *(F.lit(0.0).alias(c) for c in ("x0", "y0", "x1", "y1")), F.col("range.winding").alias("base"))
    here = (F.col("cx") == F.col("of_cx")) & (F.col("cy") == F.col("of_cy"))
    for n, o in zip(named, of, strict=False):
        here = here & F.col(n).eqNullSafe(F.col(o))

    # edges in the cells that they go through, with one to spare on either side for rounding
    lows, highs = at(low), at(high)
    banded = lines.withColumn("of_cy", F.explode(F.sequence(lows.cast("long"), highs.cast("long"))))
    cut = lambda y: F.when(F.col("y0") == F.col("y1"), None).otherwise(F.col("x0") + (y - F.col("y0")) * (F.col("x1") - F.col("x0")) / (F.col("y1") - F.col("y0")))
    bottom, top = cut(F.greatest(low, border(F.col("of_cy") - 1))), cut(F.least(high, border(F.col("of_cy"))))
    left, far = F.coalesce(F.least(bottom, top), F.least("x0", "x1")), F.coalesce(F.greatest(bottom, top), F.greatest("x0", "x1"))
    spare = 1e-6 + 1e-9 * F.abs("x0")
    local = banded.withColumn("of_cx", F.explode(F.sequence(at(left - spare).cast("long"), at(far + spare).cast("long"))))
    local = local.withColumnsRenamed({n: f"of_{i}" for i, n in enumerate(named)})
    pieces = corner.unionByName(local.select(*of, *marks, "x0", "y0", "x1", "y1", F.lit(0).cast("long").alias("base"))).join(cells, here)

    # all that an edge has in its cell whatever the point: the side of (bx, py) less what py adds, whether it crosses the cell's right side, and above or below the corner
    bx, by = border(F.col("cx")), border(F.col("cy"))
    up, way = F.signum(F.col("y1") - F.col("y0")), F.when((F.col("x0") <= bx) & (bx < F.col("x1")), -1).when((F.col("x1") <= bx) & (bx < F.col("x0")), 1).otherwise(0)
    fixed = {"dx": F.col("x1") - F.col("x0"), "dy": F.col("y1") - F.col("y0"), "low": low, "high": high, "up": up.cast("int"), "way": way, "off": (bx - F.col("x0")) * (F.col("y1") - F.col("y0")), "corner": _over(bx, by)}
    fixed |= {"flat": (up * F.signum(F.col("x1") - F.col("x0")) > 0).cast("int")}
    pieces = stage(pieces.select("cell", *marks, "x0", "y0", "base", *(c.alias(n) for n, c in fixed.items()), (F.col("points") / F.col("groups")).alias("meets")), "shape-pieces")

    # a group's points meet its pieces in one task, which then sums up all that a point has of a shape: no pair travels
    tasks = math.ceil((pieces.agg(F.sum("meets")).first()[0] or 0) / TASK) or 1
    dealt = given.withColumnsRenamed(dict(zip([*named, "cy", "cx"], of, strict=True))).join(cells, here & (F.expr("pmod(xxhash64(row), groups)") == F.col("group"))).select("cell", "row", "point", "px", "py")
    pairs = dealt.repartition(tasks, "cell").join(pieces.drop("meets").repartition(tasks, "cell"), "cell")
    # from the point to the right side the edge is crossed if the point is on its left, as it rises, and the side's point isn't
    here_side, there_side = F.expr("dx * (py - y0) - (px - x0) * dy"), F.expr("dx * (py - y0) - off")
    across = F.when((F.col("low") <= F.col("py")) & (F.col("py") < F.col("high")) & (here_side * F.col("up") > 0) & (there_side * F.col("up") <= 0), F.col("up")).otherwise(0)
    over = F.when(there_side == 0, F.col("flat")).when((there_side < 0) == (F.col("dx") > 0), 1).otherwise(0)
    part = F.col("base") + across + F.when(F.col("way") == 0, 0).otherwise(F.col("way") * (over - F.col("corner")))
    parts = pairs.select("cell", "row", "point", *marks, part.alias("part")).filter("part <> 0")
    total = parts.groupBy("cell", "row", "point", *marks).agg(F.sum("part").alias("winding")).filter("winding <> 0")
    return total.select("point.*", *(F.col(m).alias(s) for m, s in zip(marks, shape, strict=True)), "winding")
