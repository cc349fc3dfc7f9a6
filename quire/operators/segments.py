"""Byte strings cut into the codes of a map, the longest that fits first, by joins and pointer doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import stage

#: Bytes of a code. Places beyond which no table of places is broadcast: staged files are far smaller than their rows.
WIDEST, SMALL = 4, 100_000


def segment(texts: DataFrame, codes: DataFrame, fallback: int = 1, by: str = "font", data: str = "data") -> DataFrame:
    """texts' other columns with pos, width, code, text: a row for each code that `data` is cut into.

    texts: `by`, `data` (binary) and any columns. codes: `by`, code (binary of 1 to
    WIDEST bytes), text; of equal codes the last text by order holds. At each
    place the longest code of the map is taken; where none fits, `fallback` bytes
    (or what is left) with a null text. Null and empty data have no rows.

    The codes that fit anywhere come from one equi-join over all places and
    widths. Which places are really reached is found by doubling: places that are
    known to be reached jump 1, 2, 4 ... codes ahead, so a text of n bytes takes
    log n joins over its places, which stand in any number of tasks. A text that
    occurs more than once under a map is cut once.
    """
    rest = [c for c in texts.columns if c != data]
    given = texts.select(F.col(by).alias("of"), F.col(data).cast("binary").alias("data"), F.struct(*rest).alias("rest")).filter("octet_length(data) > 0")
    rows = stage(given.select("of", "data").distinct().withColumn("row", F.monotonically_increasing_id()), "segment-texts")
    known = codes.filter(f"code is not null and octet_length(code) between 1 and {WIDEST}").groupBy(F.col(by).alias("known_of"), F.col("code").alias("known")).agg(F.max("text").alias("text"))
    size = F.octet_length("data")
    places = rows.select("row", "of", "data", size.alias("size"), F.explode(F.sequence(F.lit(0), size - 1)).alias("pos"))
    fits = F.sequence(F.lit(1), F.least(F.lit(WIDEST), F.col("size") - F.col("pos")))
    tried = places.select("row", "of", "size", "pos", F.explode(F.transform(fits, lambda w: F.substring("data", F.col("pos") + 1, w))).alias("code"))
    met = tried.join(known, F.col("of").eqNullSafe(F.col("known_of")) & (F.col("code") == F.col("known")), "left")
    hit = F.col("known").isNotNull()
    step = met.groupBy("row", "size", "pos").agg(
        F.max(F.when(hit, F.octet_length("code"))).alias("found"),
        F.max_by(F.struct("code", "text"), F.when(hit, F.octet_length("code"))).alias("best"),
        F.max_by("code", F.when(F.octet_length("code") <= fallback, F.octet_length("code"))).alias("some"),
    )
    width = F.coalesce("found", F.least(F.lit(fallback), F.col("size") - F.col("pos")))
    step = stage(step.select("row", "size", "pos", width.alias("width"), F.when(F.col("found").isNotNull(), F.col("best.code")).otherwise(F.col("some")).alias("code"), F.col("best.text").alias("text")), "segment-steps")
    most, places = step.agg(F.coalesce(F.max("size"), F.lit(0)), F.count(F.lit(1))).first()
    spread = (lambda df: df.hint("merge")) if places > SMALL else (lambda df: df)
    jumps = step.filter("pos + width < size").select("row", "pos", (F.col("pos") + F.col("width")).alias("to"))
    reached = rows.select("row", F.lit(0).alias("pos"))
    hops = 1
    while hops < most:
        ahead = spread(jumps.select(F.col("row").alias("of_row"), F.col("pos").alias("of_pos"), F.col("to").alias("of_to")))
        met = reached.join(ahead, (reached["row"] == ahead["of_row"]) & (reached["pos"] == ahead["of_pos"])).select("row", F.col("of_to").alias("pos"))
        reached = stage(reached.unionByName(met), "segment-reached")
        jumps = stage(jumps.join(ahead, (jumps["row"] == ahead["of_row"]) & (jumps["to"] == ahead["of_pos"])).select("row", "pos", F.col("of_to").alias("to")), "segment-jumps")
        hops *= 2
        if jumps.isEmpty():
            break
    taken = reached.join(spread(step), ["row", "pos"]).select("row", "pos", "width", "code", "text")
    named = spread(rows.select(F.col("of").alias("of_of"), F.col("data").alias("of_data"), "row"))
    given = given.join(named, F.col("of").eqNullSafe(F.col("of_of")) & (F.col("data") == F.col("of_data"))).select("row", "rest")
    return given.join(spread(taken), "row").select("rest.*", "pos", "width", "code", "text")
