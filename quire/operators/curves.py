"""Sampled, exponential and stitched functions of one number, evaluated for all rows at once in columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.operators.scans import as_of
from quire.session import stage

SAMPLED, EXPONENTIAL, STITCHED = 0, 2, 3
DEEPEST = 8


def clamped(x: Column, low: Column, high: Column) -> Column:
    return F.least(F.greatest(x, low), high)


def evaluate(inputs: DataFrame, functions: DataFrame, parts: DataFrame, samples: DataFrame, fn: str = "fn", x: str = "x", to: str = "out") -> DataFrame:
    """inputs with `to`, the function's outputs as an array, null where the function is unknown, malformed or stitched more than DEEPEST deep.

    functions: fn, kind (0, 2 or 3), low, high (the domain, inputs are clamped to
    it), c0, c1 (arrays), n for kind 2, enc0, enc1, floor, ceil (arrays: the
    outputs' range) for kind 0. parts: fn, low, high, enc0, enc1, part: the
    functions that a kind 3 is stitched of, each from its low on, the last with its
    high. samples: fn, idx (from 0), value (array).

    A stitched function's part is found as of the input, level by level; a sample
    with the one behind it by an equi-join; all else is arithmetic on columns.
    """
    rest = F.struct(*inputs.columns).alias("rest")
    given = functions.select(F.col("fn").alias("of"), "kind", *(F.col(c).alias(f"f_{c}") for c in ("low", "high", "c0", "c1", "n", "enc0", "enc1", "floor", "ceil")))
    given = given.filter("f_low < f_high")
    rows = inputs.select(rest, F.col(fn).alias("at_fn"), F.col(x).cast("double").alias("at"), F.monotonically_increasing_id().alias("row"))
    rows, done = stage(rows, "curve-inputs"), []
    pieces = stage(parts.select(F.col("fn").alias("at_fn"), F.col("low").cast("double").alias("p_low"), F.col("high").cast("double").alias("p_high"), F.col("enc0").alias("p0"), F.col("enc1").alias("p1"), "part"), "curve-parts")
    for depth in range(DEEPEST + 1):
        met = stage(rows.join(given, F.col("at_fn") == F.col("of"), "left").withColumn("at", clamped(F.col("at"), F.col("f_low"), F.col("f_high"))), "curve-level")
        done.append(met.filter(f"kind is null or kind <> {STITCHED}"))
        stitched = met.filter(f"kind = {STITCHED}")
        if stitched.isEmpty():
            break
        if depth == DEEPEST:
            done.append(stitched.withColumn("kind", F.lit(None).cast("int")))
            break
        found = as_of(stitched.select("rest", "row", "at_fn", "at"), pieces, ["at_fn"], "at", "p_low", "p")
        share = (F.col("at") - F.col("p.p_low")) / (F.col("p.p_high") - F.col("p.p_low"))
        rows = stage(found.select("rest", F.col("p.part").alias("at_fn"), (F.col("p.p0") + share * (F.col("p.p1") - F.col("p.p0"))).alias("at"), "row"), "curve-inputs")
    leaves = done[0]
    for more in done[1:]:
        leaves = leaves.unionByName(more)
    share = (F.col("at") - F.col("f_low")) / (F.col("f_high") - F.col("f_low"))
    grown = F.zip_with("f_c0", "f_c1", lambda a, b: a + F.pow(share, F.col("f_n")) * (b - a))
    grown = F.when((F.col("f_n") > 0) & (F.size("f_c0") == F.size("f_c1")) & (F.size("f_c0") > 0), grown)
    held = samples.filter("idx >= 0").groupBy("fn", "idx").agg(F.max("value").alias("value"))
    behind = held.select(F.col("fn").alias("b_fn"), (F.col("idx") - 1).alias("b_idx"), F.col("value").alias("behind"))
    pairs = held.join(behind, (F.col("fn") == F.col("b_fn")) & (F.col("idx") == F.col("b_idx")), "left").select(F.col("fn").alias("s_fn"), F.col("idx").alias("s_idx"), "value", "behind")
    sizes = held.groupBy(F.col("fn").alias("z_fn")).agg((F.max("idx") + 1).alias("size"))
    leaves = leaves.join(sizes, F.col("at_fn") == F.col("z_fn"), "left")
    last = F.col("size") - 1
    place = clamped(F.coalesce("f_enc0", F.lit(0.0)) + share * (F.coalesce("f_enc1", last.cast("double")) - F.coalesce("f_enc0", F.lit(0.0))), F.lit(0.0), last.cast("double"))
    leaves = leaves.withColumn("place", F.when(F.col("kind") == SAMPLED, place))
    leaves = leaves.join(pairs, (F.col("at_fn") == F.col("s_fn")) & (F.floor("place") == F.col("s_idx")), "left")
    t = F.col("place") - F.floor("place")
    between = F.zip_with("value", F.coalesce("behind", "value"), lambda a, b: a * (1 - t) + b * t)
    kept = F.transform(between, lambda v, i: clamped(v, F.get("f_floor", i), F.get("f_ceil", i)))
    out = F.when(F.col("kind") == EXPONENTIAL, grown).when(F.col("kind") == SAMPLED, kept)
    return leaves.select("rest.*", out.alias(to))
