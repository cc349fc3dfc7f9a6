"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Each source's documents stand in one fixed order, by a hash of the row, and
form a stream of words that is cut into blocks of BLOCK_WORDS. The stream may
be read at most twice: where the source's quota (its target in words) is above
its size, whole readings are taken first, and of the last reading as many
blocks as the quota still needs, in a permuted order; the last of them is cut,
so quotas are met to the word.

A binary tree over the output shards splits the drawn blocks: at each node,
how many blocks of each source go left is one draw of the multivariate
hypergeometric distribution, so every source's blocks and every shard's number
of blocks come out exactly. A shard owns disjoint ranges of each source's
permuted ranks, and shuffles its blocks locally by a hash (`place`).

All draws depend on the seed and on the sources' totals only: reruns agree.

Defined results: null or blank text has size 0 and is never taken; null source
is a source of its own, last in order; rows that are equal in doc_id, source
and text are counted before they are ordered and stand one after the other; a
document is cut where a block that isn't drawn begins; an empty table gives no
rows; more than MOST_SOURCES sources are an error, as the driver plans them;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import stage

WEIGHTS = (5, 2, 1)
BLOCK_WORDS = 256
#: A plan of more sources is joined by shuffle; sources that the driver plans, at most.
BROADCAST_SOURCES, MOST_SOURCES = 20_000, 2_000_000
#: Ranges of the order in each source, and copies of a row that are placed at a time.
RANGE_BITS, COPIES = 12, 1000
#: Blocks from which a node's draw is normal with the same mean and variance.
LARGE = 1_000_000_000


def _sizes(batches):
    for b in batches:
        texts = b.column("text").cast(pa.binary()).to_pylist()
        # bytes.split() parts at exactly \x20 and \x09-\x0D
        yield pa.RecordBatch.from_arrays(
            [pa.array([len(t.split()) if t else 0 for t in texts], pa.int64()) if n == "text" else b.column(n) for n in b.schema.names],
            ["size" if n == "text" else n for n in b.schema.names],
        )


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id (of its own type, integers as long), source, key (a hash of the row), size (words), and columns to carry (long), which are hashed too."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    kind = "bigint" if kind in ("tinyint", "smallint", "int", "void") else kind
    row = (F.col("doc_id").cast(kind), F.col("source").cast("string"), F.col("text").cast("string"))
    flat = docs.select(*row, F.xxhash64(*row, *carry).alias("key"), *carry)
    return flat.mapInArrow(_sizes, ", ".join([f"doc_id {kind}, source string, size long, key long", *(f"{c} long" for c in carry)]))


def targets(totals: list[tuple[str | None, int]], share: float = 1.5, most: float = 2.0) -> list[dict]:
    """Each source's weight and target: `share` of all words by weight, at most `most` times its own.

    The excess of sources at their limit is reshared among the others by
    weight until none is above: the level at which the shares add up. Sources
    stand by code point, null last.
    """
    order = sorted(totals, key=lambda x: (x[0] is None, x[0] or ""))
    rows = [{"source": s, "source_size": n, "weight": WEIGHTS[i % len(WEIGHTS)], "target": 0.0} for i, (s, n) in enumerate(order)]
    whole = share * sum(n for _, n in order)
    used, weight = 0.0, sum(r["weight"] for r in rows)
    for r in sorted(rows, key=lambda r: (most * r["source_size"] / r["weight"], rows.index(r))):
        fair = (whole - used) * r["weight"] / weight
        if fair < most * r["source_size"]:
            break
        r["target"] = most * r["source_size"]
        used, weight = used + r["target"], weight - r["weight"]
        r["full"] = True
    for r in rows:
        if not r.pop("full", False):
            r["target"] = (whole - used) * r["weight"] / weight
    return rows


def _drawn(rng, good: int, bad: int, n: int) -> int:
    """How many of n blocks drawn from good + bad are good ones."""
    if good + bad < LARGE:
        return int(rng.hypergeometric(good, bad, n))
    whole = good + bad
    spread = math.sqrt(n * (good / whole) * (bad / whole) * ((whole - n) / (whole - 1)))
    return min(max(round(n * good / whole + spread * float(rng.standard_normal())), 0, n - bad), n, good)


def split_tree(quotas: list[int], shards: int, seed: int) -> np.ndarray:
    """Blocks of each source (row) that each shard (column) gets; rows sum to the quotas."""
    rng = np.random.default_rng(seed)
    out = np.zeros((len(quotas), shards), np.int64)

    def deal(have: list[int], low: int, high: int) -> None:
        if high - low == 1:
            out[:, low] = have
            return
        mid = (low + high) // 2
        rest, left, mine = sum(have), sum(have) * (mid - low) // (high - low), []
        for n in have:
            rest -= n
            mine.append(_drawn(rng, n, rest, left))
            left -= mine[-1]
        deal(mine, low, mid)
        deal([n - x for n, x in zip(have, mine, strict=True)], mid, high)

    deal([int(q) for q in quotas], 0, shards)
    return out


def permutation(n: int, seed: int) -> tuple[int, int]:
    """(a, c) of the bijection k -> (a * k + c) mod n; no product exceeds 62 bits."""
    n = max(n, 1)
    rng = np.random.default_rng([seed, n])
    a = int(rng.integers(1, max(2, min(n, (1 << 62) // n))))
    while math.gcd(a, n) != 1:
        a -= 1
    return a, int(rng.integers(0, n))


def plan(totals: list[tuple[str | None, int]], shards: int = 8, seed: int = 17, share: float = 1.5) -> list[dict]:
    """What the driver decides from the sources' totals.

    blocks: of one reading; whole: readings that are taken whole; drawn: blocks
    of the reading after them, in permuted order, the last of which gives `cut`
    words; ends: where each shard's ranks end.
    """
    if len(totals) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} sources")
    rows = targets(totals, share)
    for i, r in enumerate(rows):
        size, quota = r["source_size"], math.floor(r["target"] + 0.5)
        r["quota"], r["blocks"] = quota, -(-size // BLOCK_WORDS)
        r["a"], r["c"] = permutation(r["blocks"], seed + i)
        r["whole"], rest = divmod(quota, size) if size else (0, 0)
        # the reading's last block is short, so it matters whether it is among those drawn
        short, at = r["blocks"] * BLOCK_WORDS - size, ((r["blocks"] - 1) * r["a"] + r["c"]) % max(r["blocks"], 1)
        held = lambda n, short=short, at=at: n * BLOCK_WORDS - (short if at < n else 0)
        n = -(-rest // BLOCK_WORDS)
        n += held(n) < rest
        r["drawn"], r["cut"] = n, rest - held(n - 1) if n else 0
    dealt = split_tree([r["whole"] * r["blocks"] + r["drawn"] for r in rows], shards, seed)
    for r, mine in zip(rows, dealt, strict=True):
        r["ends"] = [int(x) for x in np.cumsum(mine)]
    return rows


PLAN = (
    "source string, source_size long, weight int, target double, quota long, blocks long, "
    "whole long, drawn long, cut long, ends array<long>, a long, c long"
)


def placed(rows: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """rows with `start`, the words of its source that stand before the row's.

    Sums run in two steps, over ranges of the key and inside each range, so a
    source with a third of all rows is still spread over many tasks; equal rows
    are one until they have their places.
    """
    if not carry:
        rows = rows.groupBy("doc_id", "source", "size", "key").agg(F.count(F.lit(1)).alias("copies"))
    else:
        rows = rows.withColumn("copies", F.lit(1).cast("long"))
    words = F.col("size") * F.col("copies")
    rows = rows.withColumn("range", F.shiftrightunsigned("key", 64 - RANGE_BITS))
    sums = rows.groupBy("source", "range").agg(F.sum(words).alias("words"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum(words).over(inside), F.lit(0)))
    rows = rows.join(sums, F.col("source").eqNullSafe(F.col("s")) & (F.col("range") == F.col("r")))
    rows = rows.withColumn("start", F.col("base") + F.col("inside")).drop("s", "r", "base", "inside", "range")
    if carry:
        return rows.drop("copies")
    rows = rows.withColumn("some", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("copies") - 1) / COPIES))))
    rows = rows.repartition("key", "some")
    each = F.sequence(F.col("some") * COPIES, F.least((F.col("some") + 1) * COPIES, F.col("copies")) - 1)
    return rows.withColumn("copy", F.explode(each)).withColumn("start", F.col("start") + F.col("copy") * F.col("size")).drop("copies", "some", "copy")


SPAN = "struct<shard:int,place:bigint,rank:bigint,pass_no:int,first_word:bigint,words:bigint>"


def _spans(pass_no: int, seed: int) -> Column:
    """Of one reading of a document: its parts that lie in drawn blocks."""
    begin, end = F.col("start"), F.col("start") + F.col("size")

    def span(k):
        at = F.pmod(k * F.col("a") + F.col("c"), F.col("blocks"))
        rank = F.lit(pass_no) * F.col("blocks") + at
        stop = F.when((F.lit(pass_no) == F.col("whole")) & (at == F.col("drawn") - 1), k * BLOCK_WORDS + F.col("cut")).otherwise((k + 1) * BLOCK_WORDS)
        low, high = F.greatest(k * BLOCK_WORDS, begin), F.least(stop, end)
        return F.struct(
            F.size(F.filter("ends", lambda e: e <= rank)).alias("shard"),
            F.xxhash64(F.lit(seed), "source", rank).alias("place"),
            rank.alias("rank"),
            F.lit(pass_no).alias("pass_no"),
            (low - begin).alias("first_word"),
            (high - low).alias("words"),
        )

    every = F.transform(F.sequence(F.floor(begin / BLOCK_WORDS), F.floor((end - 1) / BLOCK_WORDS)), span)
    taken = F.filter(every, lambda x: (x["words"] > 0) & (x["rank"] < F.col("whole") * F.col("blocks") + F.col("drawn")))
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    return F.when((F.col("size") > 0) & (F.lit(pass_no) <= F.col("whole")), taken).otherwise(none)


def mix(docs: DataFrame, shards: int = 8, seed: int = 17, share: float = 1.5, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, spans, and the columns to carry.

    spans: for every part of the document that the mix takes, its shard, the
    place of its block in the shard's local shuffle, the block's rank among
    those drawn, the reading (0 or 1), first word and number of words.
    """
    spark = docs.sparkSession
    rows = stage(sized(docs, carry), "mix-sizes")
    totals = [(r["source"], int(r["n"])) for r in rows.groupBy("source").agg(F.sum("size").alias("n")).limit(MOST_SOURCES + 1).collect()]
    made = plan(totals, shards, seed, share)
    names = [x.split()[0] for x in PLAN.split(", ")]
    plans = spark.createDataFrame([tuple(r[n] for n in names) for r in made], PLAN).withColumnRenamed("source", "of")
    plans = F.broadcast(plans) if len(made) <= BROADCAST_SOURCES else plans
    joined = placed(rows, carry).join(plans, F.col("source").eqNullSafe(F.col("of")))
    return joined.withColumn("spans", F.concat(_spans(0, seed), _spans(1, seed))).select(
        "doc_id",
        "source",
        "size",
        "source_size",
        "target",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"]).alias("taken"),
        "spans",
        *carry,
    )


def local_order(df: DataFrame, *ties: str) -> DataFrame:
    """Rows with `shard` and `place` in each shard's locally shuffled order. A shard is dealt to many tasks, by ranges of the place."""
    dealt = df.repartition(F.col("shard"), F.shiftrightunsigned("place", 56))
    return dealt.sortWithinPartitions("shard", "place", *ties)


def shard_rows(mixed: DataFrame) -> DataFrame:
    """The mix itself: one row per taken span, each shard's blocks in locally shuffled order."""
    rows = mixed.select("doc_id", "source", F.explode("spans").alias("s")).select("doc_id", "source", "s.*")
    return local_order(rows, "rank", "doc_id", "first_word")


def op9(docs: DataFrame, shards: int = 8) -> DataFrame:
    """taken with how it was dealt: words to each shard, and a checksum of all spans with their shards and places."""

    def to(shard: int) -> Column:
        return F.aggregate(F.filter("spans", lambda s: s["shard"] == shard), F.lit(0).cast("long"), lambda a, s: a + s["words"])

    words = F.array(*(to(i) for i in range(shards)))
    said = F.concat_ws(",", F.transform("spans", lambda s: F.concat_ws(":", s["shard"], s["place"], s["pass_no"], s["first_word"], s["words"])))
    return mix(docs, shards).select(
        "doc_id", "size", "source_size", "target", "taken", F.size("spans").alias("n_spans"), words.alias("shard_words"), F.crc32(said.cast("binary")).alias("spans_crc32")
    )
