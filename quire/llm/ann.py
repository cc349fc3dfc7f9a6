"""Approximate nearest neighbours by learned partitions of a neighbour graph.

Offline, on a bounded sample of distinct vectors (SAMPLE, by hash): a k-nearest
neighbour graph is cut into parts of equal size by recursive spectral bisection
at the median with swaps that lower the cut, and a small network learns to
predict a vector's part. There are PARTS of them, and twice as many for each
doubling of the rows beyond PART_ROWS a part, up to MOST_PARTS, which is what the
sample can tell apart. Every vector is then indexed under its most probable part,
and a query is compared exactly with all vectors of its most probable parts. How
many parts a query visits is set on sampled vectors that the network was not
trained on, so that at least COVER of their neighbours lie in them; a query goes
on to further parts until these hold k other vectors.

Vectors of different dimensions have no distance and never meet. The DIMS most
common dimensions have a router each; vectors of any other dimension are one
part, which is searched whole, in chunks.

Equal vectors are one entry with their smallest ids: no more than k + 1 of them
can be among a query's nearest, so nothing is lost, and a vector that a third
of all rows share is no hot spot. Parts are cut into chunks, and queries of a
part into blocks, so a task holds one chunk and one block.

Defined results: vectors that are null, empty, zero, hold null or non-finite
components, or have no vec_id take no part; rows that repeat both id and vector
count once; ties go to the smaller vec_id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import stage

SAMPLE, PARTS, GRAPH_K, HIDDEN, EPOCHS, COVER = 6144, 32, 10, 128, 60, 0.975
#: Distinct vectors from which parts grow, parts at most, sampled vectors of which one is held out, dimensions with a router.
PART_ROWS, MOST_PARTS, HELD, DIMS = 16_384, 256, 5, 8
#: Sizes of parts that are sent to all tasks, at most; more (of very many dimensions) are joined by shuffle.
SIZES_SENT = 100_000
CHUNK, QUERY_BLOCK = 8192, 1024


def neighbours(x: np.ndarray, k: int, of: np.ndarray | None = None) -> np.ndarray:
    """The k nearest rows of x for each row of `of`, found in blocks; without `of`, each row's nearest other rows."""
    asked = x if of is None else of
    out = np.zeros((len(asked), k), np.int64)
    sq = (x * x).sum(1)
    for low in range(0, len(asked), 512):
        d = sq[None, :] - 2 * asked[low : low + 512] @ x.T
        if of is None:
            d[np.arange(len(d)), np.arange(low, low + len(d))] = np.inf
        near = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[low : low + 512] = np.take_along_axis(near, np.argsort(np.take_along_axis(d, near, 1), axis=1, kind="stable"), 1)
    return out


def _bisect(ids: np.ndarray, a: np.ndarray, b: np.ndarray, n: int, rng) -> tuple[np.ndarray, np.ndarray]:
    """Two halves of ids with few edges (a, b) between them."""
    local = np.full(n, -1)
    local[ids] = np.arange(len(ids))
    inside = (local[a] >= 0) & (local[b] >= 0)
    u, v = local[a[inside]], local[b[inside]]
    m = len(ids)
    degree = np.bincount(u, minlength=m) + np.bincount(v, minlength=m) + 1e-9
    root = np.sqrt(degree)
    f = rng.standard_normal(m)
    for _ in range(60):  # power iteration for the second eigenvector of the lazy normalised adjacency
        g = f / root
        f = 0.5 * f + 0.5 * (np.bincount(u, g[v], m) + np.bincount(v, g[u], m)) / root
        f -= root * (f @ root) / (root @ root)
        f /= np.linalg.norm(f) + 1e-30
    left = np.zeros(m, bool)
    left[np.argsort(f / root, kind="stable")[: m // 2]] = True
    for _ in range(8):
        across = left[u] != left[v]
        gain = np.bincount(u, np.where(across, 1, -1), m) + np.bincount(v, np.where(across, 1, -1), m)
        l, r = np.flatnonzero(left), np.flatnonzero(~left)
        l, r = l[np.argsort(-gain[l], kind="stable")], r[np.argsort(-gain[r], kind="stable")]
        swaps = min(len(l), len(r), max(1, m // 50))
        good = gain[l[:swaps]] + gain[r[:swaps]] > 0
        if not good.any():
            break
        left[l[:swaps][good]], left[r[:swaps][good]] = False, True
    return ids[left], ids[~left]


def balanced_parts(near: np.ndarray, parts: int, seed: int = 5) -> np.ndarray:
    """A part number for each vertex of the neighbour graph; parts' sizes differ by one at most per level."""
    n, rng = len(near), np.random.default_rng(seed)
    a, b = np.repeat(np.arange(n), near.shape[1]), near.reshape(-1)
    groups = [np.arange(n)]
    while len(groups) < parts:
        groups = [half for g in groups for half in _bisect(g, a, b, n, rng)]
    out = np.zeros(n, np.int64)
    for i, g in enumerate(groups):
        out[g] = i
    return out


class Router:
    """A network with one hidden layer from a vector to part probabilities."""

    def __init__(self, x: np.ndarray, part: np.ndarray, near: np.ndarray, parts: int, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.parts, self.mean, self.scale = parts, x.mean(0), x.std(0) + 1e-9
        # the goal for a vector is the share of each part among itself and its neighbours
        goal = np.zeros((len(x), parts))
        np.add.at(goal, (np.arange(len(x))[:, None], part[near]), 1.0)
        goal[np.arange(len(x)), part] += 1.0
        goal /= goal.sum(1, keepdims=True)
        dim = x.shape[1]
        self.p = [rng.standard_normal((dim, HIDDEN)) * np.sqrt(2 / dim), np.zeros(HIDDEN), rng.standard_normal((HIDDEN, parts)) * np.sqrt(1 / HIDDEN), np.zeros(parts)]
        m, s, t = [np.zeros_like(p) for p in self.p], [np.zeros_like(p) for p in self.p], 0
        z = (x - self.mean) / self.scale
        for _ in range(EPOCHS):
            for at in np.array_split(rng.permutation(len(x)), max(1, len(x) // 256)):
                h = np.maximum(z[at] @ self.p[0] + self.p[1], 0)
                d = (self._soft(h @ self.p[2] + self.p[3]) - goal[at]) / len(at)
                back = (d @ self.p[2].T) * (h > 0)
                grads = [z[at].T @ back, back.sum(0), h.T @ d, d.sum(0)]
                t += 1
                for i, g in enumerate(grads):
                    m[i], s[i] = 0.9 * m[i] + 0.1 * g, 0.999 * s[i] + 0.001 * g * g
                    self.p[i] -= 2e-3 * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)

    @staticmethod
    def _soft(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def order(self, x: np.ndarray) -> np.ndarray:
        """Parts of each row, most probable first."""
        h = np.maximum(((x - self.mean) / self.scale) @ self.p[0] + self.p[1], 0)
        return np.argsort(-(h @ self.p[2] + self.p[3]), axis=1, kind="stable")


def parts_of(rows: int) -> int:
    """How many parts so many distinct vectors are cut into."""
    parts = PARTS
    while parts < MOST_PARTS and rows > parts * PART_ROWS:
        parts *= 2
    return parts


def fit(x: np.ndarray, parts: int = PARTS, k: int = GRAPH_K, cover: float = COVER) -> tuple[Router | None, int]:
    """The router and how many parts to visit; None where the sample is too small to cut.

    Every HELD-th vector is held out of training, and the visits are set on these.
    """
    held = np.arange(len(x)) % HELD == HELD - 1
    if len(x) - held.sum() < max(4 * parts, k + 2):
        return None, 1
    known, asked = x[~held], x[held]
    near = neighbours(known, k)
    router = Router(known, balanced_parts(near, parts), near, parts)
    homes, order = router.order(known)[:, 0], router.order(asked)
    rank = np.zeros_like(order)
    np.put_along_axis(rank, order, np.arange(parts)[None, :], axis=1)
    # where each neighbour's own part stands in the held-out vector's list
    stands = np.sort(np.take_along_axis(rank, homes[neighbours(known, k, asked)], axis=1).reshape(-1))
    return router, int(stands[min(len(stands) - 1, int(np.ceil(cover * len(stands))))]) + 1


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (doubles), dim of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long"), v.alias("v")).filter("vec_id is not null and v is not null").filter(fine)
    # -0.0 and 0.0 are one number
    return rows.withColumn("v", F.transform("v", lambda x: x + 0.0)).withColumn("dim", F.size("v"))


def fitted(distinct: DataFrame) -> dict[int, tuple[Router, int]]:
    """Router and visits of the most common dimensions, those whose sample is large enough to be cut."""
    found = {}
    common = distinct.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(DIMS).collect()
    for dim, n in common:
        sample = distinct.filter(F.col("dim") == dim).orderBy("h1", "h2").limit(SAMPLE).select("v").toArrow()
        x = np.array(sample.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False), float).reshape(-1, dim)
        router, visits = fit(x, parts_of(n))
        if router is not None:
            found[dim] = (router, visits)
    return found


def _visited(order: np.ndarray, held: np.ndarray, visits: int, least: int) -> list[list[int]]:
    """The first `visits` parts of each order, and further ones until `least` entries are held."""
    enough = (np.cumsum(held[order], axis=1) < least).sum(1) + 1
    return [row[: max(visits, n)].tolist() for row, n in zip(order, enough, strict=True)]


def _route(routers, held: dict[int, np.ndarray] | None = None, least: int = 0):
    """Adds `parts`: a vector's home, or with `held` (entries in each part of a dimension) the parts that a query visits."""

    def run(batches):
        for b in batches:
            vectors = b.column("v").to_pylist()
            parts: list = [[0]] * len(vectors)
            by_dim: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by_dim.setdefault(len(v), []).append(i)
            for dim, at in by_dim.items():
                if dim not in routers.value:
                    continue
                router, visits = routers.value[dim]
                order = router.order(np.array([vectors[i] for i in at], float))
                own = order[:, :1].tolist() if held is None else _visited(order, held[dim], visits, least)
                for i, p in zip(at, own, strict=True):
                    parts[i] = p
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(parts, pa.list_(pa.int32()))], [*b.schema.names, "parts"])

    return run


def _compare(k: int):
    """Rows sorted by (dim, part, chunk, block, kind): a chunk's vectors, then a block's queries."""

    def run(batches):
        now, ids, made, x = None, [], [], None
        out: list[tuple] = []
        for b in batches:
            for dim, part, chunk, block, kind, h1, h2, who, v in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (dim, part, chunk, block) != now:
                    now, ids, made, x = (dim, part, chunk, block), [], [], None
                if kind == 0:
                    ids.append(who)
                    made.append(np.array(v))
                    continue
                if x is None:
                    if not made:
                        continue
                    x, made = np.stack(made), []
                d = np.sqrt(np.square(x - np.array(v)).sum(axis=1))
                if len(d) > k:
                    top = np.flatnonzero(d <= np.partition(d, k - 1)[k - 1]).tolist()
                else:
                    top = range(len(d))
                out += [(h1, h2, s, w) for s, w in sorted((float(d[i]), w) for i in top for w in ids[i])[:k]]
                if len(out) > 20_000:
                    yield _found(out)
                    out = []
        yield _found(out)

    return run


def _found(rows):
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["h1", "h2", "score", "vec_id"])


def search(vectors: DataFrame, every: int = 100, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: the nearest found of every query (vec_id divisible by `every`)."""
    spark = vectors.sparkSession
    n_shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = usable(vectors).withColumn("h1", F.xxhash64("v")).withColumn("h2", F.xxhash64(F.lit(1), "v"))
    rows = stage(rows.dropDuplicates(["vec_id", "h1", "h2"]), "vectors")
    by_id = Window.partitionBy("h1", "h2").orderBy("vec_id")
    few = rows.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= k + 1)
    distinct = few.groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"), F.min_by("v", "vec_id").alias("v"), F.min("dim").alias("dim"))
    distinct = stage(distinct, "distinct-vectors")
    models = fitted(distinct)
    routers = spark.sparkContext.broadcast(models)
    kinds = "h1 long, h2 long, ids array<bigint>, v array<double>, dim int, parts array<int>"
    homes = distinct.select("h1", "h2", "ids", "v", "dim").mapInArrow(_route(routers), kinds)
    homes = stage(homes.withColumn("part", F.element_at("parts", 1)).drop("parts"), "homes")
    counts = homes.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("n"))
    held = {dim: np.zeros(router.parts, np.int64) for dim, (router, _) in models.items()}
    for dim, part, n in counts.filter(F.col("dim").isin(list(held))).collect():  # DIMS times MOST_PARTS rows at most
        held[dim][part] = n
    queries = rows.filter(F.pmod("vec_id", F.lit(every)) == 0)
    asked = queries.dropDuplicates(["h1", "h2"]).select("h1", "h2", F.array("vec_id").alias("ids"), "v", "dim")
    visiting = stage(asked.mapInArrow(_route(routers, held, k + 1), kinds).withColumn("part", F.explode("parts")).drop("parts"), "visits")
    size = counts.select("dim", "part", F.ceil(F.col("n") / CHUNK).alias("chunks"))
    size = size.join(visiting.groupBy("dim", "part").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks")), ["dim", "part"])
    size = stage(size, "part-sizes")
    size = F.broadcast(size) if size.count() <= SIZES_SENT else size
    place = F.xxhash64(F.lit(2), "h1", "h2")
    left = homes.join(size, ["dim", "part"]).withColumn("chunk", F.pmod(place, "chunks")).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    right = visiting.join(size, ["dim", "part"]).withColumn("block", F.pmod(place, "blocks")).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - 1)))
    cols = ["dim", "part", "chunk", "block", "kind", "h1", "h2", "ids", "v"]
    meet = left.withColumn("kind", F.lit(0)).select(cols).unionByName(right.withColumn("kind", F.lit(1)).select(cols))
    meet = meet.repartition(n_shuffle, "dim", "part", "chunk", "block").sortWithinPartitions("dim", "part", "chunk", "block", "kind")
    near = meet.mapInArrow(_compare(k + 1), "h1 long, h2 long, score double, vec_id long")
    best = near.withColumn("r", F.row_number().over(Window.partitionBy("h1", "h2").orderBy("score", "vec_id"))).filter(F.col("r") <= k + 1).drop("r")
    found = queries.select(F.col("vec_id").alias("query_id"), "h1", "h2").join(best, ["h1", "h2"]).filter("vec_id <> query_id")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op7(vectors: DataFrame) -> DataFrame:
    return search(vectors)
