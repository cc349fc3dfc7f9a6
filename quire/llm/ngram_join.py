"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A document is the set of its distinct k-word shingles (64-bit hashes). Two
documents link when their sets' Jaccard similarity reaches the threshold; the
result is each document's connected component. No link is lost, no bucket or
list is capped, and no step lists all pairs of a group.

1. Equal sets share one node, the 64-bit hash of the set.
2. Inverted lists hold each node's first hashes: for n shingles, threshold t
   and l = max(1, SPARE * n), the first n - ceil(t n) + l. Two similar nodes
   have at least min(l) of these in common, so this is a T-occurrence problem.
3. A node whose first hashes share fewer than the T of its smallest possible
   partner with any other node is done. For the others, the longest T - 1
   lists are skipped, as DivideSkip does: a similar pair still meets in one of
   the shorter ones. A list is named by its smallest node, so lists with the
   same members mostly become one bucket.
4. In a bucket, an inverted index over whole sets answers each node's query:
   short lists are merged and counted, long ones probed by binary search, and
   nodes that are already connected are not compared. Buckets above
   BUCKET_SHINGLES are cut into chunks that meet pairwise, so memory is
   bounded and no pair is missed.
5. Components come from star contraction over the links, in DataFrames.

Defined results: null and blank texts have an empty set and link with nothing;
with fewer than k words the whole sequence is one shingle; rows with null
doc_id link with nothing and have a null component; rows that repeat a doc_id
all count under it; an empty table gives no rows; other columns are ignored.
Hashes of different shingles are taken to differ.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quire.session import stage

SPARE = 0.12
#: Entries that a mapper holds before it hands them on.
HELD = 1 << 20
#: Shingles in a bucket that one task holds.
BUCKET_SHINGLES = 3_000_000
#: DivideSkip's factor for how many lists count as long.
MU = 0.0085
_M = np.uint64(0x9E3779B97F4A7C15)
_N = np.uint64(0xBF58476D1CE4E5B9)
_EMPTY = np.zeros(0, np.uint64)


def shingle_set(text: bytes | None, k: int) -> np.ndarray:
    """Sorted distinct hashes of a text's k-word shingles."""
    words = text.lower().split() if text else []  # bytes: A-Z only, and exactly \x20 and \x09-\x0D
    if not words:
        return _EMPTY
    w = np.array(list(map(xxh3_64_intdigest, words)), np.uint64)
    m = len(w) - k + 1
    if m < 1:
        h = np.full(1, len(w), np.uint64)
        for x in w:
            h = (h ^ x) * _M
    else:
        h = w[:m].copy()
        for i in range(1, k):
            h *= _M
            h ^= h >> np.uint64(29)
            h += w[i : i + m]
    h *= _N
    h ^= h >> np.uint64(32)
    h *= _M
    h.sort()
    if len(h) > 1:
        h = h[np.concatenate(([True], h[1:] != h[:-1]))]
    return h


def signature(h: np.ndarray) -> int:
    """Of a set, as a signed 64-bit number."""
    x = xxh3_64_intdigest(h.tobytes())
    return x - (1 << 64) if x >> 63 else x


def _up(percent: int, n):
    """ceil(percent / 100 * n) in whole numbers."""
    return -(-percent * n // 100)


def _spare(n):
    return np.maximum(1, (SPARE * np.asarray(n)).astype(np.int64))


def prefix_length(n: int, percent: int) -> int:
    return min(n, n - _up(percent, n) + int(_spare(n)))


def required(n, percent: int):
    """T of a node of n shingles: the least that a partner of any allowed size shares."""
    return _spare(_up(percent, np.asarray(n, np.int64)))


def _node_rows(k: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column("text").cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([len(h) for h in sets], pa.int64()), pa.array([signature(h) for h in sets], pa.int64())],
                ["doc_id", "n", "node"],
            )

    return run


def _list_parts(k: int, percent: int, parts: int):
    """Texts to (part, hashes, nodes, sizes): the entries of inverted lists, dealt by hash."""

    def run(batches):
        held: list[tuple[np.ndarray, int, int]] = []
        seen: set[int] = set()
        count = 0

        def flush():
            h = np.concatenate([x[0] for x in held])
            lengths = [len(x[0]) for x in held]
            node = np.repeat(np.array([x[1] for x in held], np.int64), lengths)
            size = np.repeat(np.array([x[2] for x in held], np.int32), lengths)
            part = (h % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            h, node, size = h[order], node[order], size[order]
            for low in range(0, parts, 256):
                mine = [p for p in range(low, min(parts, low + 256)) if ends[p] < ends[p + 1]]
                cut = [slice(ends[p], ends[p + 1]) for p in mine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine, pa.int32()), *(pa.array([a[c].tobytes() for c in cut], pa.binary()) for a in (h, node, size))],
                    ["part", "hashes", "nodes", "sizes"],
                )

        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                h = shingle_set(t, k)
                if not len(h) or (s := signature(h)) in seen:
                    continue
                seen.add(s)
                first = h[: prefix_length(len(h), percent)].copy()
                held.append((first, s, len(h)))
                count += len(first)
                if count >= HELD:
                    yield from flush()
                    held, count = [], 0
                    seen.clear()
        if held:
            yield from flush()

    return run


def _shared(parts: int):
    """Lists with two nodes or more, as (part of the node, nodes, sizes, list lengths, smallest nodes)."""

    def of_part(rows):
        h = np.concatenate([np.frombuffer(r[0], np.uint64) for r in rows])
        node = np.concatenate([np.frombuffer(r[1], np.int64) for r in rows])
        size = np.concatenate([np.frombuffer(r[2], np.int32) for r in rows])
        order = np.lexsort((node, h))
        h, node, size = h[order], node[order], size[order]
        new = np.concatenate(([True], (h[1:] != h[:-1]) | (node[1:] != node[:-1])))
        h, node, size = h[new], node[new], size[new]
        start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
        length = np.diff(np.append(start, len(h)))
        df, pivot = np.repeat(length, length), np.repeat(node[start], length)
        keep = df > 1
        node, size, df, pivot = node[keep], size[keep], df[keep].astype(np.int64), pivot[keep]
        to = (node.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((node, to))
        ends = np.searchsorted(to[order], np.arange(parts + 1))
        cols = [a[order] for a in (node, size, df, pivot)]
        for low in range(0, parts, 256):
            mine = [p for p in range(low, min(parts, low + 256)) if ends[p] < ends[p + 1]]
            if mine:
                cut = [slice(ends[p], ends[p + 1]) for p in mine]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(mine, pa.int32()), *(pa.array([a[c].tobytes() for c in cut], pa.binary()) for a in cols)],
                    ["part", "nodes", "sizes", "lengths", "pivots"],
                )

    def run(batches):
        rows: dict[int, list] = {}
        for b in batches:
            for p, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.setdefault(p, []).append(r)
        for p in list(rows):
            yield from of_part(rows.pop(p))

    return run


def _searching(percent: int):
    """Nodes that may have a partner, with the names of the lists in which they look for it."""

    def of_part(rows):
        node = np.concatenate([np.frombuffer(r[0], np.int64) for r in rows])
        size = np.concatenate([np.frombuffer(r[1], np.int32) for r in rows]).astype(np.int64)
        df = np.concatenate([np.frombuffer(r[2], np.int64) for r in rows])
        pivot = np.concatenate([np.frombuffer(r[3], np.int64) for r in rows])
        order = np.lexsort((pivot, df, node))
        node, size, pivot = node[order], size[order], pivot[order]
        start = np.flatnonzero(np.concatenate(([True], node[1:] != node[:-1])))
        count = np.diff(np.append(start, len(node)))
        need = required(size[start], percent)
        ids, sizes, lists = [], [], []
        for i in np.flatnonzero(count >= need):
            ids.append(int(node[start[i]]))
            sizes.append(int(size[start[i]]))
            lists.append(np.unique(pivot[start[i] : start[i] + count[i] - need[i] + 1]))
        for low in range(0, len(ids), 4096):
            at = slice(low, low + 4096)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids[at], pa.int64()), pa.array(sizes[at], pa.int64()), pa.array(lists[at], pa.list_(pa.int64()))],
                ["node", "n", "pivots"],
            )

    def run(batches):
        rows: dict[int, list] = {}
        for b in batches:
            for p, *r in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.setdefault(p, []).append(r)
        for p in list(rows):
            yield from of_part(rows.pop(p))

    return run


class _Forest:
    def __init__(self, n: int):
        self.up = np.arange(n)

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = int(up[x])
        return x

    def roots(self) -> np.ndarray:
        up = self.up
        while True:
            new = up[up]
            if (new == up).all():
                return up
            self.up = up = new


def links_of(nodes: list[int], sets: list[np.ndarray], percent: int, sides: list[int] | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the links among these sets, by T-occurrence search.

    sides: where given, only sets of different sides are compared.
    """
    by = sorted(range(len(nodes)), key=lambda i: (len(sets[i]), nodes[i]))
    sets, nodes = [sets[i] for i in by], [nodes[i] for i in by]
    side = np.array([sides[i] for i in by]) if sides is not None else None
    size = np.array([len(s) for s in sets], np.int64)
    h, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(h, kind="stable")  # within a list, nodes ascend
    h, of = h[order], of[order]
    start = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1])))
    words, length = h[start], np.diff(np.append(start, len(h)))
    forest, found = _Forest(len(sets)), []
    for x in range(1, len(sets)):
        need = _up(percent, int(size[x]))
        low = int(np.searchsorted(size, need))
        if low >= x:
            continue
        roots = forest.roots()
        mine = forest.root(x)
        if (roots[low:x] == mine).all():
            continue
        at = np.searchsorted(words, sets[x])
        longest = int(length[at].max())
        if longest < 2:
            continue
        n_long = min(need - 1, int(need / (MU * np.log2(longest) + 1)))
        lists = at[np.argsort(length[at], kind="stable")]
        short, long = lists[: len(lists) - n_long], lists[len(lists) - n_long :]
        merged = np.concatenate([of[start[i] : start[i] + length[i]] for i in short]) if len(short) else np.zeros(0, np.int64)
        merged = merged[(merged >= low) & (merged < x)]
        merged = merged[roots[merged] != mine]
        if side is not None:
            merged = merged[side[merged] != side[x]]
        if not len(merged):
            continue
        count = np.bincount(merged, minlength=x)
        probes = words[long]
        for y in np.flatnonzero(count >= max(1, need - n_long)).tolist():
            if forest.root(y) == mine:
                continue
            spot = np.minimum(np.searchsorted(sets[y], probes), size[y] - 1)
            both = int(count[y]) + int((sets[y][spot] == probes).sum())
            if 100 * both >= percent * (int(size[x]) + int(size[y]) - both):
                a, b = sorted((mine, forest.root(y)))
                forest.up[b] = a
                mine = a
                found.append((nodes[x], nodes[y]))
    return found


def _search(percent: int):
    """Rows sorted by bucket to links."""

    def of_bucket(rows: dict) -> list[tuple[int, int]]:
        nodes = sorted(rows)
        if len(nodes) < 2:
            return []
        sides = [rows[v][1] for v in nodes]
        sets = [np.frombuffer(rows[v][0], np.uint64) for v in nodes]
        return links_of(nodes, sets, percent, sides if min(sides) != max(sides) else None)

    def run(batches):
        now, rows, found = None, {}, []
        for b in batches:
            for pivot, i, j, side, node, h in zip(*(b.column(c).to_pylist() for c in ("pivot", "i", "j", "side", "node", "set")), strict=True):
                if (pivot, i, j) != now:
                    found += of_bucket(rows)
                    now, rows = (pivot, i, j), {}
                rows[node] = (h, side)
            if len(found) > 10_000:
                yield _links(found)
                found = []
        yield _links(found + of_bucket(rows))

    return run


def _links(found):
    return pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], pa.int64()) for i in (0, 1)], ["a", "b"])


def _sets(k: int):
    """Texts to sets; a row whose text isn't its node's is dropped."""

    def run(batches):
        for b in batches:
            sets = [shingle_set(t, k) for t in b.column("text").cast(pa.binary()).to_pylist()]
            nodes = b.column("node").to_pylist()
            keep = pa.array([signature(h) == v for h, v in zip(sets, nodes, strict=True)])
            full = pa.RecordBatch.from_arrays(
                [b.column("node"), b.column("at"), pa.array([h.tobytes() for h in sets], pa.binary())], ["node", "at", "set"]
            )
            yield full.filter(keep)

    return run


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the component's smallest node.

    Large-star and small-star by turns (Kiveris et al., 2014), each round
    written to the shared folder, until the edges stay as they are.
    """
    e = stage(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    last = None
    for _ in range(rounds):
        now = e.agg(F.count(F.lit(1)).alias("n"), F.sum(F.hash("a", "b").cast("long")).alias("h"), F.sum(F.xxhash64("b", "a").cast("decimal(38,0)")).alias("x")).first()
        if now == last or not now["n"]:
            break
        last = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        lower = large.join(small, "a")
        e = stage(lower.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(small.select("a", F.col("m").alias("b"))).distinct(), "edges")
    else:
        raise RuntimeError("components did not settle")
    leaves = e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return leaves.unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def links(docs: DataFrame, nodes: DataFrame, k: int, percent: int) -> DataFrame:
    """(a, b): links among nodes that connect whatever is connected. nodes: doc_id, n, node."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    flat = docs.select("doc_id", F.col("text").cast("string")).filter("doc_id is not null and text is not null")
    lists = flat.select("text").mapInArrow(_list_parts(k, percent, parts), "part int, hashes binary, nodes binary, sizes binary")
    shared = lists.repartition(parts, "part").mapInArrow(
        _shared(parts), "part int, nodes binary, sizes binary, lengths binary, pivots binary"
    )
    looking = stage(shared.repartition(parts, "part").mapInArrow(_searching(percent), "node long, n long, pivots array<long>"), "looking")
    at = looking.select("node", "n", F.explode("pivots").alias("pivot"))
    buckets = at.groupBy("pivot").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("words")).filter("members > 1")
    chunks = F.greatest(F.lit(1), F.ceil(2 * F.col("words") / BUCKET_SHINGLES)).cast("int")
    buckets = buckets.select("pivot", F.when(F.col("words") <= BUCKET_SHINGLES, 1).otherwise(chunks).alias("chunks"))
    placed = at.join(buckets, "pivot").withColumn("side", F.pmod(F.xxhash64("node"), "chunks").cast("int"))
    placed = placed.groupBy("node").agg(F.collect_list(F.struct("pivot", "chunks", "side")).alias("at"))
    first = nodes.filter("doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"))
    wanted = placed.join(first, "node")
    texts = flat.join(wanted, "doc_id").select("node", "at", "text")
    sets = texts.mapInArrow(_sets(k), "node long, at array<struct<pivot:bigint,chunks:int,side:int>>, set binary")
    rows = sets.select("node", "set", F.explode("at").alias("x")).select("node", "set", "x.*")
    meets = F.transform(
        F.sequence(F.lit(0), F.col("chunks") - 1),
        lambda o: F.struct(F.least(o, F.col("side")).alias("i"), F.greatest(o, F.col("side")).alias("j")),
    )
    rows = rows.withColumn("meet", F.explode(meets)).select("pivot", "meet.i", "meet.j", "side", "node", "set")
    dealt = rows.repartition(parts, "pivot", "i", "j").sortWithinPartitions("pivot", "i", "j", "node")
    return dealt.mapInArrow(_search(percent), "a long, b long")


def join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; 100 * intersection >= percent * union links two."""
    flat = docs.select("doc_id", F.col("text").cast("string"))
    kind = flat.schema["doc_id"].dataType.simpleString()
    nodes = stage(flat.mapInArrow(_node_rows(k), f"doc_id {kind}, n long, node long"), "nodes")
    linked = components(links(docs, nodes.filter("n > 0"), k, percent))
    rooted = nodes.filter("n > 0 and doc_id is not null").join(linked, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = rooted.groupBy("root", "node").agg(F.min("doc_id").alias("low"))
    # two steps, as a component may hold a third of all rows: nodes of a component, then the component
    of_root = smallest.groupBy("root").agg(F.min("low").alias("component"))
    of_node = smallest.select("root", "node").join(of_root, "root").select("node", "component")
    return nodes.join(of_node, "node", "left").select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(F.col("n") > 0, F.when(F.col("doc_id").isNotNull(), F.col("component"))).otherwise(F.col("doc_id")).alias("component_id"),
    )


def op10(docs: DataFrame) -> DataFrame:
    return join(docs, k=4, percent=85)


#: The same by a self-join of all shingles and the transitive closure of the links.
SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))
                                          WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * c >= 85 * (nx.n + ny.n - c)),
b AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
r AS (SELECT doc_id AS d, doc_id AS r FROM n UNION SELECT b.y, r.r FROM r JOIN b ON b.x = r.d),
m AS (SELECT d, min(r) AS component FROM r GROUP BY d)
SELECT t.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, CASE WHEN n.n IS NULL THEN t.doc_id ELSE m.component END AS component_id
FROM documents t LEFT JOIN n ON n.doc_id = t.doc_id LEFT JOIN m ON m.d = t.doc_id
"""
