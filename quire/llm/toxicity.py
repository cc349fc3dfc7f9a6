"""Toxicity by nearest labelled examples: exact TF-IDF cosine over a block-max index.

Labels are learnt from at most EXAMPLES labelled rows outside the held-out
fold, those whose doc_id hashes lowest (a documented bound on the classifier's
sample). Terms are all words of all examples, clean ones included; none is
left out; of rows that repeat a doc_id the first text in order counts. A word weighs (1 + ln tf) * idf * phi-squared: document frequencies
are counted over all documents, and phi-squared (chi-squared / N on the
examples, from 0 to 1 at any N) is how far the word tells the labels apart. A
word that no example has tells nothing and weighs 0. Words are held as 64-bit
hashes; hashes of different words are taken to differ.

The index holds the examples' term lists in blocks, with each term's largest
weight per block. A query adds up block bounds, visits the blocks of highest
bound, then all whose bound reaches its k-th best cosine; the most frequent
terms' lists are added up beforehand, as a product, and tighten the bounds: the
nearest examples are exact. Votes weighted by cosine, smoothed by the base rate, are
calibrated by isotonic regression of leave-one-out votes.

A score depends on the text alone. Defined results: null, blank and termless
texts get the calibrated base rate; equal texts get equal scores; equal cosines
count in the examples' fixed order; with usable labels of one kind only every score
is that label, and with none 0, so nothing is rejected; null doc_id counts as the empty text for the fold; other
columns are ignored by `score` and kept by `reject`.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quire.session import stage

EXAMPLES, NEIGHBOURS, PRIOR_WEIGHT, BLOCK, CUT = 8192, 31, 3.0, 256, 0.3
#: Blocks visited before the bound is known, terms whose lists are held as rows, and queries worked on together.
AT_FIRST, DENSE, TOGETHER = 2, 256, 16
#: Scores remembered by a worker for equal texts.
REMEMBERED = 20_000
#: Everything but letters parts words; A-Z is lowered.
_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_LETTERS).split() if text else []


def hashed(text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of a text's distinct words, rising, and how often each occurs."""
    found = words(text)
    return np.unique(np.fromiter(map(xxh3_64_intdigest, found), np.uint64, len(found)), return_counts=True)


def _among(terms: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where in h a term's hash stands, and these terms' numbers."""
    at = np.searchsorted(terms, h)
    at[at == len(terms)] = 0
    there = np.flatnonzero(terms[at] == h) if len(terms) else np.zeros(0, np.int64)
    return there, at[there]


def fold(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def _rows(columns: dict[str, np.ndarray], most: int = 100_000):
    n = len(next(iter(columns.values())))
    for i in range(0, n, most):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + most]) for c in columns.values()], list(columns))


def _association(batches):
    """(text, toxic) to (word, in toxic texts, in others), summed over the partition; words are hashes."""
    found: list[list[np.ndarray]] = [[], []]
    for b in batches:
        for t, y in zip(b.column("text").cast(pa.binary()).to_pylist(), b.column("toxic").to_pylist(), strict=True):
            found[1 if y else 0].append(hashed(t)[0])
    for toxic, hs in enumerate(found):
        if hs:
            h, n = np.unique(np.concatenate(hs), return_counts=True)
            none = np.zeros(len(n), np.int64)
            yield from _rows({"word": h.view(np.int64), "pos": n if toxic else none, "neg": none if toxic else n})


def _frequencies(terms):
    def run(batches):
        known = terms.value
        counts, n = np.zeros(len(known), np.int64), 0
        for b in batches:
            for t in b.column("text").cast(pa.binary()).to_pylist():
                counts[_among(known, hashed(t)[0])[1]] += 1
                n += 1
        at = np.flatnonzero(counts)
        yield from _rows({"term": np.append(at, -1).astype(np.int32), "df": np.append(counts[at], n)})

    return run


def _term_counts(terms):
    def run(batches):
        known = terms.value
        for b in batches:
            found = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                h, n = hashed(t)
                there, at = _among(known, h)
                found.append((at.astype(np.int32), n[there].astype(np.int32)))
            lists = (pa.array([x[i] for x in found], pa.list_(pa.int32())) for i in (0, 1))
            yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.string()), b.column("toxic"), *lists], ["doc_id", "toxic", "terms", "counts"])

    return run


def phi_squared(pos: np.ndarray, neg: np.ndarray, n1: float, n0: float) -> np.ndarray:
    """Chi-squared / N of words that `pos` of n1 toxic and `neg` of n0 other examples have."""
    c, d = n1 - pos, n0 - neg
    of = (pos + neg) * (c + d) * n1 * n0
    return np.divide((pos * d - neg * c) ** 2, of, out=np.zeros(len(pos)), where=of > 0)


def _ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] numbers), then those of first[1], and so on."""
    return np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def weights(counts, idf: np.ndarray) -> np.ndarray:
    """(1 + ln tf) * idf, of unit length."""
    w = (1 + np.log(np.asarray(counts, float))) * idf
    n = math.sqrt(float(w @ w))
    return w / n if n else w


class Index:
    """Inverted lists of (example, weight) by term, cut at block borders, with each block's maxima.

    The lists of the DENSE most frequent terms are held as rows over all
    examples, so that a few queries at a time add them up as one product.
    """

    def __init__(self, rows: list[tuple[list[int], np.ndarray]], n_terms: int, block: int = BLOCK, dense: int = DENSE):
        self.block, self.n = block, len(rows)
        self.n_blocks = -(-self.n // block)
        of = np.concatenate([np.asarray(ts, np.int64) for ts, _ in rows]) if rows else np.zeros(0, np.int64)
        ids = np.repeat(np.arange(self.n, dtype=np.int32), [len(ts) for ts, _ in rows])
        w = np.concatenate([x for _, x in rows]) if rows else np.zeros(0)
        many = np.bincount(of, minlength=n_terms)
        often = np.argsort(-many, kind="stable")[:dense]
        often = often[many[often] > block]
        self.column = np.full(n_terms, -1, np.int32)
        self.column[often] = np.arange(len(often))
        self.table = np.zeros((len(often), self.n_blocks * block))
        there = self.column[of] >= 0
        self.table[self.column[of[there]], ids[there]] = w[there]
        of, ids, w = of[~there], ids[~there], w[~there]
        order = np.lexsort((ids, of))
        of, self.ids, self.w = of[order], ids[order], w[order]
        # a part is a term's entries in one block; only parts that exist are held
        part = of * max(self.n_blocks, 1) + self.ids // block
        first = np.flatnonzero(np.diff(part, prepend=-1)) if len(part) else np.zeros(0, np.int64)
        self.first, self.many = first.astype(np.int32), np.diff(first, append=len(part)).astype(np.int32)
        self.most = np.maximum.reduceat(self.w, first) if len(part) else np.zeros(0)
        self.block_of = self.ids[first] // block
        self.parts = np.searchsorted(of[first], np.arange(n_terms + 1))

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], k: int, but: list[int] | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each query (terms, weights): ids and cosines of the k nearest examples with a positive cosine; ties to the smaller id.

        but: for each query, an example that doesn't count.
        """
        out = []
        for low in range(0, len(queries), TOGETHER):
            some = [(np.asarray(ts, np.int64), w) for ts, w in queries[low : low + TOGETHER]]
            q = np.zeros((len(some), len(self.table)))
            for i, (ts, w) in enumerate(some):
                at = self.column[ts]
                q[i, at[at >= 0]] = w[at >= 0]
            for i, ((ts, w), often) in enumerate(zip(some, q @ self.table, strict=True)):
                if but is not None:
                    often[but[low + i]] = -np.inf
                rare = self.column[ts] < 0
                out.append(self._nearest(ts[rare], w[rare], often, k))
        return out

    def _nearest(self, ts: np.ndarray, w: np.ndarray, often: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """often: what the frequent terms add up to for each example."""
        if not self.n:
            return np.zeros(0, np.int64), np.zeros(0)
        n = self.parts[ts + 1] - self.parts[ts]
        parts, x = _ranges(self.parts[ts], n), np.repeat(w, n)
        blocks = self.block_of[parts]
        bounds = np.bincount(blocks, x * self.most[parts], self.n_blocks) + often.reshape(self.n_blocks, self.block).max(1)
        visit = np.zeros(self.n_blocks, bool)
        visit[np.argsort(-bounds, kind="stable")[:AT_FIRST]] = True
        acc = self._sums(parts, x, blocks, often, visit)
        more = ~visit & (bounds > 0)
        if self.n > k:
            more &= bounds >= np.partition(acc, len(acc) - k)[len(acc) - k] - 1e-9
        if more.any():
            acc = np.maximum(acc, self._sums(parts, x, blocks, often, more))
        acc = np.round(acc, 12)
        hit = np.flatnonzero(acc > 0)
        if len(hit) > k:
            hit = hit[acc[hit] >= np.partition(acc[hit], len(hit) - k)[len(hit) - k]]
        top = hit[np.lexsort((hit, -acc[hit]))[:k]]
        return top, acc[top]

    def _sums(self, parts: np.ndarray, x: np.ndarray, blocks: np.ndarray, often: np.ndarray, visit: np.ndarray) -> np.ndarray:
        """Cosines of the examples in the blocks to visit; none elsewhere."""
        which = visit[blocks]
        parts, x = parts[which], x[which]
        n = self.many[parts]
        at = _ranges(self.first[parts].astype(np.int64), n)
        acc = np.bincount(self.ids[at], np.repeat(x, n) * self.w[at], len(often)) + often
        return np.where(np.repeat(visit, self.block), acc, -np.inf)


def isotonic(votes: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Steps (from vote, value), rising; equal votes are pooled first."""
    u, at, n = np.unique(votes, return_inverse=True, return_counts=True)
    means = np.bincount(at, y) / n
    stack: list[list[float]] = []
    for v, m, c in zip(u.tolist(), means.tolist(), n.tolist(), strict=True):
        stack.append([v, m, c])
        while len(stack) > 1 and stack[-2][1] >= stack[-1][1]:
            _, m2, c2 = stack.pop()
            v1, m1, c1 = stack.pop()
            stack.append([v1, (m1 * c1 + m2 * c2) / (c1 + c2), c1 + c2])
    return np.array([s[0] for s in stack]), np.array([s[1] for s in stack])


class Model:
    def __init__(self, terms: np.ndarray, df: np.ndarray, n_docs: int, told: np.ndarray, examples: list[tuple[str, int, np.ndarray, np.ndarray]]):
        """terms: their hashes, rising; told: each term's phi-squared; examples: (doc_id, label, term numbers, counts), in their fixed order."""
        self.terms = terms
        self.idf = np.log((n_docs + 1) / (np.asarray(df, float) + 1)) * told
        self.base = float(np.mean([y for _, y, _, _ in examples])) if examples else 0.0
        # like examples share blocks, so that block maxima are near the weights
        rank = np.argsort(np.argsort(-self.idf, kind="stable"))
        full = sorted((x for x in examples if len(x[2])), key=lambda x: (np.sort(rank[x[2]])[:8].tolist(), x[0]))
        self.names, self.labels = [x[0] for x in full], np.array([x[1] for x in full], float)
        rows = [(ts, weights(c, self.idf[ts])) for _, _, ts, c in full]
        self.index = Index(rows, len(terms))
        votes = [self._vote(*x) for x in self.index.nearest(rows, NEIGHBOURS, but=list(range(len(rows))))]
        rest = [(self._vote(np.zeros(0, np.int64), np.zeros(0)), x[1]) for x in examples if not len(x[2])]
        every = np.array(votes + [v for v, _ in rest]), np.concatenate((self.labels, [float(y) for _, y in rest]))
        self.steps = isotonic(*every) if examples else (np.zeros(1), np.zeros(1))
        self.known: dict = {}

    def _vote(self, ids: np.ndarray, scores: np.ndarray) -> float:
        return round((float((scores * self.labels[ids]).sum()) + PRIOR_WEIGHT * self.base) / (float(scores.sum()) + PRIOR_WEIGHT), 12)

    def scores(self, texts: list[bytes | None]) -> list[tuple[float, str]]:
        """The calibrated scores, and as evidence the three nearest examples as doc_id:cosine:label."""
        keys = [hashlib.blake2b(t or b"", digest_size=16).digest() for t in texts]
        new = {k: t for k, t in zip(keys, texts, strict=True) if k not in self.known}
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = dict(zip(keys, texts, strict=True))
        queries = [self._query(t) for t in new.values()]
        for k, (ids, cos) in zip(new, self.index.nearest(queries, NEIGHBOURS), strict=True):
            at = max(0, int(np.searchsorted(self.steps[0], self._vote(ids, cos), side="right")) - 1)
            said = ",".join(f"{self.names[i]}:{c:.4f}:{int(self.labels[i])}" for i, c in zip(ids[:3].tolist(), cos[:3].tolist(), strict=True))
            self.known[k] = (float(self.steps[1][at]), said)
        return [self.known[k] for k in keys]

    def _query(self, text: bytes | None) -> tuple[np.ndarray, np.ndarray]:
        h, n = hashed(text)
        there, ts = _among(self.terms, h)
        return ts, weights(n[there], self.idf[ts])


def fit(docs: DataFrame, labels: DataFrame, most: int = EXAMPLES) -> Model:
    """The model, on the driver: at most `most` examples, and only their terms, are gathered there."""
    usable = labels.filter("doc_id is not null and toxic is not null").filter(fold(F.col("doc_id")) != 2)
    usable = usable.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    flat = docs.select("doc_id", F.col("text").cast("string"))
    # one text for each doc_id, so that the bound holds for rows as well
    examples = flat.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))
    examples = stage(examples, "toxicity-examples")
    words_of = examples.select("text", "toxic").mapInArrow(_association, "word long, pos long, neg long")
    words_of = words_of.groupBy("word").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    sizes = {r["toxic"]: r["n"] for r in examples.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = float(sizes.get(1, 0)), float(sizes.get(0, 0))
    if not n1 or not n0:
        return Model(np.zeros(0, np.uint64), np.zeros(0), 0, np.zeros(0), [("", int(n1 > 0), np.zeros(0, np.int32), np.zeros(0, np.int32))])
    found = words_of.toArrow()
    terms = found["word"].to_numpy().view(np.uint64)
    order = np.argsort(terms)
    terms = terms[order]
    told = phi_squared(found["pos"].to_numpy()[order].astype(float), found["neg"].to_numpy()[order].astype(float), n1, n0)
    known = docs.sparkSession.sparkContext.broadcast(terms)
    counted = flat.select("text").mapInArrow(_frequencies(known), "term int, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    at, n = counted["term"].to_numpy(), counted["df"].to_numpy()
    df = np.zeros(len(terms))
    df[at[at >= 0]] = n[at >= 0]
    rows = examples.mapInArrow(_term_counts(known), "doc_id string, toxic int, terms array<int>, counts array<int>").toArrow()
    known.unpersist()
    lists = ([x.values.to_numpy() for x in rows[c]] for c in ("terms", "counts"))
    found = list(zip(rows["doc_id"].to_pylist(), rows["toxic"].to_pylist(), *lists, strict=True))
    found.sort(key=lambda r: r[0])  # each doc_id once
    return Model(terms, df, int(n[at < 0].sum()), told, found)


def _scored(model, keep: bool):
    def run(batches):
        m = model.value
        for b in batches:
            found = m.scores(b.column("text").cast(pa.binary()).to_pylist())
            if keep:
                yield b.filter(pa.array([s < CUT for s, _ in found], pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("held_out"), pa.array([s for s, _ in found], pa.float64()), pa.array([int(s >= CUT) for s, _ in found], pa.int32()), pa.array([e for _, e in found], pa.string())],
                    ["doc_id", "held_out", "score", "predicted", "evidence"],
                )

    return run


def score(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted, evidence. The index goes to workers: its size is bounded by the examples."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    flat = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), F.col("text").cast("string"))
    kind = flat.schema["doc_id"].dataType.simpleString()
    return flat.mapInArrow(_scored(model, False), f"doc_id {kind}, held_out boolean, score double, predicted int, evidence string")


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without those predicted toxic."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))
    return docs.mapInArrow(_scored(model, True), docs.schema)
