"""SentencePiece encoding and decoding by a relational lattice.

A text is marked as SentencePiece does (a mark before it and for each space)
and parted between two characters that never stand side by side in a piece, as
no piece can cross there; words come apart by this rule, and so does most
punctuation. A task puts the distinct words of a stretch of its texts through
the lattice together, as columns:

1. substrings are exploded from each place, a character longer at each step,
2. and equi-joined to the piece table's prefixes, which leaves the edges,
3. edges are grouped by their end, a column for each length,
4. and folded in order of their ends into the best score and last edge for each
   place, of all words at once, from which the paths are read back; scores
   begin anew with each part.

This is the best segmentation by the sum of scores, as SentencePiece decodes
unigram models. A model file of BPE type has ranks for scores, and merges
cannot be replayed by such a sum; ranks become log probabilities by Zipf's
law, -ln(rank + RANK_SHIFT) - RANK_COST. Ids then differ from the library's
merges on some words (measured in the README); decoding gives the same text.
Of paths with equal scores, the one whose last edge starts earlier holds. A character without a piece is an unknown edge and
becomes its UTF-8 bytes' pieces, so decoding always gives the text back.

Texts don't travel: a task reads its rows, and the only table that all tasks
have is the vocabulary, which has a fixed size (a broadcast). A text holds few
rare words and many frequent ones, so a worker remembers WORDS words that it
has met (of texts that are cut whole, HOT parts); when it has more, it keeps the
latest texts' alone. That decides only how often a word goes through the lattice.

Defined results: null and empty texts have no pieces; equal texts get equal
pieces; a part without joints longer than LONGEST characters is cut into parts
of this length; a text that holds the mark itself decodes to a space there, and
its round_trip is false; bytes that aren't UTF-8 are encoded as U+FFFD, and
round_trip is false; other columns are ignored by `summary` and kept by
`encode`, but for one named ids, which is replaced.
"""

from __future__ import annotations

import ctypes
import hashlib
import math
import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

from quire.llm.tokens import MARK, MODEL

#: Parts and words that a worker remembers; of SHORT characters at most.
HOT, WORDS, SHORT = 100_000, 300_000, 64
#: Characters in a part, at most.
LONGEST = 4096
#: Bytes of texts that a worker encodes at a time, characters of a text cut whole at a time, and cells (places by lengths) of a lattice.
SLICE, WINDOW, CELLS = 8_000_000, 1_000_000, 4_000_000
UNKNOWN_PENALTY, RANK_SHIFT, RANK_COST = 10.0, 10.0, 5.0


@lru_cache(maxsize=4)
def load_model(path: str = MODEL) -> tuple[tuple[str, ...], tuple[float, ...], tuple[bool, ...], int]:
    """(surfaces by id, scores, whether an id is an ordinary piece, id of byte 0); read on the driver only."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    ordinary = tuple(not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i)) for i in range(n))
    return tuple(p.id_to_piece(i) for i in range(n)), tuple(p.get_score(i) for i in range(n)), ordinary, p.piece_to_id("<0x00>")


class Model:
    """surfaces, scores: by id; byte0: the id of the piece of byte 0, the others follow.

    Scores that are all whole numbers are ranks below zero.
    """

    def __init__(self, surfaces, scores, ordinary, byte0: int):
        self.surfaces, self.ordinary, self.byte0 = surfaces, ordinary, byte0
        rows = [(s, i, c) for i, (s, c, o) in enumerate(zip(surfaces, scores, ordinary, strict=True)) if o]
        if all(c <= 0 and c == int(c) for _, _, c in rows):
            rows = [(s, i, -math.log(RANK_SHIFT - c) - RANK_COST) for s, i, c in rows]
        self.rows = rows
        self.longest = max(len(s) for s, _, _ in rows)
        self.unknown = min(c for _, _, c in rows) - UNKNOWN_PENALTY
        self.joints = frozenset(a + b for s, _, _ in rows for a, b in zip(s, s[1:], strict=False))

    def name(self) -> str:
        """The same for models that encode alike."""
        return hashlib.sha256(repr((self.rows, self.byte0)).encode()).hexdigest()


def model(path: str = MODEL) -> Model:
    return Model(*load_model(path))


class Cutter:
    """Parts texts between characters that no piece has side by side; all characters of a text at once."""

    #: Codes of no character, one of which a text won't have, and one that it can't.
    BREAKS = "\uffff\ufffe\ufdd0\ufdd1\ud800"
    #: Marks that stand together, and what is behind them up to the next.
    RUNS = re.compile(f"{MARK}+[^{MARK}]*")

    def __init__(self, joints: frozenset[str]):
        chars = sorted({c for two in joints for c in two})
        self.ids = np.zeros(0x110000, np.int16)
        self.ids[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n = len(chars) + 1
        self.fine = np.zeros(self.n * self.n, bool)
        self.fine[[int(self.ids[ord(a)]) * self.n + int(self.ids[ord(b)]) for a, b in joints]] = True
        #: whether a mark always begins a part, unless another mark stands before it
        self.by_words = not any(b == MARK and a != MARK for a, b in joints)

    def parts(self, text: str | None) -> list[str]:
        """The marked text's parts in order; joined, they are the marked text."""
        if not text:
            return []
        return self.cut(MARK + text.replace(" ", MARK))

    def words(self, text: str) -> str | None:
        """The text's words, with a space between them; each is cut by itself with a mark before it. None where the text has to be cut whole."""
        if len(text) > WINDOW or not self.by_words:
            return None
        if text[0] == " " or "  " in text or MARK in text:
            text = " ".join([w[1:] for w in self.RUNS.findall(MARK + text.replace(" ", MARK))])
        return text if len(text) < LONGEST or max(map(len, text.split(" "))) < LONGEST else None

    def windows(self, text: str):
        """The text's parts, some of about WINDOW characters at a time."""
        marked, low = MARK + text.replace(" ", MARK), 0
        while True:
            found = self.cut(marked[low : low + WINDOW])
            if low + WINDOW >= len(marked):
                yield found
                return
            last = found.pop()  # may go on; of a part cut at LONGEST, the next cuts are the same from here
            low += min(WINDOW, len(marked) - low) - len(last)
            yield found

    def apart(self, u: np.ndarray) -> np.ndarray:
        """Of each character but the last, whether a part ends behind it."""
        i = self.ids[u].astype(np.int32)
        return ~self.fine[i[:-1] * self.n + i[1:]]

    def cut(self, marked: str) -> list[str]:
        apart_by = next(c for c in self.BREAKS if c not in marked)
        how = "surrogatepass" if apart_by == self.BREAKS[-1] else "strict"
        u = np.frombuffer(marked.encode("utf-32-le", how), np.uint32)
        at = np.flatnonzero(self.apart(u)) + 1
        ends = np.append(at, len(u))
        lengths = np.diff(ends, prepend=0)
        if int(lengths.max()) > LONGEST:
            more = [np.arange(e - n + LONGEST, e, LONGEST) for e, n in zip(ends.tolist(), lengths.tolist(), strict=True) if n > LONGEST]
            at = np.sort(np.concatenate((at, *more)))
        return np.insert(u, at, ord(apart_by)).tobytes().decode("utf-32-le", how).split(apart_by)


class Lattice:
    """The piece table by its prefixes, and the best paths of many words at once.

    A prefix is a row (longer prefix's number by the shorter one's and a
    character); those that are pieces have an id and a score.
    """

    def __init__(self, m: Model, cutter: Cutter):
        self.unknown, self.byte0, self.longest, self.cutter = m.unknown, m.byte0, m.longest, cutter
        rows = m.rows
        chars = sorted({c for p, _, _ in rows for c in p})
        self.chars = np.zeros(0x110000, np.int32)
        self.chars[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.n = len(chars) + 1
        known = {c: i + 1 for i, c in enumerate(chars)}
        longer: dict[int, int] = {}
        ends = []
        for p, _, _ in rows:
            at = 0
            for c in p:
                at = longer.setdefault(at * self.n + known[c], len(longer) + 1)
            ends.append(at)
        keys, to = (np.fromiter(x, np.int64, len(longer)) for x in (longer.keys(), longer.values()))
        order = np.argsort(keys)
        self.keys, self.to = keys[order], to[order]
        self.first = np.zeros(self.n, np.int64)
        self.first[self.keys[self.keys < self.n]] = self.to[self.keys < self.n]
        self.ids, self.scores = np.full(len(longer) + 1, -1, np.int32), np.zeros(len(longer) + 1)
        self.ids[ends], self.scores[ends] = [i for _, i, _ in rows], [c for _, _, c in rows]

    def join(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys the prefix table has, and the prefixes of these."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        fine = np.flatnonzero(self.keys[at] == key)
        return fine, self.to[at[fine]]

    def edges(self, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids by end and longest - length; -inf where there is no edge. u: characters, 0 behind each word."""
        wide = self.longest
        score, ids = np.full((len(u), wide), -np.inf), np.full((len(u), wide), -1, np.int32)
        # an unknown edge stands only where no single character's piece does
        score[:, -1] = self.unknown
        start = np.flatnonzero(self.first[u])
        prefix = self.first[u[start]]
        for length in range(1, wide + 1):
            if length > 1:
                found, prefix = self.join(prefix * self.n + u[start + length - 1])
                start = start[found]
            end, piece = start[self.ids[prefix] >= 0] + length, prefix[self.ids[prefix] >= 0]
            score[end, wide - length], ids[end, wide - length] = self.scores[piece], self.ids[piece]
        return score, ids

    def paths(self, words: list[str]) -> dict[str, bytes]:
        """The packed ids of each word's best path. No part in them is longer than LONGEST."""
        words, out, low = sorted(words, key=len, reverse=True), {}, 0
        while low < len(words):
            high = low + max(1, CELLS // self.longest // (len(words[low]) + 1))
            out.update(self._paths(words[low:high]))
            low = high
        return out

    def _paths(self, words: list[str]):
        codes = np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words))
        ends = np.cumsum(size + 1) - 1
        begins, wide = ends - size, self.longest
        u = self.chars[codes]
        u[ends] = 0
        score, ids = self.edges(u)
        go_on = np.ones(len(u))
        go_on[1:-1] = ~self.cutter.apart(codes[:-1])
        best, last, columns = np.zeros(wide + len(u)), np.zeros(len(u), np.int64), np.arange(wide)
        # longer words come first, so those with a character at a place do; of equal sums the first holds, which is the longest edge's
        reach = len(words) - np.searchsorted(size[::-1], np.arange(1, size[0] + 1))
        for place, n in enumerate(reach.tolist(), 1):
            e = begins[:n] + place
            sums = best[e[:, None] + columns] + score[e]
            chosen = sums.argmax(1)
            best[e + wide], last[e] = sums[np.arange(n), chosen] * go_on[e], wide - chosen
        on = np.zeros(len(u), bool)
        e, b = ends, begins
        while len(e):
            on[e] = True
            e = e - last[e]
            e, b = e[e > b], b[e > b]
        e = np.flatnonzero(on)
        got = ids[e, wide - last[e]]
        # an unknown character is its bytes
        c = np.where(got < 0, codes[e - 1], 0)
        n = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
        flat = np.repeat(got, n)
        unknown = codes[e - 1][got < 0].tobytes().decode("utf-32-le").encode()
        flat[flat < 0] = np.frombuffer(unknown, np.uint8).astype(np.int32) + self.byte0
        upto = np.concatenate(([0], np.cumsum(n)))[np.searchsorted(e, ends, "right")] * 4
        packed = flat.tobytes()
        return zip(words, (packed[i:j] for i, j in zip([0, *upto.tolist()], upto.tolist(), strict=False)), strict=True)


class Coder:
    """Texts to packed ids; remembers words and parts between texts."""

    def __init__(self, m: Model, hot: int, most: int):
        self.cutter = Cutter(m.joints)
        self.lattice, self.surfaces = Lattice(m, self.cutter), surfaces(m)
        self.parts, self.words = _Known(self.lattice, hot), _Known(self.lattice, most, MARK)

    def whole(self, text: str) -> bytes:
        """The ids of a text that is cut whole."""
        return b"".join([b"".join(self.parts.ids(parts)) for parts in self.cutter.windows(text)])

    def encode(self, texts: list[str]) -> list[bytes]:
        words = pa.array([self.cutter.words(t) if t else None for t in texts], pa.string())
        split = pc.split_pattern(words, " ")
        met = split.flatten().dictionary_encode()
        ids = pa.array(self.words.ids(met.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(met.indices)
        at = np.concatenate(([0], np.cumsum(split.value_lengths().fill_null(0).to_numpy(), dtype=np.int64)))
        found = _parted(ids, at)
        return [self.whole(t) if t and not w else x for t, w, x in zip(texts, words.is_valid().to_pylist(), found, strict=True)]


class _Known(dict):
    """Packed ids of words or parts; at most `most` stay, the latest ones where there are more, and no long ones."""

    def __init__(self, lattice: Lattice, most: int, before: str = ""):
        super().__init__()
        self.lattice, self.most, self.before = lattice, most, before

    def ids(self, words: list[str]) -> list[bytes]:
        new = list(dict.fromkeys(w for w in words if w not in self))
        marked = [self.before + w for w in new]
        self.update(zip(new, map(self.lattice.paths(marked).__getitem__, marked), strict=True))
        ids = [self[w] for w in words]
        if len(self) > self.most:
            self.clear()
            self.update((w, x) for w, x in zip(words[: self.most], ids, strict=False) if len(w) <= SHORT)
        else:
            for w in new:
                if len(w) > SHORT:
                    del self[w]
        return ids


def _parted(values: pa.LargeBinaryArray, at: np.ndarray) -> list[bytes]:
    """The values from each place to the next, as one each."""
    offsets = np.frombuffer(values.buffers()[1], np.int64)[values.offset :] if len(values) else np.zeros(1, np.int64)
    data, upto = values.buffers()[2], offsets[at].tolist()
    data = data.to_pybytes() if data else b""
    return [data[i:j] for i, j in zip(upto, upto[1:], strict=False)]


_CODERS: dict[tuple, Coder] = {}


def _coder(name: str, m, hot: int, most: int) -> Coder:
    """One for each worker process and model."""
    key = (name, hot, most)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(m.value, hot, most)
    return _CODERS[key]


def surfaces(m: Model) -> pa.LargeBinaryArray:
    """Of each id, the bytes that it stands for; of control ids, none."""
    out = []
    for i, s in enumerate(m.surfaces):
        byte = m.byte0 <= i < m.byte0 + 256
        out.append(bytes([i - m.byte0]) if byte else s.encode() if m.ordinary[i] else b"")
    return pa.array(out, pa.large_binary())


def decoded(ids: np.ndarray, sizes: np.ndarray, out: pa.LargeBinaryArray) -> list[bytes]:
    """The texts of lists of ids, given one after the other, by their sizes."""
    at = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    return [x.replace(MARK.encode(), b" ").removeprefix(b" ") for x in _parted(out.take(pa.array(ids)), at)]


def decode(encoded: DataFrame, m: Model | None = None, column: str = "ids", to: str = "text") -> DataFrame:
    """encoded with the text of its ids in a further column; null ids give null."""
    out = surfaces(m or model())
    names = [c for c in encoded.columns if c != to]

    def run(batches):
        for b in batches:
            lists = b.column(column)
            sizes = lists.value_lengths().fill_null(0).to_numpy()
            texts = decoded(lists.flatten().to_numpy(zero_copy_only=False), sizes, out)
            texts = [t.decode("utf-8", "replace") if x else None for t, x in zip(texts, lists.is_valid().to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(texts, pa.string())], [*names, to])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(names).schema.fields)
    return encoded.select(names).mapInArrow(run, f"{schema}, `{to}` string")


def _slices(batches):
    """(rows, their texts as bytes), of about SLICE bytes."""
    for b in batches:
        texts = b.column("text").cast(pa.binary())
        to = np.cumsum(pc.binary_length(texts).fill_null(0).to_numpy(), dtype=np.int64) // SLICE
        bounds = [0, *(np.flatnonzero(np.diff(to)) + 1).tolist(), b.num_rows]
        for low, high in zip(bounds, bounds[1:], strict=False):
            yield b.slice(low, high - low), texts.slice(low, high - low).to_pylist()
    # idle workers stay beside later stages, so what they have freed goes back to the system where the C library can do that
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def _coded(docs: DataFrame, m: Model, finish, schema) -> DataFrame:
    """finish(rows, texts, ids, coder) of docs' rows, which are read once and don't travel."""
    shared, name, hot, most = docs.sparkSession.sparkContext.broadcast(m), m.name(), HOT, WORDS

    def run(batches):
        coder = _coder(name, shared, hot, most)
        for b, texts in _slices(batches):
            yield finish(b, texts, coder.encode([(t or b"").decode("utf-8", "replace") for t in texts]), coder)

    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, m: Model | None = None) -> DataFrame:
    """docs with `ids`, the piece ids of the text."""
    docs = docs.drop("ids").withColumn("text", F.col("text").cast("string"))

    def finish(b, texts, ids, coder):
        upto = np.cumsum([0, *map(len, ids)]) // 4
        return b.append_column("ids", pa.ListArray.from_arrays(pa.array(upto, pa.int32()), pa.array(np.frombuffer(b"".join(ids), np.int32))))

    return _coded(docs, m or model(), finish, StructType([*docs.schema.fields, StructField("ids", ArrayType(IntegerType()))]))


def summary(docs: DataFrame, m: Model | None = None) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, round_trip of every text's encoding.

    ids_crc32: of the ids as 32-bit little-endian numbers. round_trip: whether
    decoding the ids gives the text (null: the empty one).
    """
    docs = docs.select("doc_id", F.col("text").cast("string"))

    def finish(b, texts, ids, coder):
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        back = decoded(np.frombuffer(b"".join(ids), np.int32), sizes, coder.surfaces)
        fine = [x == (t or b"") for t, x in zip(texts, back, strict=True)]
        cols = [pa.array(sizes), pa.array(list(map(zlib.crc32, ids)), pa.int64()), pa.array(fine, pa.bool_())]
        return pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], ["doc_id", "n_pieces", "ids_crc32", "round_trip"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return _coded(docs, m or model(), finish, f"doc_id {kind}, n_pieces long, ids_crc32 long, round_trip boolean")


def op8(docs: DataFrame) -> DataFrame:
    return summary(docs)
