"""Greedy word-piece token counts by a linear longest-match automaton.

The vocabulary's pieces form a trie with failure links. Each node also has the
number of tokens that following its link completes, worked out beforehand, so
a word is counted in one pass over its characters: no piece is built, and no
character is read twice. Counts equal those of greedy longest match from the
left; a word that no sequence of greedy pieces covers counts as one unknown
token.

Words are runs of characters other than \\x20 and \\x09-\\x0D. A piece with the
word mark begins a word, any other continues one; where no longer piece begins
the word, the bare mark is a token by itself, if the vocabulary has it.

Defined results: null and blank texts have no words and no tokens; repeated
rows give equal results; other columns are ignored.
"""

from __future__ import annotations

from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Words remembered by a worker; the memory is emptied when full.
REMEMBERED = 300_000


def load_pieces(path: str = MODEL) -> list[str]:
    """The vocabulary's ordinary pieces; read on the driver only."""
    import sentencepiece

    p = sentencepiece.SentencePieceProcessor(model_file=path)
    return [p.id_to_piece(i) for i in range(p.get_piece_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))]


class Automaton:
    """Node 0 begins a word, node 1 continues one; `link` is -1 where nothing can follow."""

    def __init__(self, pieces: list[str], mark: str = MARK):
        self.next: list[dict[str, int]] = [{}, {}]
        ends = {}
        for piece in pieces:
            at, rest = (0, piece[len(mark) :]) if piece.startswith(mark) else (1, piece)
            for c in rest:
                at = self._child(at, c)
            ends[at] = True
        self.link = [-1] * len(self.next)
        self.popped = [0] * len(self.next)
        if 0 in ends:
            self.link[0], self.popped[0] = 1, 1
        todo = deque((root, c, v) for root in (0, 1) for c, v in self.next[root].items())
        while todo:
            u, c, v = todo.popleft()
            if v in ends:
                self.link[v], self.popped[v] = 1, 1
            else:
                z, n = self.link[u], self.popped[u]
                while z != -1 and c not in self.next[z]:
                    n += self.popped[z]
                    z = self.link[z]
                if z != -1:
                    self.link[v], self.popped[v] = self.next[z][c], n
            todo.extend((v, d, w) for d, w in self.next[v].items())

    def _child(self, at: int, c: str) -> int:
        to = self.next[at].get(c)
        if to is None:
            to = self.next[at][c] = len(self.next)
            self.next.append({})
        return to

    def count(self, word: str) -> int:
        """Tokens of a word, 0 if greedy matching fails."""
        if not word:
            return 0
        nxt, link, popped = self.next, self.link, self.popped
        at = n = 0
        for c in word:
            to = nxt[at].get(c)
            while to is None:
                if link[at] == -1:
                    return 0
                n += popped[at]
                at = link[at]
                to = nxt[at].get(c)
            at = to
        while at != 1:
            if link[at] == -1:
                return 0
            n += popped[at]
            at = link[at]
        return n


class _Memory(dict):
    """Counts of words (bytes), unknown ones as -1."""

    def __init__(self, automaton: Automaton):
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[word] = self.automaton.count(word.decode("utf-8", "replace")) or -1
        return n


_MADE: dict[tuple, _Memory] = {}


def _memory(pieces: tuple[str, ...], mark: str) -> _Memory:
    """One automaton for each worker process and vocabulary."""
    key = (len(pieces), hash(pieces), mark)
    if key not in _MADE:
        _MADE.clear()
        _MADE[key] = _Memory(Automaton(list(pieces), mark))
    return _MADE[key]


def token_counts(docs: DataFrame, pieces: list[str] | None = None, mark: str = MARK) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown. No shuffle."""
    pieces = tuple(load_pieces() if pieces is None else pieces)

    def run(batches):
        known = _memory(pieces, mark)
        look = known.__getitem__
        for b in batches:
            rows = []
            for t in b.column("text").cast(pa.binary()).to_pylist():
                words = t.split() if t else []
                counts = list(map(look, words))
                unknown = counts.count(-1)
                rows.append((len(words), sum(counts) + 2 * unknown, unknown))
            cols = list(zip(*rows, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), *(pa.array(c, pa.int64()) for c in cols)], ["doc_id", "n_words", "n_tokens", "n_unknown"]
            )

    flat = docs.select("doc_id", F.col("text").cast("string"))
    kind = flat.schema["doc_id"].dataType.simpleString()
    return flat.mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, n_unknown long")


def op2(docs: DataFrame) -> DataFrame:
    return token_counts(docs)
