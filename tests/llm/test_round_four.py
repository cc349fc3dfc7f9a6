"""Sentence pieces: nothing travels, the lattice against brute force, texts cut in windows, invalid bytes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import pieces

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def model():
    return pieces.model()


def best_ids(part, known, m):
    best = [(0.0, 0, 0)] + [None] * len(part)
    for e in range(1, len(part) + 1):
        for s in range(max(0, e - m.longest), e):
            found = known.get(part[s:e])
            if found is None and e - s > 1:
                continue
            i, c = found or (-1, m.unknown)
            if best[e] is None or best[s][0] + c > best[e][0]:
                best[e] = (best[s][0] + c, s, i)
    out, at = [], len(part)
    while at:
        _, s, i = best[at]
        out += [i] if i >= 0 else [m.byte0 + b for b in reversed(part[s:at].encode())]
        at = s
    return out[::-1]


def texts():
    rng = random.Random(7)
    alphabet = "abcdefghiethanions  ,.\n\t▁é日\U0001f600\x00"
    found = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(400)]
    return found + ["", " ", "  ", "a" * 9000, "x▁y", "  two  spaces ", "é" * 5000 + " tail", "日本語のテキスト", "one two " * 40]


def want(rows, m):
    known, cutter = {p: (i, c) for p, i, c in m.rows}, pieces.Cutter(m.joints)
    return [np.array([i for p in cutter.parts(t) for i in best_ids(p, known, m)], np.int32).tobytes() for t in rows]


@pytest.mark.parametrize("window, most", [(1_000_000, 100_000), (4500, 2)])
def test_lattice(model, monkeypatch, window, most):
    monkeypatch.setattr(pieces, "WINDOW", window)
    monkeypatch.setattr(pieces, "CELLS", 20 * window)
    coder, rows = pieces.Coder(model, most, most), texts()
    for _ in range(2):
        assert coder.encode(rows) == want(rows, model)
        assert len(coder.words) <= most and max(map(len, [*coder.words, *coder.parts, ""])) <= pieces.SHORT
    assert coder.encode([]) == [] and coder.encode([""]) == [b""]


def test_pieces_of_a_text_longer_than_windows(model, monkeypatch):
    monkeypatch.setattr(pieces, "WINDOW", 5000)
    for text in ("foo, bar  baz " * 4000, "z" * 20_000 + " q", "a" * 4998 + "  b" * 3000, "é日" * 7000):
        assert [p for ps in pieces.Cutter(model.joints).windows(text) for p in ps] == pieces.Cutter(model.joints).parts(text)
        assert pieces.Coder(model, 10, 10).encode([text, "and more"]) == want([text, "and more"], model)


def test_texts_do_not_travel(spark, model):
    docs = spark.createDataFrame([(i, f"word{i} and more words") for i in range(50)], DOCS)
    for df in (pieces.summary(docs, model), pieces.encode(docs, model)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
        assert df.count() == 50


def test_pieces_of_invalid_bytes(spark, model):
    docs = spark.createDataFrame([(1, bytearray(b"caf\xe9 au lait")), (2, bytearray("café au lait".encode()))], "doc_id long, text binary")
    docs = docs.withColumn("text", F.col("text").cast("string"))
    assert {r.doc_id: r.round_trip for r in pieces.summary(docs, model).collect()} == {1: False, 2: True}
    ids = {r.doc_id: r.ids for r in pieces.encode(docs, model).select("doc_id", "ids").collect()}
    assert [np.array(ids[i], np.int32).tobytes() for i in (1, 2)] == want(["caf� au lait", "café au lait"], model)
