"""Findings of the fourth round on the engine's own queries: what travels doesn't grow with pairs, copies or splits."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quire.operators import ranges, segments, shapes
from quire.plans import documents
from quire.sources import records


def most(df, name, metric):
    """The greatest metric of the nodes called so in df's plan, once df has run."""
    def below(node):
        inner = [getattr(node, n)() for n, kind in (("executedPlan", "AdaptiveSparkPlanExec"), ("plan", "QueryStageExec")) if node.getClass().getSimpleName().endswith(kind)]
        for n in inner or [node.children().apply(i) for i in range(node.children().size())]:
            yield from below(n)
        if name in node.nodeName() and node.metrics().contains(metric):
            yield node.metrics().apply(metric).value()

    return max(below(df._jdf.queryExecution().executedPlan()), default=0)


def test_values_in_many_ranges(spark):
    """of 2000 ranges around each other every value meets a few, not all that hold it."""
    n = 2000
    spans = spark.range(n).select(F.lit("f").alias("font"), F.col("id").alias("first"), (2 * n - F.col("id")).alias("last"), F.when(F.col("id") % 2 == 0, F.col("id")).otherwise(-F.col("id")).alias("ord"))
    values = spark.range(-5, 2 * n + 5).select(F.lit("f").alias("font"), F.col("id").alias("code"))
    found = ranges.look_up(values, spans, ["font"], "code", "first", "last", "ord")
    got = {r.code: r.found and r.found["ord"] for r in found.collect()}
    inner = lambda c: min(c, 2 * n - c, n - 1)  # noqa: E731  the innermost range that holds c
    assert got == {c: None if inner(c) < 0 else inner(c) // 2 * 2 for c in range(-5, 2 * n + 5)}
    assert most(found, "Join", "numOutputRows") < 20 * n


@pytest.mark.parametrize("low, high", [(-9, 300), (2**63 - 300, 2**63 - 1), (-(2**63), -(2**63) + 300)])
def test_ranges_at_all_ends(spark, low, high):
    """blocks take up their range and nothing else, at the ends of what a long holds too."""
    rng = random.Random(low)
    spans = [(*sorted((rng.randint(low, high), rng.randint(low, high))), i) for i in range(60)] + [(low, high, -1)]
    values = spark.createDataFrame([(c,) for c in range(low, high + 1)], "code long")
    found = ranges.look_up(values, spark.createDataFrame(spans, "first long, last long, ord int"), [], "code", "first", "last", "ord")
    assert {r.code: r.found["ord"] for r in found.collect()} == {c: max(o for a, b, o in spans if a <= c <= b) for c in range(low, high + 1)}


def test_many_ranges_are_not_broadcast(spark, monkeypatch):
    """large tables of ranges don't go through the driver, however few bytes their files have."""
    monkeypatch.setattr(ranges, "SMALL", 5, raising=False)
    spans = spark.range(50).select("id", (F.col("id") * 3).alias("first"), (F.col("id") * 3 + 4).alias("last"))
    found = ranges.look_up(spark.range(160).select(F.col("id").alias("code")), spans, [], "code", "first", "last", "id")
    assert {r.code: r.found and r.found["id"] for r in found.collect()} == {c: min(c // 3, 49) if c <= 151 else None for c in range(160)}
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("dense", [50, 10**6])
def test_points_in_many_shapes(spark, monkeypatch, dense):
    """what a point has of a shape is summed where point and edges met; pairs don't travel, and a full cell is several tasks'."""
    monkeypatch.setattr(shapes, "DENSE", dense, raising=False)
    monkeypatch.setattr(shapes, "TASK", 20_000, raising=False)
    squares = [(s, i, x, y) for s in range(40) for i, (x, y) in enumerate([(s % 5, 0), (30, s % 7), (31, 30), (1, 31)])]
    points = [(i, i % 33, i // 33 % 33) for i in range(1089)] + [(2000 + i, 9, 9) for i in range(300)]
    edges = shapes.closed(spark.createDataFrame(squares, "s int, i int, x int, y int"), ["s"], [], "i")
    found = shapes.winding(spark.createDataFrame(points, "i int, x int, y int"), edges, [], ["s"], 8)
    want = []
    for s in range(40):
        c = [(x, y) for t, _, x, y in squares if t == s]
        for i, px, py in points:
            n = 0
            for (x0, y0), (x1, y1) in zip(c, c[1:] + c[:1], strict=True):
                side = (x1 - x0) * (py - y0) - (px - x0) * (y1 - y0)
                n += (y0 <= py < y1 and side > 0) - (y1 <= py < y0 and side < 0)
            want += [(i, s, n)] if n else []
    assert sorted((r.i, r.s, r.winding) for r in found.collect()) == sorted(want)
    assert most(found, "Exchange", "shuffleRecordsWritten") < len(want) / 2


def test_equal_shadings_are_read_once(spark, tmp_path, monkeypatch):
    """a file for each size, however many parts there are; parts without a size count too."""
    sizes = [None, *range(1, 8)]
    spark.range(400).select(F.col("id").alias("p_partkey"), F.element_at(F.array(*(F.lit(s).cast("int") for s in sizes)), (F.col("id") % 8 + 1).cast("int")).alias("p_size")).write.parquet(f"{tmp_path}/part.parquet")
    seen, made = [], documents.made
    monkeypatch.setattr(documents, "made", lambda rows, *given: seen.append(rows.count()) or made(rows, *given))
    got = {tuple(r) for r in documents.shading_stops(spark, str(tmp_path)).collect()}
    assert got == {(s, 50, s and f"0 792 {s} 792", "rgb(0, 0, 0)", "rgb(255, 255, 255)", "rgb(191, 191, 191)") for s in sizes}
    assert seen == [7]


def test_equal_texts_are_cut_once(spark, monkeypatch):
    """300 rows of one text have one text's places, and large tables of places don't go through the driver."""
    staged, stage = {}, segments.stage

    def seen(df, name):
        out = stage(df, name)
        staged.setdefault(name, []).append((out.count(), df._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(segments, "stage", seen)
    monkeypatch.setattr(segments, "SMALL", 5, raising=False)
    known = spark.createDataFrame([("f", b"ab", "x"), ("f", b"abc", "y"), ("f", b"d", "z"), (None, b"abcd", "w")], "font string, code binary, text string")
    texts = spark.createDataFrame([(f, i, b"abcdabd") for i in range(100) for f in ("f", None, "g")], "font string, row int, data binary")
    got = segments.segment(texts, known)
    plan = got._jdf.queryExecution().executedPlan().toString()
    cuts = {"f": [(0, 3, b"abc", "y"), (3, 1, b"d", "z"), (4, 2, b"ab", "x"), (6, 1, b"d", "z")], None: [(0, 4, b"abcd", "w"), *((4 + i, 1, c, None) for i, c in enumerate([b"a", b"b", b"d"]))]}
    cuts["g"] = [(i, 1, b"abcdabd"[i : i + 1], None) for i in range(7)]
    assert sorted((str(r.font), r.row, r.pos, r.width, bytes(r.code), str(r.text)) for r in got.collect()) == sorted((str(f), i, p, w, c, str(t)) for f, rows in cuts.items() for i in range(100) for p, w, c, t in rows)
    assert [n for n, _ in staged["segment-steps"]] == [21]
    assert not any("Broadcast" in p for p in [plan, *(p for name in ("segment-reached", "segment-jumps") for _, p in staged[name])])


def reader(path, **options):
    columns = type("Columns", (), {"names": [c.split()[0] for c in records.SCHEMA.split(", ")]})()
    return records.ObjectReader(columns, {"path": str(path)} | {k: str(v) for k, v in options.items()})


def test_many_splits_are_few_tasks(tmp_path, monkeypatch):
    """beyond `most` splits a task has several, and objects are the same; a split reads about its own length."""
    rng = random.Random(11)
    whole = b"".join(b"%d 0 obj %b endobj " % (rng.randrange(500), b"x" * rng.choice([1, 20, 400, 9000])) for _ in range(3000))
    (tmp_path / "big.pdf").write_bytes(whole)
    want, at = [], 0
    for m in re.finditer(rb"endobj", whole):
        h = records.HEADER.search(whole, at, m.end())
        want.append((h.start(), m.end() - h.start(), int(h[1]), whole[h.end() : m.start()]))
        at = m.end()
    monkeypatch.setattr(records, "LEAST", 1000, raising=False)
    for split, most in ((1 << 10, 50), (1 << 10, 10**6), (700, 7)):
        source = reader(tmp_path, split=split, most=most)
        tasks = source.partitions()
        got = [(r["start"], r["length"], r["obj_id"], r["body"]) for t in tasks for b in source.read(t) for r in b.to_pylist()]
        assert got == want
        assert len(tasks) == -(-len(whole) // split) if most > 100 else len(tasks) <= most
    read, opened = [], records._opened

    class File:
        def __init__(self, file):
            self.file, self.seek = file, file.seek

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.file.close()

        def read(self, n):
            read.append(len(data := self.file.read(n)))
            return data

    def watched(path):
        system, inside = opened(path)
        return type("System", (), {"open_input_file": lambda _, p: File(system.open_input_file(p)), "get_file_info": lambda _, x: system.get_file_info(x)})(), inside

    monkeypatch.setattr(records, "_opened", watched)
    source = reader(tmp_path, split=32 << 10, most=10**6)
    assert sum(b.num_rows for t in source.partitions() for b in source.read(t)) == len(want)
    assert sum(read) < 3 * len(whole)


def test_the_last_of_close_objects(tmp_path):
    """with `last` what the same task would drop anyway isn't given out."""
    (tmp_path / "a.pdf").write_bytes(b"".join(b"%d 0 obj null endobj %d 1 obj << /N %d >> endobj\n" % (i % 300, i % 300, i) for i in range(900)))
    source = reader(tmp_path, last="true")
    rows = [r for t in source.partitions() for b in source.read(t) for r in b.to_pylist()]
    assert {r["obj_id"]: r["body"] for r in rows} == {i: b" << /N %d >> " % (600 + i) for i in range(300)} and len(rows) == 300
