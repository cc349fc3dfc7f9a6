"""Nested values, predictors, shapes, mergeable states, split files and cancelling, against brute force."""

import json
import os
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from quire import control, session
from quire.operators import analytics, merging, nested, predictors, shapes
from quire.sources import records


def test_nested_audit(spark):
    rng = random.Random(3)

    def made(depth):
        kind = rng.random()
        if depth == 0 or kind < 0.3:
            return rng.choice(["Action", "URI", "x", 3, None, True, 2.5])
        if kind < 0.6:
            return [made(depth - 1) for _ in range(rng.randrange(4))]
        return {k: made(depth - 1) for k in rng.sample(["Type", "Subtype", "S", "JS", "URI", "Kids", "é"], rng.randrange(5))}

    deep = json.loads("[" * 20 + "]" * 20)
    values = [(d, i, json.dumps(made(5))) for d in ("a", None, "hot", "hot") for i in range(25)] + [("bad", 0, "{"), ("bad", 1, None), ("bad", 2, "3"), ("deep", 0, json.dumps(deep))]
    values = [(d, n, j) for n, (d, _, j) in enumerate(values)]
    names, types, most = ["JS", "URI"], ["Action", "URI"], 40
    want, counts = {}, {}
    for d, _, text in values:
        try:
            root = json.loads(text)
        except (TypeError, ValueError):
            continue
        todo = [(root, 0)]
        while todo:
            v, depth = todo.pop()
            if not isinstance(v, (dict, list)) or depth > 7:
                continue
            counts[d] = counts.get(d, 0) + 1
            if isinstance(v, dict) and counts[d] <= most:
                for n in [v[k] for k in ("Type", "Subtype", "S") if isinstance(v.get(k), str) and v[k] in types] + [k for k in v if k in names]:
                    want[d, n] = want.get((d, n), 0) + 1
            todo += [(x, depth + 1) for x in reversed([v[k] for k in sorted(v, key=str.encode)] if isinstance(v, dict) else v)]
    df = spark.createDataFrame(values, "doc string, at int, value string").withColumn("value", F.try_parse_json("value"))
    sums, whole = nested.audit(df, ["doc"], ["at"], "value", names, types, most, 7)
    assert {(r.doc, r["name"]): r.n for r in sums.collect()} == want
    assert {r.doc: (r.nodes, r.scanned, r.truncated) for r in whole.collect()} == {d: (n, min(n, most), n > most or d == "deep") for d, n in counts.items()}


def unfiltered(rows, colours):
    out, above = [], []
    for kind, data in rows:
        line = []
        for i, x in enumerate(data):
            a = line[i - colours] if i >= colours else 0
            b = above[i] if i < len(above) else 0
            c = above[i - colours] if i >= colours and i - colours < len(above) else 0
            p = a + b - c
            near = min(((abs(p - v), o, v) for o, v in enumerate((a, b, c))))[2]
            line.append((x + {1: a, 2: b, 3: (a + b) // 2, 4: near}.get(kind, 0)) % 256)
        out.append(line)
        above = line
    return out


@pytest.mark.parametrize("colours", [1, 3])
def test_predictors(spark, colours):
    rng = random.Random(colours)
    images = {k: [(rng.choice(kinds), [rng.randrange(256) for _ in range(w if k != "ragged" else rng.randrange(w))]) for _ in range(h)] for k, kinds, w, h in (("all", [0, 1, 2, 3, 4, 9, None], 20, 30), (None, [2], 9, 40), ("up", [1, 2, 2, 2], 30, 25), ("ragged", [0, 1, 2, 3, 4], 9, 20), ("one", [4], 12, 1))}
    rows = [(k, i * 10, kind, data, "clash") for k, image in images.items() for i, (kind, data) in enumerate(image)]
    df = spark.createDataFrame(rows, "image string, row int, filter int, data array<int>, chain string").repartition(4)
    got = {(r.image, r.row): list(r.data) for r in predictors.png(df, ["image"], colours).collect()}
    assert got == {(k, i * 10): line for k, image in images.items() for i, line in enumerate(unfiltered(image, colours))}
    got = {(r.image, r.row): list(r.data) for r in predictors.tiff(df, ["image"], colours).collect()}
    assert got == {(k, i * 10): line for k, image in images.items() for i, line in enumerate(unfiltered([(1, d) for _, d in image], colours))}
    assert predictors.png(df.limit(0), ["image"], colours).count() == 0


def test_winding(spark):
    rng = random.Random(5)
    corners = [("p", s, u, i, rng.randrange(40), rng.randrange(40)) for s in range(12) for u in range(rng.randrange(1, 3)) for i in range(rng.randrange(2, 9))]
    corners += [(None, 90, 0, i, *xy) for i, xy in enumerate([(0, 0), (40, 0), (40, 40), (0, 40)])] + [("p", 91, 0, i, *xy) for i, xy in enumerate([(7, 7), (8, 7), (8, 8), (7, 8), (7, 7), (8, 7), (8, 8), (7, 8)])]
    points = [(rng.choice(["p", "p", None]), i, rng.randrange(-2, 42), rng.randrange(-2, 42)) for i in range(700)] + [("p", 1000, None, 3), ("p", 7, 8, 8), ("p", 7, 8, 8)] + [(None, 2000 + i, 4 * i, 4 * i) for i in range(11)]
    paths = {}
    for k, s, u, _, x, y in corners:
        paths.setdefault((k, s), {}).setdefault(u, []).append((x, y))
    want = []
    for k, i, x, y in points:
        for (key, s), subpaths in paths.items():
            n = 0
            for c in subpaths.values():
                for (x0, y0), (x1, y1) in zip(c, c[1:] + c[:1], strict=True):
                    side = (x1 - x0) * ((y or 0) - y0) - ((x or 0) - x0) * (y1 - y0)
                    n += (y0 <= y < y1 and side > 0) - (y1 <= y < y0 and side < 0)
            if key == k and x is not None and n:
                want.append(str((k, i, s, n)))
    edges = shapes.closed(spark.createDataFrame(corners, "k string, s int, u int, i int, x int, y int"), ["k", "s"], ["u"], "i")
    for cell in (4, 16):
        found = shapes.winding(spark.createDataFrame(points, "k string, i int, x int, y int"), edges, ["k"], ["s"], cell)
        assert sorted(str((r.k, r.i, r.s, r.winding)) for r in found.collect()) == sorted(want)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    both = [abs(int(w.split(", ")[3][:-1])) for w in want]
    assert any(n % 2 == 0 for n in both) and any(n % 2 for n in both)


def test_curves_as_lines(spark):
    rows = shapes.flattened(spark.createDataFrame([("c", 0.0, 0.0, 0.0, 4.0, 4.0, 4.0, 4.0, 0.0)], "shape string, x0 double, y0 double, x1 double, y1 double, x2 double, y2 double, x3 double, y3 double"), 4).orderBy("piece").collect()
    assert [(r.x0, r.y0) for r in rows] == [(0, 0), (0.625, 2.25), (2, 3), (3.375, 2.25)] and (rows[-1].x1, rows[-1].y1) == (4, 0)


def test_a_merged_census_is_a_recount(spark, tmp_path):
    rng = random.Random(9)
    contents = {f"s{i}": (rng.randrange(1, 4), [(p, f"operator:{rng.randrange(4)}", rng.randrange(1, 5)) for p in range(1, 4) for _ in range(2)]) for i in range(40)}
    paths = [(f"p{i:03}", f"s{rng.randrange(40)}") for i in range(120)]
    rng.shuffle(paths)
    files_of = lambda some: spark.createDataFrame([(p, s, contents[s][0], None if s != "s7" else "broken") for p, s in some], "path string, sha256 string, pages int, error string")
    features_of = lambda some: spark.createDataFrame([(p, n, f, k) for p, s in some for n, f, k in contents[s][1]], "path string, page_no int, feature string, n int")
    state = str(tmp_path / "state")
    for b in range(4):
        some = paths[b * 30 : b * 30 + 30]
        merging.add(state, f"b{b}", files_of(some + some[:3]), features_of(some))
    with pytest.raises(ValueError, match="b1"):
        merging.add(state, "b1", files_of(paths[:1]), features_of(paths[:1]))
    firsts = {}
    for p, s in paths:
        firsts[s] = min(p, firsts.get(s, p))
    kept = [(p, s) for s, p in firsts.items()]
    plain = lambda df: sorted((r.feature, r.documents, r.pages, r.occurrences, [tuple(e) for e in r.examples], r.status) for r in df.collect())
    want = plain(analytics.census_summary(features_of(kept)))
    assert plain(merging.summary(spark, state)) == want and want
    merging.compact(spark, state, str(tmp_path / "one"))
    for folder in (state, str(tmp_path / "one")):
        assert plain(merging.summary(spark, folder)) == want
        row = merging.totals(spark, folder).first()
        assert (row.files, row.contents, row.duplicates) == (120, len(firsts), 120 - len(firsts)) and row.parsed == len(firsts) - ("s7" in firsts)
        assert row.pages == sum(contents[s][0] for s in firsts if s != "s7")
        some = merging.documents_by(spark, folder, F.col("feature").isin("operator:1", "operator:2"), "hit").filter("hit").first()
        assert some.documents == sum(any(f in ("operator:1", "operator:2") for _, f, _ in contents[s][1]) for s in firsts)
    assert merging.summary(spark, str(tmp_path / "none")).count() == 0 and merging.totals(spark, str(tmp_path / "none")).first().files == 0


def test_one_file_in_many_splits(spark, tmp_path):
    rng = random.Random(2)
    parts = [b"%PDF-1.4\n% 9 9 obj no end before the next\n"]
    for i in range(400):
        body = bytes(rng.choices(b"abc 0123456789 objendob\n\x00\xff", k=3000 if i % 50 == 7 else rng.choice([0, 3, 50, 20])))
        parts.append(b"%d %d obj%bendobj%b" % (rng.randrange(60), rng.randrange(3), b"\n" + body.replace(b"endobj", b"") + b"\n", rng.choice([b"", b"\n", b" junk endobj endobj 5 obj "])))
    whole = b"".join(parts) + b"7 0 obj without an end"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "big.pdf").write_bytes(whole)
    (tmp_path / "in" / "empty.pdf").write_bytes(b"")
    want, at = [], 0
    while (end := whole.find(b"endobj", at)) >= 0:
        if m := re.compile(rb"(\d+)[\s\x00]+(\d+)[\s\x00]+obj\b").search(whole[at : end + 6]):
            want.append((at + m.start(), end + 6 - at - m.start(), int(m[1]), int(m[2]), whole[at + m.end() : end]))
        at = end + 6
    records.register(spark)
    assert len(want) >= 400
    for split in (37, 1000, 1 << 30):
        df = spark.read.format(records.NAME).option("split", split).load(str(tmp_path / "in"))
        assert sorted((r.start, r.length, r.obj_id, r.generation, bytes(r.body)) for r in df.collect()) == sorted(want), split
        assert df.rdd.getNumPartitions() == -(-len(whole) // split)
    few = spark.read.format(records.NAME).option("split", 1000).schema("obj_id long, start long").load(str(tmp_path / "in" / "big.pdf")).filter("obj_id = 5 and start > 100")
    assert sorted(r.start for r in few.collect()) == sorted(s for s, _, i, _, _ in want if i == 5 and s > 100)
    last = {r.obj_id: bytes(r.body) for r in records.last_objects(spark.read.format(records.NAME).option("split", 500).load(str(tmp_path / "in"))).collect()}
    assert last == {i: b for _, _, i, _, b in want}
    long = spark.read.format(records.NAME).option("split", 700).option("longest", 40).load(str(tmp_path / "in")).collect()
    assert sorted((r.start, r.length) for r in long) == sorted((s, n) for s, n, *_ in want) and any(r.body is None for r in long)


def test_packed_objects(spark):
    texts = [("f", 9, 13, 3, "1 0 2 6 1 10 <<A>> (x) [1]"), ("f", 8, 8, 2, "3 0 2 5 /Name late"), ("f", 7, 4, 0, ""), ("f", 6, 2, 2, "x y z"), ("f", 5, 3, 5, "4 0 12")]
    direct = spark.createDataFrame([("f", 3), ("g", 1)], "path string, obj_id long")
    got = records.packed_objects(spark.createDataFrame(texts, "path string, obj_id long, first int, n int, text string"), direct).collect()
    assert {r.obj_id: (r.compressed_in, r.value) for r in got} == {1: (9, "<<A>>"), 2: (8, "late"), 4: (5, "12")}


def test_a_deadline_ends_a_job_and_its_folders(spark):
    session.stage(spark.range(1000), "warm")
    folders = []
    began = time.time()
    with pytest.raises(control.Cancelled, match="took more than 8 seconds"), control.job(spark, 8):
        staged = session.stage(spark.range(1000), "cancelled")
        folders += session._FOLDERS.get()
        assert staged.count() == 1000 and os.path.isdir(folders[0].removeprefix("file://"))
        spark.range(0, 10**13, 1, 8).selectExpr("sum(id % 7)").collect()
    assert time.time() - began < 60 and not os.path.exists(folders[0].removeprefix("file://")) and not spark.sparkContext.getJobTags()
    with control.job(spark, 60) as handle:
        assert session.stage(spark.range(10), "fine").count() == 10 and handle.reason is None
    with pytest.raises(control.Cancelled, match="by hand"), control.job(spark) as handle:
        handle.cancel("by hand")
        spark.range(0, 10**13, 1, 8).selectExpr("sum(id % 7)").collect()
    assert spark.range(5).count() == 5


def test_a_cluster_needs_a_shared_folder(spark):
    class Context:
        def __init__(self, master):
            self.master, self.path = master, None

        def getConf(self):  # noqa: N802
            return {}

        def getCheckpointDir(self):  # noqa: N802
            return self.path

        def setCheckpointDir(self, path):  # noqa: N802
            self.path = path

    class Session:
        def __init__(self, master):
            self.sparkContext = Context(master)

    for master in ("yarn", "local-cluster[2,1,1024]", "spark://host:7077"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            session.shared_dir(Session(master))
    assert session.shared_dir(Session("local[2]"))
