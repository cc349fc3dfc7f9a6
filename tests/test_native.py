"""The native operators against brute force: hot keys, nulls, ties, cycles, long texts, empty tables."""

import random

import pytest
from pyspark.sql import functions as F

from quire.operators import analytics, curves, ranges, scans, segments, trees

TURNS = [[1, 0, 0, 1], [0, 1, -1, 0], [-1, 0, 0, -1], [0, -1, 1, 0]]


@pytest.fixture(scope="module")
def steps():
    rng = random.Random(1)
    return [(rng.choice([None, "a", "b", "hot", "hot", "hot"]), i, rng.randrange(4), rng.randrange(-5, 6), rng.choice("([)]x")) for i in range(2000)]


@pytest.fixture(scope="module")
def rows(spark, steps):
    return spark.createDataFrame(steps, "k string, i long, r int, t int, e string").withColumn("piece", F.lit("clash")).withColumn("place", F.lit("clash")).repartition(5).cache()


def test_running_sums(rows, steps):
    got = scans.running_sums(rows, ["k"], ["i"], {"s": "all"}, s=F.col("t")).collect()
    run, want = {}, {}
    for k, i, _, t, _ in steps:
        run[k] = want[i] = run.get(k, 0) + t
    assert {x.i: x.s for x in got} == want and all(x["all"] == run[x.k] for x in got) and {x.piece for x in got} == {"clash"}
    assert scans.running_sums(rows.limit(0), ["k"], ["i"], s=F.col("t")).count() == 0
    assert scans.running_sums(rows, [], ["i"], s=F.lit(1)).agg(F.max("s")).first()[0] == 2000


def test_no_task_has_a_hot_key(spark, rows):
    many = rows.unionByName(rows.withColumn("i", F.col("i") + 5000)).unionByName(rows.withColumn("i", F.col("i") + 10000)).repartition(8)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed, piece = scans.in_pieces(many.filter("k = 'hot'"), ["k"], ["i"])
        got = scans.running_sums(many, ["k"], ["i"], s=F.lit(1)).groupBy("k").agg(F.max("s").alias("s"), F.count("s").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert all(r.s == r.n for r in got)
    sizes = [r["count"] for r in placed.groupBy(piece).count().collect()]
    assert len(sizes) > 1 and max(sizes) < 0.8 * sum(sizes)


def multiplied(a, b):
    return [a[0] * b[0] + a[2] * b[1], a[1] * b[0] + a[3] * b[1], a[0] * b[2] + a[2] * b[3], a[1] * b[2] + a[3] * b[3], a[0] * b[4] + a[2] * b[5] + a[4], a[1] * b[4] + a[3] * b[5] + a[5]]


def test_running_products(rows, steps):
    turns = F.element_at(F.array(*(F.array(*(F.lit(float(v)) for v in x)) for x in TURNS)), F.col("r") + 1)
    matrix = F.concat(turns, F.array(F.col("t").cast("double"), F.lit(1.0)))
    run, want = {}, {}
    for k, i, r, t, _ in steps:
        m = [*map(float, TURNS[r]), float(t), 1.0]
        run[k] = want[i] = multiplied(run[k], m) if k in run else m
    assert {x.i: x["product"] for x in scans.running_products(rows, ["k"], ["i"], matrix).collect()} == want
    small = scans.scan(rows, ["k"], ["i"], F.col("e"), lambda a, b: F.concat(a, b), "text", block=4)
    text, want = {}, {}
    for k, i, _, _, e in steps:
        text[k] = want[i] = text.get(k, "") + e
    assert {x.i: x.text for x in small.collect()} == want
    assert scans.running_products(rows.limit(0), ["k"], ["i"], matrix).count() == 0


def test_paired(rows, steps):
    got = scans.paired(rows, ["k"], ["i"], F.col("e").isin("(", "["), F.col("e").isin(")", "]"), 6).collect()
    stacks, outcome, mate = {}, {}, {}
    for k, i, _, _, e in steps:
        stack = stacks.setdefault(k, [])
        if e in "([":
            outcome[i] = "over cap" if len(stack) >= 6 else "left open"
            if len(stack) < 6:
                stack.append(i)
        elif e in ")]":
            outcome[i] = "close" if stack else "unmatched"
            if stack:
                mate[stack[-1]] = i
                outcome[stack.pop()] = "open"
    assert {x.i: x.outcome for x in got} == outcome and {"open", "close", "left open", "unmatched", "over cap"} == set(outcome.values())
    assert {x.i: x.mate["i"] for x in got if x.mate} == mate
    assert {(x.k, x.level, x.pair): x.i for x in got if x.outcome == "open"}.keys() == {(x.k, x.level, x.pair) for x in got if x.outcome == "close"}


def test_as_of(spark):
    rng = random.Random(2)
    left = [(rng.choice(["a", None, "b"]), rng.choice([None, rng.randrange(100)]), j) for j in range(400)] + [("a", 50, 3)] * 3
    right = [(rng.choice(["a", None]), rng.choice([None, rng.randrange(100)]), j) for j in range(60)]
    got = scans.as_of(spark.createDataFrame(left, "k string, x int, j int"), spark.createDataFrame(right, "k string, y int, v int"), ["k"], "x", "y").collect()
    want = lambda r: max(((y, v) for k, y, v in right if k == r[0] and None not in (y, r[1]) and y <= r[1]), default=None)
    assert sorted((str(x.k), str(x.x), x.j, str(tuple(x.found) if x.found else None)) for x in got) == sorted((str(r[0]), str(r[1]), r[2], str(want(r))) for r in left)


def depth_first(root, kids, own, cap, most):
    out, seen = [], set()

    def visit(node, parent, path, got):
        if len(path) > cap or node in seen:
            out.append((node, parent, tuple(path), "too deep" if len(path) > cap else "cycle", None, None))
            return
        seen.add(node)
        got = tuple(y if x is None else x for x, y in zip(own.get(node, (None, None)), got, strict=True))
        out.append((node, parent, tuple(path), "inner" if kids.get(node) else "leaf", *got))
        for o, k in enumerate(kids.get(node, [])):
            if o >= most:
                out.append((k, node, (*path, o), "too many", None, None))
                break
            visit(k, node, [*path, o], got)

    visit(root, None, [], (None, None))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(4))
def test_tree_walk(spark, seed):
    rng, kids, n = random.Random(seed), {}, 40
    for k in range(1, n):
        kids.setdefault(rng.randrange(max(0, k - 6), k), []).append(k)
    tree = seed % 2 == 0  # else a graph with several ways to a node and cycles among them
    for a, b in [(30, 0), (20, 20)] if tree else [(rng.randrange(n), rng.randrange(n)) for _ in range(6)]:
        if b not in kids.setdefault(a, []):
            kids[a].append(b)
    own = {k: (rng.choice([None, k]), rng.choice([None, str(k)])) for k in range(n) if rng.random() < 0.4}
    cap, most = (6, 3) if tree else (60, 50)
    links = [(t, p, k, o) for t in ("x", None) for p, ks in kids.items() for o, k in enumerate(ks)] * 2
    got = trees.walk(
        spark.createDataFrame([("x", 0), (None, 0), ("x", None)], "tree string, node long"), spark.createDataFrame(links, "tree string, parent long, node long, ord int"),
        spark.createDataFrame([(t, k, *v) for t in ("x", None) for k, v in own.items()], "tree string, node long, box long, name string"), ["box", "name"], cap, most,
    ).collect()
    for t in ("x", None):
        assert sorted(((r.node, r.parent, tuple(r.path), r.outcome, r.box, r["name"]) for r in got if r.tree == t), key=str) == depth_first(0, kids, own, cap, most)


def test_segments(spark):
    rng = random.Random(4)
    codes = {f: {bytes(rng.choices(b"abcd", k=rng.randrange(1, 5))): f"{f}{i}" for i in range(30)} for f in ("f", None)}
    texts = [(f, i, bytes(rng.choices(b"abcde", k=rng.choice([0, 1, 2, 3, 7, 60])))) for i in range(40) for f in ("f", None, "none")]
    texts += [("f", 900, bytes(rng.choices(b"abcd", k=20_000))), ("f", 901, None), ("f", 1, b"abc"), ("f", 1, b"abc")]
    known = spark.createDataFrame([(f, c, t) for f, m in codes.items() for c, t in m.items()] + [("f", None, "x"), ("f", b"", "y"), ("f", b"abcde", "z")], "font string, code binary, text string")
    for fallback in (1, 2):
        want = []
        for f, i, data in texts:
            at = 0
            while at < len(data or b""):
                w = next((w for w in (4, 3, 2, 1) if at + w <= len(data) and data[at : at + w] in codes.get(f, {})), None)
                code = data[at : at + (w or fallback)]
                want.append((str(f), i, at, len(code), code, str(codes.get(f, {}).get(code) if w else None)))
                at += len(code)
        df = spark.createDataFrame(texts, "font string, row int, data binary").repartition(3)
        got = segments.segment(df, known, fallback).select("font", "row", "pos", "width", "code", "text").collect()
        assert sorted((str(r.font), r.row, r.pos, r.width, bytes(r.code), str(r.text)) for r in got) == sorted(want)
    assert segments.segment(df.limit(0), known).count() == 0


def test_ranges(spark):
    rng = random.Random(6)
    spans = [(rng.choice(["f", None, "g"]), (a := rng.randrange(-500, 5000)), a + rng.choice([0, 1, 5, 300, 4000, -3]), i) for i in range(300)]
    spans += [("f", 10, 20, 1000 + i) for i in range(50)] + [("g", -(2**63), 2**63 - 1, 2), ("f", -(2**62), 2**62 + 5, 1), ("g", None, 5, 7)]
    values = [(rng.choice(["f", None, "g", "h"]), rng.choice([None, rng.randrange(-600, 10000)]), 1) for _ in range(500)] + [("f", 15, 2)] * 200 + [("g", -(2**63), 1), ("g", 2**63 - 1, 1)]
    df = spark.createDataFrame(values, "font string, code long, low int")
    found = ranges.look_up(df, spark.createDataFrame(spans, "font string, first long, last long, ord long"), ["font"], "code", "first", "last", "ord")
    want = lambda f, c: max((o for g, a, b, o in spans if g == f and None not in (a, c) and a <= c <= b), default=None)
    assert sorted(str((r.font, r.code, r.low, r.found and r.found["ord"])) for r in found.collect()) == sorted(str((*v, want(*v[:2]))) for v in values)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoop" not in plan
    none = spark.createDataFrame([], "font string, first long, last long, ord long")
    assert ranges.look_up(df, none, ["font"], "code", "first", "last", "ord").filter("found is null").count() == len(values)


def test_code_maps_and_widths(spark):
    defined = spark.createDataFrame([("f", 0x41, 0x5A, 0x61, 0), ("f", 0x43, None, 0x39, 1), ("f", 0, 2**40, 7, -1)], "font string, first long, last long, target long, ord int")
    codes = spark.createDataFrame([("f", 0x41), ("f", 0x43), ("f", 0x5A), ("f", 2**39), ("g", 5)], "font string, code long")
    got = {(r.font, r.code): r.to for r in ranges.mapped(codes, defined, ["font"], "code", "to").collect()}
    assert got == {("f", 0x41): 0x61, ("f", 0x43): 0x39, ("f", 0x5A): 0x7A, ("f", 2**39): 7 + 2**39, ("g", 5): None}
    arrays = spark.createDataFrame([("f", 0, 10, None, [500.0, None, 700.0], None), ("f", 1, 11, 40, None, 250.0), ("f", 2, 12, None, [333.0], None)], "font string, ord int, first int, last int, list array<double>, width double")
    codes = spark.createDataFrame([("f", c) for c in (9, 10, 11, 12, 13, 40, 41)], "font string, code long")
    got = ranges.look_up(codes, ranges.widths(arrays, ["font"]), ["font"], "code", "first", "last", "ord", "w").collect()
    assert {r.code: r.w and r.w["width"] for r in got} == {9: None, 10: 500.0, 11: 250.0, 12: 333.0, 13: 250.0, 40: 250.0, 41: None}


def test_curves(spark):
    schema = "fn string, kind int, low double, high double, c0 array<double>, c1 array<double>, n double, enc0 double, enc1 double, floor array<double>, ceil array<double>"
    functions = [
        ("e", 2, 0.0, 2.0, [0.0, 1.0], [1.0, 3.0], 2.0, None, None, None, None), ("s", 0, 0.0, 1.0, None, None, None, None, None, [0.0], [0.9]), ("r", 0, 0.0, 1.0, None, None, None, 2.0, 0.0, [0.0], [1.0]),
        ("t", 3, 0.0, 1.0, None, None, None, None, None, None, None), ("u", 3, -1.0, 1.0, None, None, None, None, None, None, None), ("loop", 3, 0.0, 1.0, None, None, None, None, None, None, None),
        ("bad", 2, 0.0, 1.0, [0.0], [1.0, 2.0], 1.0, None, None, None, None), ("worse", 2, 1.0, 1.0, [0.0], [1.0], 1.0, None, None, None, None), ("zero", 2, 0.0, 1.0, [0.0], [1.0], 0.0, None, None, None, None),
    ]
    parts = [("t", 0.0, 0.5, 0.0, 1.0, "s"), ("t", 0.5, 1.0, 2.0, 0.0, "e"), ("u", -1.0, 0.0, 1.0, 0.0, "t"), ("u", 0.0, 1.0, 0.0, 1.0, "s"), ("loop", 0.0, 1.0, 0.0, 1.0, "loop")]
    samples = [(f, i, [v]) for f in "sr" for i, v in enumerate([0.0, 1.0, 0.5])]
    xs = [-5.0, -0.75, -0.5, 0.0, 0.1, 0.25, 0.5, 0.75, 1.0, 1.5, 9.0, None]
    hold = lambda x, a, b: min(b, max(a, x))

    def sampled(x, back=False):
        p = hold(2 - 2 * hold(x, 0, 1) if back else 2 * hold(x, 0, 1), 0, 2)
        v, i = [0.0, 1.0, 0.5, 0.5], int(p)
        return [hold(v[i] * (1 - p + i) + v[i + 1] * (p - i), 0, 1.0 if back else 0.9)]

    def power(x):
        w = (hold(x, 0, 2) / 2) ** 2
        return [w, 1 + 2 * w]

    def t(x):
        x = hold(x, 0, 1)
        return sampled(x / 0.5) if x < 0.5 else power(2 - 2 * (x - 0.5) / 0.5)

    want = {"e": power, "s": sampled, "r": lambda x: sampled(x, True), "t": t, "u": lambda x: t(1 - (hold(x, -1, 1) + 1)) if x < 0 else sampled(hold(x, -1, 1)), **{f: lambda x: None for f in ("loop", "bad", "worse", "zero", "gone")}}
    inputs = spark.createDataFrame([(f, x, i) for f in want for i, x in enumerate(xs)], "fn string, x double, row int")
    got = curves.evaluate(inputs, spark.createDataFrame(functions, schema), spark.createDataFrame(parts, "fn string, low double, high double, enc0 double, enc1 double, part string"), spark.createDataFrame(samples, "fn string, idx int, value array<double>"))
    rows = got.collect()
    assert len(rows) == len(want) * len(xs)
    for r in rows:
        if r.x is not None:
            assert r.out == pytest.approx(want[r.fn](r.x)), (r.fn, r.x)


def test_windows_in_two_steps(spark):
    rng = random.Random(8)
    rows = [(rng.choice(["a", None, "hot", "hot"]), rng.choice([None, rng.randrange(50), 7]), i) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, v int, i int").repartition(4)
    by = {}
    for k, v, _ in rows:
        if v is not None:
            by.setdefault(k, []).append(v)
    assert {r.k: r.median for r in analytics.upper_median(df, ["k"], "v").collect()} == {k: sorted(vs)[len(vs) // 2] for k, vs in by.items()}
    run, kept = {}, set()
    for k, v, i in rows:
        run[k] = run.get(k, 0) + (v or 0)
        kept |= {i} if run[k] <= 300 else set()
    assert {r.i for r in analytics.bounded_prefix(df, ["k"], ["i"], "v", 300).collect()} == kept
    weights = spark.createDataFrame([(i, 99 if i == 3 else 0) for i in range(100)], "i int, w int")
    picked = analytics.weighted_pick(weights, "w", 2000, 5).collect()
    assert len(picked) == 2000 and len({r.draw for r in picked}) == 2000 and 850 < sum(r.i == 3 for r in picked) < 1150


def test_references_by_doubling(spark):
    objects = [("d", i, f'{{"r":{i + 1},"g":0}}') for i in range(1, 40)] + [("d", 40, '{"s":"end"}'), ("d", 50, '{"r":0,"g":0}'), ("d", 60, '{"r":60,"g":0}'), ("d", 70, '{"r":999,"g":0}')]
    values = [("d", r, f"v{r}") for r in (40, 39, 21, 20, 19, 1, 50, 60, 70, 0, None, 999)]
    got = analytics.resolve_references(spark.createDataFrame(values, "path string, ref long, at string"), spark.createDataFrame(objects, "path string, obj_id long, value string")).collect()
    table = {i: v for _, i, v in objects}

    def follow(ref, value=None):
        for _ in range(21):
            if not ref:
                break
            value = table.get(ref)
            ref = int(value.split(":")[1].split(",")[0]) if value and value.startswith('{"r"') else None
        return value

    assert {r.at: r.value for r in got} == {a: follow(ref) for _, ref, a in values}
