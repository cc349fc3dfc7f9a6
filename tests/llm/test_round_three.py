"""Divergence, content sort and conversation repair against brute force on odd tables."""

import hashlib
import heapq
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quire.llm import ann, content_sort, divergence, media, mixing, repair, secrets, sharding, tokens

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, copies that differ in whitespace, a hot group, repeated rows, clashing names."""
    rng = random.Random(5)
    word = lambda: rng.choice(["alpha", "Beta", "ünï", "İx", "日本", "gamma9delta", "a_b", "Ω"])
    rows = [(i, " ".join(word() for _ in range(rng.randrange(12))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, ""]), 1) for i in range(120)]
    rows += [(200 + i, "same" + " " * rng.randrange(4) + "text\there", "en", "hot", 1) for i in range(300)]
    rows += [(None, "same text here", "en", "hot", 1), (None, None, None, None, None), (600, "", "en", "a", 0), (601, " \x0b\x0c\r\n\t ", "en", "a", 0), (602, "nul\x00l byte", "en", "a", 1)]
    rows += [(603, "9 " * 900_000 + "Alpha " * 200_000, "en", "long", 1), (604, "x" * 1_200_000, "en", "long", 1), (605, "1 2 3", "fr", "digits", 1), (606, "4", "fr", "more", 1)]
    rows += [rows[1]] * 3
    df = spark.createDataFrame(rows, DOCS)
    for name in ("term", "norm", "sha", "part", "run", "row", "piece", "conv"):
        df = df.withColumn(name, F.lit("clash"))
    return df.repartition(6).cache()


def by_sql(odd, sql):
    documents = odd.select("doc_id", "text", "lang", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    return sorted(map(str, duckdb.sql(sql).fetchall()))


def test_exact_dedup(spark, odd):
    got = content_sort.op12(odd).collect()
    groups = defaultdict(list)
    for r in odd.collect():
        text = r.text or ""
        groups[re.sub(r"[\x20\x09-\x0D]", "", text)].append((-len(text), r.doc_id is None, r.doc_id or 0, r.doc_id))
    want = Counter()
    for norm, rows in groups.items():
        rows.sort(key=lambda x: x[:3])
        for i, r in enumerate(rows):
            want[r[3], rows[0][3], len(rows), i == 0, hashlib.sha256(norm.encode()).hexdigest()] += 1
    assert Counter(tuple(r) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_of_a_group_over_many_ranges(spark):
    rows = spark.range(5000).select(F.col("id").cast("string").alias("doc_id"), F.when(F.col("id") % 3 < 2, "one and the same").otherwise(F.concat(F.lit("text "), F.col("id") % 40)).alias("text"))
    spread = content_sort.sorted_contents(rows.repartition(8)).select(F.spark_partition_id().alias("p"), "norm").filter("norm = 'oneandthesame'")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert spread.select("p").distinct().count() >= 4
        got = content_sort.op12(rows.repartition(8)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    hot = [r for r in got if r.group_size > 1000]
    assert len(hot) == 3334 and {r.keep_id for r in hot} == {"0"} and [r.doc_id for r in hot if r.kept] == ["0"]
    assert sum(r.kept for r in got) == 41 and len(got) == 5000
    assert content_sort.op12(rows.limit(0)).count() == 0


def test_divergence(spark, odd):
    got = sorted(str(tuple(r)) for r in divergence.op11(odd).select("lang", "source", "part", "item", "value", "rank").collect())
    assert got == by_sql(odd, divergence.SQL) and len(got) > 20
    assert any("'fr', 'digits', 'pair', 'more', 0, 1" in r for r in got)
    assert divergence.op11(odd.limit(0)).count() == 0


def test_divergence_by_hand(spark):
    rows = [(i, t, "en", s, 1) for i, (t, s) in enumerate([("x x y", "a"), ("x y", "a"), ("x y z", "b"), ("z Y", "c")])]
    got = {(r.source, r.part, r.item): (r.value, r["rank"]) for r in divergence.op11(spark.createDataFrame(rows, DOCS)).collect()}
    counts = {"a": {"x": 3, "y": 2}, "b": {"x": 1, "y": 1}, "c": {"x": 0, "y": 1}}
    p = lambda c, t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + 2)
    whole = {"x": 4, "y": 4}
    for s in "abc":
        order = sorted(((sum((p(counts[s], t) - p(counts[o], t)) ** 2 // p(counts[o], t) for t in "xy"), o) for o in "abc" if o != s), key=lambda x: (-x[0], x[1]))
        for i, (v, o) in enumerate(order):
            assert got[s, "pair", o] == (v, i + 1)
        for t in "xy":
            q = p(whole, t)
            assert ((s, "term", t) in got) == (counts[s][t] > 0 and p(counts[s], t) > q)


def brute(rows):
    """Best-first search over (row, last initial) by (cost, audit)."""
    convs, out = {}, {}
    said = lambda x: " " if x is None else str(x)
    for conv, turn, role, text in rows:
        mine = convs.setdefault(conv, [])
        hit, role, text = zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20, said(role), said(text)
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        mine += [(turn, "user" if hit == 4 else role, text)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    for conv, turns in convs.items():
        turns.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in turns:
            left = re.sub(r"[\x20\x09-\x0D]", "", text)
            faults.append("b" if not left else "d" if (role, text) in seen else "t" if left[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum((a[1][:1] + b[1][:1]) not in ("su", "ua", "au") for a, b in zip(turns, turns[1:], strict=False))
        ts = [t for t, _, _ in turns if t is not None]
        heap, best = [(0, "", 0, "", ())], {}
        while True:
            cost, audit, i, last, lines = heapq.heappop(heap)
            if i == len(turns) and last in ("", "a"):
                break
            if best.setdefault((i, last), (cost, audit)) < (cost, audit):
                continue
            to = "a" if last == "u" else "u"
            full = {"u": "user", "a": "assistant"}[to]
            heapq.heappush(heap, (cost + 3, audit + "I", i, to, (*lines, full + ":")))
            if i < len(turns):
                _, role, text = turns[i]
                heapq.heappush(heap, (cost + 4, audit + "D", i + 1, last, lines))
                if faults[i] not in ("b", "d"):
                    more = 3 * (faults[i] == "t")
                    heapq.heappush(heap, (cost + 3 + more, audit + "R", i + 1, to, (*lines, f"{full}:{text}")))
                    if role[:1] == to or (role[:1] == "s" and last == ""):
                        heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
        gaps = max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0
        out[conv] = (gaps, faults.count("b"), faults.count("d"), faults.count("t"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


@pytest.mark.parametrize(("block", "batch_rows"), [(256, 20_000), (3, 20_000), (256, 7), (4, 10)])
def test_conversation_repair(spark, block, batch_rows):
    rng = random.Random(block * batch_rows)
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "agent"])
    text = lambda: rng.choice(["Yes.", "No!", "and then", "Why? ", "", None, " \t", "ok", "same.", f"x{rng.random()}.", "é ", "."])
    turn = lambda i: rng.choice([i, i, i, 2 * i, 1, None])
    rows = [(c, turn(i), role(), text()) for c in range(60) for i in range(rng.randrange(1, 14))]
    rows += [(None, i, role(), text()) for i in range(5)] + [(99, i, role(), text()) for i in range(700)] + [(77, 4, "user", "Hello.")] * 500
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("times", F.lit("clash")).withColumn("conv", F.lit(1))
    got = {r[0]: tuple(r)[1:] for r in repair.repair(df.repartition(4), block, batch_rows).collect()}
    assert got == brute(rows)


def test_conversation_repair_of_nothing_and_by_names(spark):
    schema = "conv_id string, turn int, role string, text string"
    assert repair.op13(spark.createDataFrame([], schema)).count() == 0
    rows = [(f"c{i}", j, "user" if j % 2 == 0 else "assistant", f"Line {j}.") for i in range(40) for j in range(4)]
    got = {r[0]: tuple(r)[1:] for r in repair.op13(spark.createDataFrame(rows, schema)).collect()}
    assert got == brute(rows) and any(x[5] == 0 and x[6] == "KKKK" for x in got.values())


def test_conversation_repair_sql(spark):
    conversations = spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").toPandas()
    rows = list(conversations[["conv_id", "turn", "role", "text"]].itertuples(index=False, name=None))
    assert {r[0]: tuple(r[1:]) for r in duckdb.sql(repair.SQL).fetchall()} == brute(rows)


def test_weak_spans_stay_out_of_long_strong_ones():
    text = "token=" + "".join(f"AKIA{i}ABCDEFGHIJKLMNOP+" for i in range(6)) + "xY3zW9qL7mN2pR8sT4vK see key"
    _, found = secrets.base_spans(text), secrets.weak_spans(text, secrets.base_spans(text))
    strong = [(a, b) for _, a, b in secrets.base_spans(text)]
    assert len(strong) >= 7 and not [f for f in found if any(f[1] < b and a < f[2] for a, b in strong)]


def test_a_word_of_invalid_bytes_is_counted():
    memory = tokens._Memory(tokens.Automaton(["a", "b", "\ufffd"], tokens.MARK))
    assert memory[b"a\xff\xfeb"] != 0


def _clusters(n, dim=16, seed=3, kinds=40):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((kinds, dim))[rng.integers(0, kinds, n)] + 0.1 * rng.standard_normal((n, dim))).astype(np.float32)


def _nearest(rows, query, k=10):
    """Brute force over (id, vector) of the query's dimension."""
    v = dict(rows)[query].astype(float)
    return sorted((float(np.sqrt(((w.astype(float) - v) ** 2).sum())), i) for i, w in rows if i != query and len(w) == len(v))[:k]


def test_neighbours_of_every_dimension_and_full_lists(spark, monkeypatch):
    """Clusters smaller than k, a second common dimension, and one so rare that it has no router."""
    wide, narrow, rare = _clusters(400, kinds=80), _clusters(300, dim=5, seed=4), _clusters(6, dim=3, seed=5)
    rows = [*enumerate(wide), *((1000 + i, v) for i, v in enumerate(narrow)), *((2000 + i, v) for i, v in enumerate(rare))]
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>").withColumn("dim", F.lit("clash"))
    visits = {}
    fit = ann.fit

    def narrow_fit(x, parts, **kwargs):
        router, _ = fit(x, parts, cover=0.2)
        visits[x.shape[1]] = router is not None
        return router, 1

    monkeypatch.setattr(ann, "fit", narrow_fit)
    got = defaultdict(list)
    for r in ann.op7(df).collect():
        got[r.query_id].append((r["rank"], r.score, r.vec_id))
    assert visits == {16: True, 5: True, 3: False}
    assert sorted(got) == [i for i, _ in rows if i % 100 == 0]
    for query, found in got.items():
        want = _nearest(rows, query)
        assert [r for r, *_ in sorted(found)] == list(range(1, len(want) + 1))
        if query >= 2000:
            assert [(s, i) for _, s, i in sorted(found)] == want


def test_neighbours_far_beyond_the_sample(spark, monkeypatch):
    """Ten times as many rows as the sample has: the router has not seen most of them, and visits few parts."""
    monkeypatch.setattr(ann, "SAMPLE", 600)
    seen = []
    fit = ann.fit
    monkeypatch.setattr(ann, "fit", lambda *a, **k: seen.append(fit(*a, **k)) or seen[-1])
    rows = list(enumerate(_clusters(6000)))
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in ann.op7(df).collect():
        got[r.query_id].add(r.vec_id)
    hits = sum(len(got[q] & {i for _, i in _nearest(rows, q)}) for q in range(0, 6000, 100))
    assert hits >= 0.95 * 600 and seen[0][1] < ann.PARTS / 3


def test_parts_grow_with_rows():
    assert [ann.parts_of(n) for n in (0, 500_000, 600_000, 10**7, 10**12)] == [32, 32, 64, 256, 256]


def _b(kind, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _fragmented(data_offset=None, sizes=(10, 20, 30), number=7):
    """A track without samples of its own, and a fragment with two runs: sizes in the table, then two samples by the defaults."""
    stbl = _b(b"stbl", _b(b"stsd", bytes(8), _b(b"avc1", bytes(40))), _b(b"stsz", bytes(12)), _b(b"stts", bytes(8)))
    mdia = _b(b"mdia", _b(b"mdhd", bytes(12), struct.pack(">I", 1000), bytes(8)), _b(b"hdlr", bytes(8), b"soun", bytes(12)), _b(b"minf", stbl))
    trak = _b(b"trak", _b(b"tkhd", bytes(12), struct.pack(">I", 7), bytes(64)), mdia)
    moov = _b(b"moov", trak, _b(b"mvex", _b(b"trex", bytes(4), struct.pack(">5I", 7, 1, 50, 8, 0x10000))))
    table = b"".join(struct.pack(">II", s, 0 if i == 1 else 0x10000) for i, s in enumerate(sizes))

    def moof(offset):
        runs = _b(b"trun", struct.pack(">IIiI", 0x605, len(sizes), offset, 0), table), _b(b"trun", struct.pack(">II", 0, 2))
        return _b(b"moof", _b(b"mfhd", bytes(8)), _b(b"traf", _b(b"tfhd", struct.pack(">II", 0x20000, number)), *runs))

    offset = len(moof(0)) + 8 if data_offset is None else data_offset
    payload = bytes(range(sum(sizes) + 16))
    head = _b(b"ftyp", b"iso5", bytes(4)) + moov
    return head + moof(offset) + _b(b"mdat", payload), payload, len(head) + offset


def test_media_fragments():
    data, payload, at = _fragmented()
    found = media.walk(data)
    (track,) = found["tracks"]
    assert found["error"] is None and track["codec"] == "avc1" and (track["n_samples"], track["ticks"]) == (5, 250)
    assert media.payload_of(data, track) == payload
    assert track["keyframes"].tolist() == [[at, at + 10], [at + 10, at + 30]]
    assert media.feature(found) == f"soun/avc1 0x0 0.250s 5 samples keys {at}-{at + 10},{at + 10}-{at + 30}"


@pytest.mark.parametrize("broken", [{"data_offset": 10**6}, {"data_offset": -(10**6)}, {"number": 9}])
def test_media_broken_fragments(broken):
    found = media.walk(_fragmented(**broken)[0])
    assert found["error"] and [t["n_samples"] for t in found["tracks"]] == [0]
    data = _fragmented()[0]
    assert media.walk(data.replace(struct.pack(">II", 0, 2), struct.pack(">II", 0, 2**31)))["error"] == "more samples than bytes"


def test_sharding_gives_copies_out_in_pieces(spark):
    df = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.lit("same").alias("text")).union(spark.createDataFrame([(None, None), (2, "")], "doc_id int, text string"))
    got = sharding.assign(df).toPandas()
    assert len(got) == 30_002
    for _, rows in got.groupby("shard"):
        assert sorted(rows.slot) == list(range(len(rows)))


def test_mixing_keeps_ids_of_any_type(spark):
    rows = [(f"doc-{i}", f"s{i % 3}", "some words " * (1 + i % 5)) for i in range(40)] + [(None, None, None)]
    got = mixing.mix(spark.createDataFrame(rows, "doc_id string, source string, text string")).collect()
    assert sorted((r.doc_id or "", r["size"]) for r in got) == sorted((i or "", len((t or "").split())) for i, _, t in rows)
    assert sum(r.taken for r in got) > 0
