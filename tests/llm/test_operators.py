"""Each operator against brute force on small tables, with nulls, ties, repeats and odd columns."""

import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from quire.llm import ann, langid, media, mixing, ngram_join, pieces, secrets, sharding, tokens, toxicity

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(rng, n, v=40):
    return " ".join(f"w{rng.randrange(v)}" for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty, blank and very long texts, copies, near copies, repeated rows, clashing names."""
    rng = random.Random(3)
    rows = [(i, words(rng, rng.choice([0, 1, 3, 4, 5, 30, 80])), "en", rng.choice(["a", "b", None, "é"]), 1) for i in range(60)]
    base = words(rng, 120, 500).split()
    for i in range(60, 90):
        w = list(base)
        w[rng.randrange(len(w))] = f"x{i}"
        rows.append((i, " ".join(w), "en", "hot", 1))
    rows += [(i, "the very same text again and again", None, "hot", 1) for i in range(100, 130)]
    rows += [(200, None, None, None, None), (201, "", "en", "a", 0), (202, " \t\n ", "en", "a", 3), (None, "no id here at all", "en", "a", 1)]
    rows += [(203, words(rng, 30000, 3000), "en", "long", 1), (204, "a" * 3000, "en", "a", 1), (205, "ünïcödé " * 30 + "日本語 🙂", "en", "é", 1)]
    rows += [rows[3]] * 3
    return spark.createDataFrame(rows, DOCS).withColumn("slot", F.lit("clash")).withColumn("node", F.lit(0)).withColumn("ids", F.lit("clash")).repartition(5)


@pytest.fixture(scope="module")
def rows(odd):
    return odd.select("doc_id", "text", "lang", "source").collect()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def test_sharding(odd, rows, empty):
    got = sharding.assign(odd).collect()
    size = lambda t: len((t or "").encode()) + 1
    crc = lambda t: zlib.crc32((t or "").encode())
    assert sorted((str(r.doc_id), r.size, r.text_crc32) for r in got) == sorted((str(r.doc_id), size(r.text), crc(r.text)) for r in rows)
    for s in {r.shard for r in got}:
        places = sorted(r.slot for r in got if r.shard == s)
        assert places == list(range(len(places))) and 0 <= s < 8
    assert {r.law for r in got} == {"bytes"} and {r.grown_shard for r in got} == {None}
    assert sharding.assign(empty).count() == 0


def test_sharding_bytes_even_and_map_is_versioned(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = sharding.assign(docs, map_path=str(tmp_path / "map")).toPandas().groupby("shard")["size"].sum()
    assert got.max() - got.min() < 0.001 * got.mean()
    stored = spark.read.parquet(str(tmp_path / "map"))
    assert {r.version for r in stored.select("version").distinct().collect()} == {1, 2}
    assert stored.filter("version = 2").count() < stored.filter("version = 1").count()


def test_rebalance_to_more_shards_moves_little_else(spark):
    sums = spark.range(500).selectExpr("cast(id as int) as slot", "100 + id % 7 as bytes", "1L as rows")
    one = sharding.first_map(sums, 4)
    two = sharding.rebalance(one, sums, 5)
    moves = [r.shard for r in two.collect()]
    assert 90 <= len(moves) <= 110 and moves.count(4) >= 0.95 * len(moves)
    loads = sharding.current(one.unionByName(two)).join(sums, "slot").groupBy("shard").agg(F.sum("bytes").alias("b")).collect()
    assert max(r.b for r in loads) - min(r.b for r in loads) <= 106


def _replay(rows, made, order):
    """Every word of every source by itself: (doc, shard, place, reading, word) of those that the plan's blocks take."""
    out = {}
    for s in made:
        r = made[s]
        stream = [(d, w) for d, z in order[s] for w in range(z)]
        owner = [j for j in range(8) for _ in range(r["ends"][j] - (r["ends"][j - 1] if j else 0))]
        for reading in range(2):
            ranked = sorted(range(r["blocks"]), key=lambda k: (k * r["a"] + r["c"]) % r["blocks"])
            for at, k in enumerate(ranked):
                if reading > r["whole"] or (reading == r["whole"] and at >= r["drawn"]):
                    continue
                words = stream[k * mixing.BLOCK_WORDS : (k + 1) * mixing.BLOCK_WORDS]
                if reading == r["whole"] and at == r["drawn"] - 1:
                    words = words[: r["cut"]]
                for d, w in words:
                    out.setdefault(d, []).append((owner[reading * r["blocks"] + at], reading, w))
    return out


def test_mixing_equals_plain_replay(spark, odd, rows, empty, monkeypatch):
    monkeypatch.setattr(mixing, "BLOCK_WORDS", 16)
    monkeypatch.setattr(mixing, "COPIES", 2)
    got = mixing.mix(odd).collect()
    docs = odd.select("doc_id", "source", "text", F.xxhash64(F.col("doc_id"), F.col("source"), F.col("text")).alias("key")).collect()
    order, totals = {}, {}
    unsigned = lambda x: x % (1 << 64) >> 52
    sizes = [(r, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs]
    for i, (r, z) in enumerate(sorted(sizes, key=lambda x: (unsigned(x[0].key), x[0].key, x[0].doc_id is not None, x[0].doc_id or 0, x[1]))):
        order.setdefault(r.source, []).append(((r.doc_id, i), z))
        totals[r.source] = totals.get(r.source, 0) + z
    made = {r["source"]: r for r in mixing.plan(list(totals.items()))}
    assert sum(r["target"] for r in made.values()) == pytest.approx(1.5 * sum(totals.values()))
    assert all(r["target"] <= 2 * r["source_size"] + 1e-9 for r in made.values())
    want = _replay(rows, made, order)
    said = lambda spans: sorted((s.shard, s.pass_no, w) for s in spans for w in range(s.first_word, s.first_word + s.words))
    have = sorted((str(r.doc_id), r["size"], r.taken, said(r.spans)) for r in got)
    assert have == sorted((str(d[0]), z, len(want.get(d, ())), sorted(want.get(d, ()))) for s in order for d, z in order[s])
    taken = {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.taken
        assert r.taken <= 2 * r["size"]
    assert all(taken[s] == made[s]["quota"] for s in made)
    assert mixing.mix(empty).count() == 0


def test_mixing_depends_on_its_tree(odd, monkeypatch):
    sums = lambda: {tuple(r) for r in mixing.op9(odd).select("doc_id", "spans_crc32", F.col("shard_words").cast("string")).collect()}
    one = sums()
    assert one == sums()
    monkeypatch.setattr(mixing, "split_tree", lambda quotas, shards, seed: np.array([[q] + [0] * (shards - 1) for q in quotas]))
    assert one != sums()


def test_mixing_blocks_stay_whole(odd):
    mixed = mixing.mix(odd)
    rows = mixing.shard_rows(mixed).collect()
    blocks, places = {}, {}
    for s in rows:
        assert blocks.setdefault((s.source, s.rank), (s.shard, s.place)) == (s.shard, s.place) and 0 <= s.shard < 8
    assert sum(s.words for s in rows) == mixed.agg(F.sum("taken")).first()[0]
    dealt = mixing.split_tree([10, 0, 37, 5], 8, 1)
    assert dealt.sum(1).tolist() == [10, 0, 37, 5] and dealt.sum(0).max() - dealt.sum(0).min() <= 1
    large = mixing.split_tree([4_000_000_000, 7, 3_000_000_001], 8, 1)
    assert large.sum(1).tolist() == [4_000_000_000, 7, 3_000_000_001] and large.min() >= 0 and large.sum(0).max() - large.sum(0).min() <= 1
    for n in (1, 2, 7, 1000, 1 << 40):
        a, c = mixing.permutation(n, 3)
        assert math.gcd(a, n) == 1 and a * n < 1 << 63 and 0 <= c < n


def test_targets_reshare_the_excess():
    got = mixing.targets([("c", 1000), ("a", 10), (None, 50), ("b", 10)])
    assert [r["source"] for r in got] == ["a", "b", "c", None] and [r["weight"] for r in got] == [5, 2, 1, 5]
    assert got[0]["target"] == 20 and got[1]["target"] == 20 and got[3]["target"] == 100 and got[2]["target"] == pytest.approx(1465)


def _groups(texts, k, percent):
    sets = {}
    for d, t in texts:
        w = (t or "").encode().lower().split()
        sets[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for x, y in itertools.combinations(sorted(sets), 2):
        both = len(sets[x] & sets[y])
        if both and 100 * both >= percent * (len(sets[x]) + len(sets[y]) - both):
            a, b = sorted((root(x), root(y)))
            up[b] = a
    return {d: (len(sets[d]), root(d)) for d in sets}


@pytest.mark.parametrize(("k", "percent", "bucket"), [(4, 85, 3_000_000), (5, 80, 3_000_000), (2, 60, 400)])
def test_ngram_join_finds_every_link(odd, rows, monkeypatch, k, percent, bucket):
    monkeypatch.setattr(ngram_join, "BUCKET_SHINGLES", bucket)
    got = ngram_join.join(odd, k, percent).collect()
    want = _groups({(r.doc_id, r.text) for r in rows if r.doc_id is not None}, k, percent)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == (want[r.doc_id] if r.doc_id is not None else (r.n_shingles, None))


def test_ngram_join_empty(empty):
    assert ngram_join.join(empty).count() == 0


def test_links_of_random_sets():
    rng = np.random.default_rng(1)
    for trial in range(60):
        base = [rng.integers(0, 60, rng.integers(1, 40)) for _ in range(4)]
        sets = []
        for _ in range(25):
            s = set(base[rng.integers(4)].tolist())
            for _ in range(rng.integers(0, 5)):
                s.symmetric_difference_update({int(rng.integers(0, 60))})
            sets.append(np.array(sorted(s or {1}), np.uint64))
        up = list(range(25))
        root = lambda x, up=up: x if up[x] == x else root(up[x])  # noqa: E731, B023
        for a, b in itertools.combinations(range(25), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 70 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                up[y] = x
        parts = {frozenset(i for i in range(25) if root(i) == r) for r in map(root, range(25))}
        mine = list(range(25))
        root2 = lambda x, up=mine: x if up[x] == x else root2(up[x])  # noqa: E731, B023
        for a, b in ngram_join.links_of(list(range(25)), sets, 70):
            x, y = sorted((root2(a), root2(b)))
            mine[y] = x
        assert {frozenset(i for i in range(25) if root2(i) == r) for r in map(root2, range(25))} == parts, trial


def test_components_of_random_graphs(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(130)] + [(300 + i, 301 + i) for i in range(40)] + [(500, 500 + i) for i in range(1, 50)]
    up = {}
    root = lambda x: x if up.setdefault(x, x) == x else root(up[x])
    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    got = {r.node: r.root for r in ngram_join.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up}


def test_token_counts_equal_greedy(odd, rows, empty):
    vocabulary = ["▁w", "▁w1", "▁w12", "1", "2", "3", "23", "0", "▁the", "▁t", "he", "e", "ry", "▁ver", "y", "▁", "▁a", "a", "aa", "aaa"]
    known = set(vocabulary)

    def greedy(word):
        n = i = 0
        while i < len(word):
            j = next((j for j in range(len(word), i, -1) if ("▁" * (i == 0)) + word[i:j] in known), None)
            if j is None:
                return 1, 1
            n, i = n + 1, j
        return n, 0

    want = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        found = [greedy(x) for x in w]
        want.append((str(r.doc_id), len(w), sum(n for n, _ in found), sum(u for _, u in found)))
    got = tokens.token_counts(odd, vocabulary).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_tokens, r.n_unknown) for r in got) == sorted(want)
    assert tokens.token_counts(empty).count() == 0


def test_automaton_on_random_vocabularies():
    rng = random.Random(2)
    for _ in range(400):
        vocabulary = {"".join(rng.choices("ab", k=rng.randint(1, 5))) for _ in range(6)} | {"▁" + "".join(rng.choices("ab", k=rng.randint(1, 4))) for _ in range(5)}
        machine = tokens.Automaton(sorted(vocabulary))
        for _ in range(20):
            word = "".join(rng.choices("abc", weights=(10, 10, 1), k=rng.randint(1, 12)))
            n = i = 0
            while i < len(word):
                j = next((j for j in range(len(word), i, -1) if ("▁" * (i == 0)) + word[i:j] in vocabulary), None)
                if j is None:
                    n = 0
                    break
                n, i = n + 1, j
            assert machine.count(word) == n


def test_automaton_with_a_bare_mark():
    rng = random.Random(4)
    for _ in range(400):
        vocabulary = {"▁"} | {m + "".join(rng.choices("ab", k=rng.randint(1, 4))) for m in ("", "▁") for _ in range(4)}
        machine = tokens.Automaton(sorted(vocabulary))
        for _ in range(20):
            marked = "▁" + "".join(rng.choices("abc", weights=(10, 10, 1), k=rng.randint(1, 12)))
            n = i = 0
            while i < len(marked):
                j = next((j for j in range(len(marked), i, -1) if marked[i:j] in vocabulary), None)
                if j is None:
                    n = 0
                    break
                n, i = n + 1, j
            assert machine.count(marked[1:]) == n
    pieces = tokens.load_pieces()
    assert tokens.Automaton(pieces).count("2024-11-28") > 5


def test_media_round_trip(odd, rows, empty):
    got = media.op4(odd).collect()
    want = []
    for r in rows:
        raw = (r.text or "").encode()
        body = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((str(r.doc_id), len(raw), len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:])))
    assert sorted((str(r.doc_id), r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(want)
    assert all("error" not in r.feature and r.n_keyframes >= 1 for r in got)
    assert media.op4(empty).count() == 0


def test_media_columns_and_broken_files(spark):
    good = media.wrap(media.pad(bytes(range(256)) * 200))
    files = [(1, good, "x"), (2, good[: len(good) // 3], "x"), (3, b"", "x"), (4, None, "x"), (5, good[:40] + b"\xff" * 200, "x")]
    got = {r.id: r for r in media.media_columns(spark.createDataFrame(files, "id int, media binary, brand_ string")).collect()}
    track = got[1].tracks[0]
    assert (got[1].error, track.codec, track.n_samples, track.ticks) == (None, "raw ", 13, 520)
    assert [good[k.start : k.start + 4] for k in track.keyframes] == [bytes(range(4))] * 2
    assert got[2].error and got[4].error and got[5].error and got[3].tracks == []
    rng = random.Random(4)
    for _ in range(300):
        b = bytearray(good[:1200])
        for _ in range(rng.randint(1, 6)):
            b[rng.randrange(len(b))] = rng.randrange(256)
        media.walk(bytes(b))


def _plain_base(text):
    text = text or ""
    out = [("assign", *m.span()) for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_media_counts_are_held_against_samples():
    made = media.wrap(media.pad(b"x" * 5000))
    at = made.index(b"stsc") + 12
    for count in (60_000_000, 0xFFFFFFFF):
        odd = bytearray(made)
        odd[at + 4 : at + 8] = count.to_bytes(4, "big")
        began = time.perf_counter()
        found = media.walk(bytes(odd))
        assert time.perf_counter() - began < 1 and (found["error"] or found["tracks"][0]["n_samples"] == 2)


def test_secrets_base_and_links(spark):
    key, weak = "AKIA" + "ABCDEFGH12345678", "wJalrXUtnFEMI7K3MDENGbPxRfiCYEXAMPLEKEY9"
    texts = [
        f"x {key} y {weak} z", weak, f"{key} " + "far " * 200 + weak, f"user=bob {weak} https://api.example.com/v1", f"user=bob {weak}",
        'PassWord: "abcdefgh1" token:secret:abcdefgh1 api_key = short', "é🙂 " + "0123456789abcdef" * 3 + "g AKIAAKIA1234567890", None, "", "ſecret=abcdefghij TOKEN=abcdefghij",
    ]
    got = {r.doc_id: r for r in secrets.op6(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        base = _plain_base(t)
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in base)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [sum(s[0] == k for s in base) for k in ("assign", "access", "hex")] == [got[i].n_assign, got[i].n_access, got[i].n_hex]
        assert {f"{k}:{a}:{b}" for k, a, b in base} <= set(got[i].spans.split(","))  or not base
    assert "value:" in got[0].spans and got[1].spans == "" and "value:" not in got[2].spans
    assert {s.split(":")[0] for s in got[3].spans.split(",")} == {"ident", "value", "endpoint"} and got[4].spans == ""
    red = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert red[0] == "x [access] y [value] z" and red[7] is None and red[1] == weak
    assert secrets.credentials(spark.createDataFrame([(1, texts[0])], "doc_id long, text string")).count() == 1


def test_secrets_link_every_part_in_scope():
    key, weak = "AKIA" + "Q7" * 8, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    kinds = lambda t: [s[0] for s in secrets.spans_of(t)[1]]
    assert kinds(f"{key} user=bob {weak}") == ["access", "value"]
    assert kinds("user=bob login=alice password=abcdefgh1") == ["ident", "ident", "assign"]
    assert kinds("user=bob password=abcdefgh1 http://a.example/x then http://b.example/y") == ["ident", "assign", "endpoint", "endpoint"]
    rng = random.Random(5)
    said = {"ident": "user=bob", "access": key, "assign": "password=abcdefgh1", "value": weak, "endpoint": "http://a.example/x", "gap": "far " * 9, "end": "\n\n"}
    for _ in range(300):
        text = " ".join(said[rng.choice(list(said))] for _ in range(rng.randint(2, 14)))
        base = secrets.base_spans(text)
        parts = base + secrets.weak_spans(text, base)
        near = lambda p, q: max(p[1] - q[2], q[1] - p[2], 0) <= 60 and "\n\n" not in text[min(p[2], q[2]) : max(p[1], q[1])]
        want = set(base)
        for s in (p for p in parts if p[0] in ("assign", "hex", "value")):
            ids, ends = ([p for p in parts if p[0] in k and near(s, p)] for k in (("access", "ident"), ("endpoint",)))
            for i in ids:
                if s[0] == "value" and i[0] == "ident" and not ends:
                    continue
                want |= {s, i, *ends}
        assert set(secrets.spans_of(text, 60)[1]) == want, text


def test_secrets_in_env_files():
    key, weak = "AKIA" + "Q7" * 8, "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"
    cut = lambda t: secrets.redacted(t, secrets.spans_of(t)[1])
    for quote in ("", '"', "'"):
        text = f"aws_access_key_id={key}\naws_secret_access_key={quote}{weak}{quote}"
        assert cut(text) == f"aws_access_key_id=[access]\naws_secret_access_key={quote}[value]{quote}"
    assert cut("DB_USER=admin\nDB_PASSWORD=abcdefgh1") == "DB_[ident]\nDB_[assign]"
    assert cut("db_user: bob, password: abcdefgh1") == "db_[ident], [assign]" and cut("superuser=bob password=abcdefgh1") == "superuser=bob [assign]"


def test_secrets_take_time_in_proportion():
    n = 1_000_000
    for text in ("user=bob " + "a-" * (n // 2), "user=bob " + "a." * (n // 2), "user=bob " + "ab" * (n // 2), "user=" * (n // 5), "\n " * (n // 2) + "user=bob", "secret" + " " * n + "user=bob", "user=bob http://" * (n // 15)):
        began = time.perf_counter()
        secrets.spans_of(text)
        assert time.perf_counter() - began < 4, text[:30]


def test_secrets_on_tables(odd, rows, empty):
    got = secrets.op6(odd).collect()
    assert sorted((str(r.doc_id), r.n_hex) for r in got) == sorted((str(r.doc_id), sum(s[0] == "hex" for s in _plain_base(r.text))) for r in rows)
    assert secrets.op6(empty).count() == 0 and secrets.redact(odd).count() == len(rows)


def test_index_is_exact():
    rng = np.random.default_rng(6)
    for _ in range(40):
        n, v = int(rng.integers(1, 400)), 12
        rows = []
        for _ in range(n):
            ts = sorted(rng.choice(v, rng.integers(1, 5), replace=False).tolist())
            rows.append((ts, toxicity.weights(rng.integers(1, 4, len(ts)).tolist(), np.linspace(1, 3, v)[ts])))
        index = toxicity.Index(rows, v, block=16)
        dense = np.zeros((n, v))
        for i, (ts, w) in enumerate(rows):
            dense[i, ts] = w
        ts, w = rows[0]
        cos = np.round(dense[:, ts] @ w, 12)
        best = [i for i in np.lexsort((np.arange(n), -cos)) if cos[i] > 0][:7]
        ids, found = index.nearest([(ts, w)], 7)[0]
        assert np.allclose(found, cos[best]) and sorted(np.round(found, 9)) == sorted(np.round(cos[best], 9))


def test_toxicity(spark, odd, rows, empty):
    labels = spark.createDataFrame([(r.doc_id, 1, int(r.doc_id % 3 == 0)) for r in rows if r.doc_id is not None], "doc_id long, quality int, toxic int")
    got = toxicity.score(odd, labels).collect()
    assert len(got) == len(rows)
    by_text = {}
    text = {}
    for r in rows:
        text.setdefault(r.doc_id, r.text)
    for r in got:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.held_out == (zlib.crc32(("" if r.doc_id is None else str(r.doc_id)).encode()) % 4 == 2)
        assert by_text.setdefault(text[r.doc_id], r.score) == r.score
    assert toxicity.score(empty, labels).count() == 0
    none = toxicity.score(odd, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}


def test_toxicity_indexes_every_word_of_every_example(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = toxicity.fit(docs, labels)
    used = docs.join(labels, "doc_id").filter(toxicity.fold(F.col("doc_id")) != 2).select("doc_id", "text", "toxic").distinct().collect()
    assert model.terms.tolist() == sorted({xxh3_64_intdigest(w) for r in used for w in toxicity.words((r.text or "").encode())})
    assert sorted(model.names) == sorted(str(r.doc_id) for r in used if toxicity.words((r.text or "").encode())) and 0 in model.labels
    scores = [(model.scores([(r.text or "").encode()])[0][0], r.toxic) for r in used]
    assert min(s for s, y in scores if y) > max(s for s, y in scores if not y)


def test_toxicity_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    got = toxicity.score(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    assert got[got.predicted == 1].toxic.mean() > 0.8 and got[got.toxic == 1].predicted.mean() > 0.85


def _vectors(n, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return (rng.standard_normal((12, dim))[rng.integers(0, 12, n)] + 0.4 * rng.standard_normal((n, dim))).astype(np.float32)


def test_nearest_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "CHUNK", 300)
    monkeypatch.setattr(ann, "QUERY_BLOCK", 7)
    x = _vectors(1500)
    x[200:700] = x[200]
    rows = [(i, [float(v) for v in x[i]]) for i in range(1500)]
    bad = [(2000, None), (2100, []), (2200, [0.0] * 16), (2300, [None] * 16), (2400, [float("nan")] * 16), (2500, [1.0] * 3), (None, rows[0][1]), (100, rows[100][1])]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<float>").withColumn("label", F.lit(1)).withColumn("part", F.lit("clash"))
    got = ann.op7(df).collect()
    hits = 0
    for q in range(0, 1500, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(1))
        want = [int(i) for i in np.lexsort((np.arange(1500), d)) if i != q][:10]
        mine = sorted((r["rank"], r.vec_id, r.score) for r in got if r.query_id == q)
        assert [m[0] for m in mine] == list(range(1, 11)) and all(m[2] == pytest.approx(d[m[1]], abs=1e-12) for m in mine)
        assert [(m[2], m[1]) for m in mine] == sorted((m[2], m[1]) for m in mine)
        hits += len({m[1] for m in mine} & set(want))
        if 200 <= q < 700:
            assert [m[1] for m in mine] == want
    assert hits >= 0.9 * 150 and {r.query_id for r in got} == set(range(0, 1500, 100))


def test_nearest_neighbours_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [(r.query_id, r["rank"], r.vec_id) for r in ann.op7(df).orderBy("query_id", "rank").collect()] == [(0, 1, 100), (0, 2, 1), (100, 1, 0), (100, 2, 1)]
    assert ann.op7(df.limit(0)).count() == 0


def test_balanced_parts():
    near = ann.neighbours(_vectors(640).astype(float), 5)
    size = np.bincount(ann.balanced_parts(near, 8))
    assert len(size) == 8 and size.max() - size.min() <= 2


def test_nearest_neighbours_recall(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.op7(df).collect()
    p = df.toPandas()
    x, ids = np.array(p.embedding.tolist(), float), p.vec_id.to_numpy()
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        d = np.sqrt(((x - x[ids == q][0]) ** 2).sum(1))
        want = {int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q and True} and [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:10]
        hits, total = hits + len(set(want) & {r.vec_id for r in got if r.query_id == q}), total + 10
    assert hits >= 0.9 * total


def _viterbi(text, m):
    """The best path over the whole marked text."""
    if not text:
        return []
    return _viterbi_of(pieces.MARK + text.replace(" ", pieces.MARK), m)


def _viterbi_of(t, m):
    known = {p: (i, c) for p, i, c in m.rows}
    best = [(0.0, 0, 0)] + [None] * len(t)
    for e in range(1, len(t) + 1):
        for s in range(max(0, e - m.longest), e):
            found = known.get(t[s:e])
            if found is None and e - s > 1:
                continue
            i, c = found or (-1, m.unknown)
            if best[e] is None or best[s][0] + c > best[e][0]:
                best[e] = (best[s][0] + c, s, i)
    out, at = [], len(t)
    while at:
        _, s, i = best[at]
        out, at = ([i] if i >= 0 else [m.byte0 + b for b in t[s:at].encode()]) + out, s
    return out


@pytest.mark.parametrize("hot", [300_000, 5])
def test_pieces(odd, rows, empty, monkeypatch, hot):
    monkeypatch.setattr(pieces, "HOT", hot)
    m = pieces.model()
    got = pieces.decode(pieces.encode(odd, m), m, to="back").collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.back == (r.text or "")
        if len(r.text or "") < 5000:
            assert r.ids == _viterbi(r.text, m)
    sums = {(r.doc_id, r.n_pieces) for r in pieces.summary(odd, m).collect()}
    assert sums == {(r.doc_id, len(r.ids)) for r in got} and all(r.round_trip for r in pieces.summary(odd, m).collect())
    assert pieces.encode(empty, m).count() == 0 and pieces.summary(empty, m).count() == 0


def test_pieces_digest_is_the_same_hot_or_rare(odd, monkeypatch):
    m = pieces.model()
    got = {r.doc_id: r.ids for r in pieces.encode(odd, m).collect()}
    want = {tuple(r) for r in pieces.summary(odd, m).collect()}
    assert {(d, len(x), zlib.crc32(np.array(x, np.int32).tobytes()), True) for d, x in got.items()} == want
    monkeypatch.setattr(pieces, "HOT", 3)
    monkeypatch.setattr(pieces, "WORDS", 2)
    assert {tuple(r) for r in pieces.summary(odd, m).collect()} == want


def test_pieces_of_long_parts_and_marks(spark):
    m = pieces.model()
    rows = [(0, "a" * 9000), (1, f"x{pieces.MARK}y"), (2, "  two  spaces "), (3, "same"), (3, "same")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("IDS", F.lit(0)).withColumn("h1", F.lit("a")).withColumn("rare", F.lit("b"))
    got = pieces.encode(docs, m)
    assert [c for c in got.columns] == ["doc_id", "text", "h1", "rare", "ids"]
    cutter = pieces.Cutter(m.joints)
    for r in got.collect():
        assert list(r.ids) == [i for p in cutter.parts(r.text) for i in _viterbi_of(p, m)] and (r.h1, r.rare) == ("a", "b")
    assert {r.doc_id: r.round_trip for r in pieces.summary(docs, m).collect()} == {0: True, 1: False, 2: True, 3: True}


def test_pages_take_time_in_proportion():
    n = 1_000_000
    for page in ("<html" * (n // 5), "<script>" * (n // 8), "<!--" * (n // 4), "<nav>" * (n // 5), "<" * n, "<html lang" + " " * n, "</script" + " " * n, "<html " + " lang" * (n // 5)):
        began = time.perf_counter()
        langid.visible_text(page), langid.declared_language(page)
        assert time.perf_counter() - began < 4, page[:20]
    page = '<html x lang="DE-at"><SCRIPT>a<b</script >b<!-- c -->d<nav>e</aside>f<style>g'
    assert langid.declared_language(page) == "de" and langid.visible_text(page).split() == ["b", "d", "f", "g"]


def test_language_id(spark):
    pages, docs = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("pages", "documents"))
    got = langid.op3(pages, docs).join(pages, "page_id").collect()
    assert len(got) == pages.count()
    right = [r.lang == re.search(r"//[^/]+/(\w\w)/", r.url)[1] for r in got if re.search(r"//[^/]+/(\w\w)/", r.url)]
    assert sum(right) >= 0.9 * len(right)


def test_language_id_equals_plain_fusion(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    some = {r.lang: r.text for r in docs.filter("length(text) > 400").collect()}
    page = lambda lang, t: f"<html lang='{lang}-XX'><head><script>the of and</script></head><body><p>{t}</p></body></html>"
    rows = [(i, f"http://www.h{i % 3}.example.com/{i}", page(x, some[x][:200])) for i, x in enumerate(sorted(some) * 6)]
    rows += [(100, None, None), (101, "http://[bad", ""), (102, "http://h1.example.com", "<html lang=de><p>1 2 3</p>"), (103, "http://10.0.0.1/", page("zz", "")), rows[0]]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("lang", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = {r.page_id: r for r in langid.op3(pages, docs).collect()}
    langs, table = langid.fit(docs)
    like = [langid.text_posterior(langid.visible_text(h or "").encode(), table) for _, _, h in rows]
    hosts, said = [langid.host_of(u) for _, u, _ in rows], [langid.declared_language(h or "") for _, _, h in rows]
    every = sum(like)
    for (i, _, _), p, (host, suffix), d in zip(rows, like, hosts, said, strict=True):
        prior = (every + 1) / (every.sum() + len(langs))
        s = sum(x for x, (_, y) in zip(like, hosts, strict=True) if y == suffix)
        prior = (s + langid.SUFFIX_WEIGHT * prior) / (s.sum() + langid.SUFFIX_WEIGHT)
        own = np.maximum(sum(x for x, (y, z) in zip(like, hosts, strict=True) if (y, z) == (host, suffix)) - p, 0)
        prior = (own + langid.HOST_WEIGHT * prior) / (own.sum() + langid.HOST_WEIGHT)
        by = (sum(x for x, y in zip(like, said, strict=True) if y == d) + langid.SMOOTH) / (every + 20 * langid.SMOOTH)
        post = p * prior * by
        assert got[i].lang == langs[int(post.argmax())] and got[i].confidence == pytest.approx(post.max() / post.sum(), abs=2e-6)
    assert langid.op3(pages.limit(0), docs).count() == 0
    assert {r.lang for r in langid.op3(pages, docs.limit(0)).collect()} == {None}
    assert math.isclose(sum(got[100].confidence for _ in [0]), got[100].confidence)
