"""The pipeline's stages against what each must do to the rows it gets."""

import re

from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from quire.llm import mixing, ngram_join, pieces, secrets, toxicity

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    by_stage = {}
    for name, f in pipeline.STAGES:
        before = docs
        docs = f(spark, docs, SF)
        assert docs.columns[: len(columns)] == columns, name
        docs = docs.cache()
        by_stage[name] = (before, docs)
    before, after = by_stage["toxicity"]
    scores = {r.doc_id: r.predicted for r in toxicity.score(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()}
    assert {r.doc_id for r in after.collect()} == {d for d, p in scores.items() if not p}
    before, after = by_stage["n-gram Jaccard join"]
    assert {r.doc_id for r in after.collect()} == {r.component_id for r in ngram_join.join(before, 5, 80).collect()}
    before, after = by_stage["secret scans"]
    old = {r.doc_id: r.text for r in before.collect()}
    new = {r.doc_id: r for r in after.collect()}
    assert old.keys() == new.keys()
    for d, t in old.items():
        assert (new[d].text == t) == (not [s for s in secrets.spans_of(t)[1] if s[0] != "endpoint"]) and new[d].n_chars == len(new[d].text)
    before, after = by_stage["mixing sources to target weights"]
    keyed = before.withColumn("key_of_row", F.monotonically_increasing_id())
    taken = {r.doc_id: r for r in mixing.mix(keyed, carry=("key_of_row",)).collect()}
    times = {}
    for r in after.collect():
        times[r.doc_id] = times.get(r.doc_id, 0) + 1
    assert times == {d: n for d, r in taken.items() if r["size"] and (n := int(r.taken / r["size"] + 0.5))}
    words = lambda rows: sum(len(re.findall(r"\S+", r.text)) for r in rows)
    assert abs(words(after.collect()) / words(before.collect()) - 1.5) < 0.1
    before, after = by_stage["SentencePiece encoding and decoding"]
    assert sorted(r.doc_id for r in before.collect()) == sorted(r.doc_id for r in after.collect())
    assert all(r.back == r.text for r in pieces.decode(after, to="back").collect())


def test_odd_rows_pass_every_stage(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (None, "some words without an id", "en", "a", 3), (3, "token=abcdefghijkl", "en", None, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in pipeline.STAGES:
        docs = f(spark, docs, SF)
        if name == "secret scans":
            assert docs.count() == 4
    docs.collect()


def test_clashing_names_pass_every_stage(spark):
    names = ["times", "d", "s", "copy", "h1", "h2", "_h1", "row", "row_", "dealt", "shard", "place", "rare", "key", "size", "node", "component_id", "n_pieces"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(80)
    docs = docs.unionByName(docs.limit(20)).select("*", *(F.concat(F.lit(n), F.col("doc_id").cast("string")).alias(n) for n in names)).cache()
    for name, f in pipeline.STAGES:
        before, docs = docs, f(spark, docs, SF).cache()
        assert docs.count() and set(before.columns) <= set(docs.columns), name
        if name.startswith("Sentence"):
            names.remove("n_pieces")
        assert all(r[n] == f"{n}{r.doc_id}" for r in docs.collect() for n in names), name


def test_rows_without_ids_or_with_repeated_ones(spark):
    text = lambda i: " ".join(f"w{i}x{j}" for j in range(40))
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(None, text(0), "en", "a", 1)] * 6 + [(7, text(1), "en", "a", 1)] * 3 + [(5, text(2), "en", "a", 1), (5, text(3), "en", "a", 1), (2, text(3), "en", "a", 1)]
    got = pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema).repartition(3), SF).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted([(0, text(0)), (7, text(1)), (5, text(2)), (2, text(3))])
    rows = [(d, text(i), "en", s, 1) for s in "abc" for d, n in ((None, 30), (9, 30)) for i in range(n)]
    docs = spark.createDataFrame(rows, schema).repartition(3).cache()
    taken = {}
    for r in mixing.mix(docs.withColumn("key_of_row", F.monotonically_increasing_id()), carry=("key_of_row",)).collect():
        if n := int(r.taken / r["size"] + 0.5):
            taken[r.doc_id, r.source] = taken.get((r.doc_id, r.source), 0) + n
    found = {}
    for r in pipeline.mix_sources(spark, docs, SF).collect():
        found[r.doc_id, r.source] = found.get((r.doc_id, r.source), 0) + 1
    assert found == taken and any(n % 30 for n in found.values())


def test_run(spark):
    assert pipeline.run(spark, SF).count() > 0


def test_the_mix_is_dealt_to_its_shards(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    keyed = docs.withColumn("key_of_row", F.monotonically_increasing_id())
    want, places = [], {}
    for r in mixing.mix(keyed, carry=("key_of_row",)).filter("taken > 0").collect():
        for copy in range(int(r.taken / r["size"] + 0.5)):
            span = r.spans[-1] if copy else r.spans[0]
            places[r.doc_id, copy] = (span.shard, span.place)
            want.append(r.doc_id)
    pipeline.mix_sources(spark, docs, SF).withColumn("part", F.spark_partition_id()).write.parquet(str(tmp_path / "mixed"))
    files, got, where = sorted((tmp_path / "mixed").glob("*.parquet")), [], {}
    for f in files:
        ids = [r.doc_id for r in spark.read.parquet(str(f)).select("doc_id").collect()]
        got += ids
        at = (-1, 0)
        for d in ids:
            # of the copies' places the next in order
            at = min(p for p in (places.get((d, 0)), places.get((d, 1))) if p and p >= at)
            where.setdefault((at[0], (at[1] % 2**64) >> 56), set()).add(f.name)
    assert sorted(got) == sorted(want) and {s for s, _ in where} == set(range(8))
    assert all(len(names) == 1 for names in where.values())
