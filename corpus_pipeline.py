"""The corpus pipeline: toxicity, near duplicates, secrets, mixing, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm import mixing, ngram_join, pieces, secrets, toxicity
from quire.session import prepare, stage, table, unused


#: Copies whose places the mix sends to all tasks, at most: some 12 MB.
DEALT = 500_000


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted toxic go; every other row stays as it is."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def with_rows(docs: DataFrame, name: str) -> tuple[DataFrame, str]:
    """docs with a key of its own for each row, written so that it is the same at every reading, and the key's column."""
    row = unused(docs, "row")
    return stage(docs.withColumn(row, F.monotonically_increasing_id()), name), row


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates stays, the one with the smallest doc_id, null last.

    Five words, similarity 0.8. Rows without doc_id or with a repeated one are compared like all others.
    """
    prepare(spark)
    rows, row = with_rows(docs, "pipeline-near-rows")
    keyed = rows.select(F.col(row).alias("doc_id"), "text")
    found = ngram_join.join(keyed, k=5, percent=80).select(F.col("doc_id").alias("key"), "component_id")
    ids = found.join(rows.select(F.col(row).alias("key"), "doc_id"), "key")
    best = ids.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key")).alias("best"))
    return rows.join(best.select(F.col("best.key").alias(row)), row, "left_semi").select(docs.columns)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced in the text by their kind; every document stays."""
    prepare(spark)
    return secrets.redact(docs).withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents, each as often (0, 1 or 2 times) as the mix takes most of it.

    Rows are dealt to the mix's shards, in the shards' locally shuffled order: the
    first copy where its first part was dealt to, the second where its last was. A
    file has whole ranges of places of shards, in order. Up to DEALT copies, of
    which only keys and places count, are sent to the texts, so that these travel
    once, to their shards; more are joined to them by shuffle first.
    """
    prepare(spark)
    keyed, row = with_rows(docs, "pipeline-mix-rows")
    few = keyed.select(F.col(row).alias("key_of_row"), "doc_id", "source", "text")
    mixed = mixing.mix(few, carry=("key_of_row",)).filter("taken > 0")
    times = F.floor(F.col("taken") / F.col("size") + 0.5).cast("int")
    copies = mixed.withColumn("times", times).filter("times > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
    first = F.when(F.col("copy") == 1, F.element_at("spans", 1)).otherwise(F.element_at("spans", -1))
    copies = copies.select(F.col("key_of_row").alias(row), F.struct(first["shard"].alias("shard"), first["place"].alias("place")).alias(unused(keyed, "dealt")))
    copies = stage(copies, "pipeline-mix-copies")
    copies = F.broadcast(copies) if copies.count() <= DEALT else copies
    placed = keyed.join(copies, row).select(F.struct(*docs.columns).alias("doc"), f"{unused(keyed, 'dealt')}.*", F.col(row).alias("key"))
    return mixing.local_order(placed, "key").select("doc.*")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with `ids`, their texts' piece ids, and `n_pieces`; every row stays."""
    prepare(spark)
    return pieces.encode(docs).withColumn("n_pieces", F.size("ids").cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("n-gram Jaccard join", near_duplicates),
    ("secret scans", secret_scan),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: Nearest examples and lattices have no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, f) in enumerate(STAGES):
        docs = f(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stage(docs, "pipeline-" + "".join(c if c.isalnum() else "-" for c in name))
    return docs
