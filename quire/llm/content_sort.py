"""Exact duplicates by sorting contents.

Texts are equal when nothing but whitespace tells them apart. Spark's sampled
splitters deal the rows to ranges of the normalised bytes: the splitters hold
the first PREFIX characters, the SHA-256, the row's rank inside its group and
its id, so they stay small however long texts are, and a group with a third of
all rows is spread over many ranges. Each range is sorted with spilling, which
puts equals side by side in the order in which they are kept, and neighbours'
whole normalised texts are compared. A group that goes on in the next range
meets there through its range's first and last text; that table has at most two
rows for each task.

Defined results: null text counts as empty; of a group the row with the most
code points stays, then the smallest doc_id, null last; of rows that repeat a
doc_id and a length, one stays; a null doc_id is a row like any other and may be
a keep_id; an empty table gives no rows; other columns are ignored; ids keep
their type. Texts with the same first characters and SHA-256 are taken to be
sorted together; they count as equal only if their bytes are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import stage

SPACES = " \t\n\x0b\x0c\r"
PREFIX = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[\\x20\\x09-\\x0D]+", "")


def sorted_contents(docs: DataFrame) -> DataFrame:
    """norm, sha, n_chars, id: in ranges of the content, sorted, the row that stays first in its group."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(normalised(F.col("text")).alias("norm"), F.length(text).alias("n_chars"), F.col("doc_id").alias("id"))
    rows = rows.withColumn("sha", F.sha2(F.col("norm").cast("binary"), 256))
    keys = [F.substring("norm", 1, PREFIX), F.col("sha"), F.col("n_chars").desc(), F.col("id").asc_nulls_last()]
    return rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("id", "sha", "norm")


def _finished(pieces: list[pa.Table], part: int, last: bool) -> pa.Table:
    """Rows of whole runs, with their run's head and size; edge texts only for a range's first and last run."""
    rows = pa.concat_tables(pieces)
    run = rows["run"].to_numpy()
    starts = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
    sizes = np.diff(np.r_[starts, len(run)])
    head = np.repeat(starts, sizes)
    kept = np.zeros(len(run), bool)
    kept[starts] = True
    texts: list[str | None] = [None] * len(run)
    for i in np.flatnonzero(kept & ((run == 0) | (last & (run == run[-1])))):
        texts[i] = rows["text"][i].as_py()
    return pa.table(
        {
            "doc_id": rows["id"], "keep_id": rows["id"].take(pa.array(head)), "group_size": np.repeat(sizes, sizes).astype(np.int64), "kept": kept,
            "text_sha256": rows["sha"], "part": np.full(len(run), part, np.int32), "run": run,
            "edge": pa.array(texts, pa.string()),
        }
    )


def _compared(batches):
    """Neighbours' whole texts compared; a run's rows are held until it ends, without their texts."""
    part, run, before, open_ = TaskContext.get().partitionId(), -1, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        norm = batch["norm"]
        new = np.empty(len(norm), bool)
        new[0] = before is None or norm[0].as_py() != before
        new[1:] = pc.not_equal(norm[1:], norm[:-1]).to_numpy(zero_copy_only=False)
        runs, before = run + np.cumsum(new), norm[-1].as_py()
        # a run's text is kept at its first row only
        texts: list[str | None] = [None] * len(norm)
        for i in np.flatnonzero(new & ((runs == 0) | (runs == runs[-1]))):
            texts[i] = norm[i].as_py()
        rows = pa.table({"id": batch["id"], "sha": batch["sha"], "run": runs.astype(np.int64), "text": pa.array(texts, pa.string())})
        run = int(runs[-1])
        tail = int(np.searchsorted(runs, run))
        if new.any():
            done = [*open_, rows.slice(0, tail)]
            if sum(len(x) for x in done):
                yield from _finished(done, part, False).to_batches()
            open_ = []
        open_.append(rows.slice(tail))
    if open_:
        yield from _finished(open_, part, True).to_batches()


def deduplicate(docs: DataFrame) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256: one row for each row of docs."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, keep_id {kind}, group_size long, kept boolean, text_sha256 string, part int, run long, edge string"
    rows = stage(sorted_contents(docs).mapInArrow(_compared, schema), "content-sort")
    spans = _spans(rows)
    found = rows.join(F.broadcast(spans), ["part", "run"], "left")
    spread = F.col("head").isNotNull()
    return found.select(
        "doc_id",
        F.when(spread, F.col("first_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(spread, F.col("rows")).otherwise(F.col("group_size")).alias("group_size"),
        (F.col("kept") & F.coalesce("head", F.lit(True))).alias("kept"),
        "text_sha256",
    )


def _spans(rows: DataFrame) -> DataFrame:
    """part, run, head, first_id, rows: groups that reach a range's border, at most two rows for each task that sorted."""
    order = Window.orderBy("part", "run")
    edges = rows.filter("edge is not null").select("part", "run", "keep_id", "group_size", F.col("edge").eqNullSafe(F.lag("edge").over(order)).alias("same"))
    numbered = edges.withColumn("span", F.sum((~F.col("same")).cast("int")).over(order))
    first = F.min_by(F.struct("keep_id"), F.struct("part", "run"))["keep_id"]
    sums = numbered.groupBy("span").agg(first.alias("first_id"), F.sum("group_size").alias("rows"))
    return numbered.join(sums, "span").select("part", "run", (~F.col("same")).alias("head"), "first_id", "rows")


def op12(docs: DataFrame) -> DataFrame:
    return deduplicate(docs)


SQL = r"""WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS n_chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS norm FROM documents),
    r AS (SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size, first_value(doc_id) OVER w AS keep_id, row_number() OVER w AS place
          FROM n WINDOW w AS (PARTITION BY norm ORDER BY n_chars DESC, doc_id NULLS LAST))
    SELECT doc_id, keep_id, group_size::BIGINT AS group_size, place = 1 AS kept, sha256(norm) AS text_sha256 FROM r"""
