"""A census that grows by batches: exact states that merge, so that nothing is read or parsed twice.

A state is a folder of tables, each written once for each batch:

- files: a row for each path of the batch with its content's number. Contents
  are numbered without gaps as they first occur, so duplicates are known across
  batches, and documents are bits.
- counts: by feature and bucket of 32,768 numbers, a bitmap of the documents, and
  the sums of pages and occurrences. Bitmaps of any batches and features can be
  joined by `or`, and count distinct documents exactly.
- examples: by feature, the first EXAMPLES pages of the batch.

The first path of a content may come in a later batch than the content. Only its
examples are then taken again; others that were dropped before stay dropped,
since paths only move forward.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException
from pyspark.sql.window import Window

from quire.operators.analytics import feature_status
from quire.operators.scans import running_sums
from quire.session import stage

EXAMPLES = 5
TABLES = {
    "files": "path string, sha256 string, number long, pages long, error string",
    "counts": "feature string, bucket long, documents binary, pages long, occurrences long",
    "examples": "feature string, number long, page_no int",
}


def read(spark: SparkSession, state: str, name: str) -> DataFrame:
    """A table of the state, with a column for the batch; empty before the first."""
    try:
        return spark.read.schema(f"{TABLES[name]}, batch string").option("basePath", f"{state}/{name}").parquet(f"{state}/{name}")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], f"{TABLES[name]}, batch string")


def originals(files: DataFrame) -> DataFrame:
    """number, path: each content's first path."""
    return files.groupBy("number").agg(F.min("path").alias("path"))


def add(state: str, batch: str, files: DataFrame, features: DataFrame) -> None:
    """Add a batch: files (path, sha256, pages, error) and features (path, page_no, feature, n) of its files.

    Features have to follow from a file's content alone. A path that occurs again
    with the same content is one file. A batch is added
    whole or, where its name is taken, refused; what a failed attempt left is
    written over. Only files with new contents count.
    """
    spark = files.sparkSession
    seen = read(spark, state, "files")
    if not seen.filter(F.col("batch") == batch).isEmpty():
        raise ValueError(f"batch {batch} is in the state already")
    files = stage(files.groupBy("path", "sha256").agg(F.max(F.col("pages").cast("long")).alias("pages"), F.max("error").alias("error")), "census-files")
    known = stage(seen.groupBy("sha256").agg(F.min("number").alias("number"), F.min("path").alias("known")), "census-known")
    begin = known.agg(F.coalesce(F.max("number"), F.lit(-1))).first()[0] + 1
    fresh = files.select("sha256").distinct().join(known, "sha256", "left_anti")
    fresh = running_sums(fresh, [], ["sha256"], number=F.lit(1).cast("long")).select("sha256", (F.col("number") + (begin - 1)).alias("number"), F.lit(None).cast("string").alias("known"))
    numbers = stage(known.unionByName(fresh), "census-numbers")
    own = files.join(numbers, "sha256")
    first = own.groupBy("number").agg(F.min("path").alias("first"), F.max("known").alias("known"))
    # a file to count is a new content's first path; one to show is a known content's with a path before those known
    first = stage(first.withColumn("counts", F.col("known").isNull()).filter(F.col("counts") | (F.col("first") < F.col("known"))).select("number", F.col("first").alias("path"), "counts"), "census-first")
    rows = features.filter("feature is not null").groupBy("path", "page_no", "feature").agg(F.sum("n").alias("n")).join(first, "path")
    rows = stage(rows, "census-rows")
    counted = rows.filter("counts")
    counts = counted.groupBy("feature", F.bitmap_bucket_number("number").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("number")).alias("documents"), F.count(F.lit(1)).alias("pages"), F.sum("n").cast("long").alias("occurrences")
    )
    place = F.row_number().over(Window.partitionBy("feature").orderBy("path", "page_no"))
    shown = rows.withColumn("place", place).filter(F.col("place") <= EXAMPLES).select("feature", "number", F.col("page_no").cast("int").alias("page_no"))
    for name, df in (("examples", shown), ("counts", counts), ("files", own.select("path", "sha256", "number", "pages", "error"))):
        df.write.mode("overwrite").parquet(f"{state}/{name}/batch={batch}")


def documents_by(spark: SparkSession, state: str, group: Column, name: str = "group") -> DataFrame:
    """name, documents: by any grouping of features, in how many documents one of them occurs, from bitmaps alone."""
    bits = _complete(read(spark, state, "counts"), read(spark, state, "files")).groupBy(group.alias(name), "bucket").agg(F.bitmap_or_agg("documents").alias("documents"))
    return bits.groupBy(name).agg(F.sum(F.bitmap_count("documents")).alias("documents"))


def _complete(rows: DataFrame, files: DataFrame) -> DataFrame:
    """rows of batches whose files are written, which is done last."""
    return rows.join(F.broadcast(files.select("batch").distinct()), "batch", "left_semi")


def summary(spark: SparkSession, state: str) -> DataFrame:
    """feature, status, documents, pages, occurrences, examples: what one census of all files would say."""
    files = read(spark, state, "files")
    counts = _complete(read(spark, state, "counts"), files).groupBy("feature", "bucket").agg(F.bitmap_or_agg("documents").alias("documents"), F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"))
    sums = counts.groupBy("feature").agg(F.sum(F.bitmap_count("documents")).alias("documents"), F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"))
    shown = _complete(read(spark, state, "examples"), files).select("feature", "number", "page_no").distinct().join(originals(files), "number")
    place = F.row_number().over(Window.partitionBy("feature").orderBy("path", "page_no"))
    shown = shown.withColumn("place", place).filter(F.col("place") <= EXAMPLES)
    listed = shown.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), F.col("page_no").alias("page")))).alias("examples"))
    return sums.join(listed, "feature").withColumn("status", feature_status(F.col("feature")))


def totals(spark: SparkSession, state: str) -> DataFrame:
    """One row: paths, contents, duplicates, parsed contents and their pages."""
    paths = read(spark, state, "files").groupBy("path", "number").agg(F.max("pages").alias("pages"), F.max("error").alias("error"))
    each = paths.groupBy("number").agg(F.count(F.lit(1)).alias("n"), F.max("pages").alias("pages"), F.max("error").alias("error"))
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return each.agg(
        count(F.sum("n")).alias("files"), F.count(F.lit(1)).alias("contents"), count(F.sum(F.col("n") - 1)).alias("duplicates"), F.count_if(F.col("error").isNull()).alias("parsed"),
        count(F.sum(F.when(F.col("error").isNull(), F.col("pages")))).alias("pages"),
    )


def compact(spark: SparkSession, state: str, to: str, batch: str = "all") -> None:
    """A new state with all batches as one, which takes as long to read as its features and files are many."""
    files = read(spark, state, "files")
    counts = _complete(read(spark, state, "counts"), files).groupBy("feature", "bucket").agg(F.bitmap_or_agg("documents").alias("documents"), F.sum("pages").alias("pages"), F.sum("occurrences").alias("occurrences"))
    shown = _complete(read(spark, state, "examples"), files).drop("batch").distinct()
    for name, df in (("examples", shown), ("counts", counts), ("files", files.drop("batch").distinct())):
        df.write.parquet(f"{to}/{name}/batch={batch}")
