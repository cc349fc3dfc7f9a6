"""Reports over folders: at once, and as files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.operators import analytics, stages
from quire.session import prepare, stage
from quire.sources import files as sources


def census_folder(spark: SparkSession, folder: str, options: dict | None = None, password: str = "") -> dict[str, DataFrame]:
    """The census of a folder: files (with duplicates), documents, features, summary, page_errors, totals.

    Files are told apart by content before any is parsed, and each is parsed
    once for each table. Files above the size cap are never read: they have a
    row with the error in documents, and count in the totals.
    """
    prepare(spark)
    read = sources.read_folder(spark, folder, options)
    large = stages.too_large_rows(sources.too_large(spark, folder, options), options)
    told = stage(analytics.deduplicate(read.select("path", "length", F.sha2("content", 256).alias("sha256"))), "census-files")
    unique = read.join(told.filter("duplicate_of is null").select("path"), "path", "left_semi")
    documents = stage(stages.documents(unique, options, password).unionByName(large), "census-documents")
    features = stage(stages.features(unique, options, password), "census-features")
    wrong = stage(stages.page_errors(unique, options, password), "census-errors")
    duplicates = told.filter("duplicate_of is not null").agg(F.count(F.lit(1)))
    return {
        "files": told, "documents": documents, "features": features, "page_errors": wrong, "summary": analytics.census_summary(features),
        "totals": analytics.census_totals(documents, wrong).withColumn("duplicates", duplicates.scalar()),
    }


def write_report(census: dict[str, DataFrame], path: str) -> None:
    """The summary as JSON lines and the tables as Parquet, below path."""
    for name, df in census.items():
        if name in ("summary", "totals"):
            df.write.mode("overwrite").json(f"{path}/{name}")
        else:
            df.write.mode("overwrite").parquet(f"{path}/{name}")


def stream_census(spark: SparkSession, folder: str, out: str, checkpoint: str, options: dict | None = None):
    """Follows a folder: each new file's features are appended below `out` once, whatever is rerun.

    Of files with the same content the first to arrive counts, which need not
    be the first by path. Files seen before are told by their content's hash
    in the stream's own state.
    """
    prepare(spark)
    schema = "path string, modificationTime timestamp, length long, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(folder)
    arriving = arriving.filter(F.lower("path").endswith(".pdf")).withColumn("sha256", F.sha2("content", 256))
    found = stages.features(arriving.dropDuplicates(["sha256"]), options)
    return found.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
