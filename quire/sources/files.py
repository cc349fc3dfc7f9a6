"""Files as DataFrames: folders of PDFs, a manifest of documents, and PDFs made from rows."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.functions import limits

SCHEMA = "path string, length long, content binary"
MANIFEST = "id string, number string, type string, title string, pdfUrl string, pdfPath string, fileSize long"


def read_folder(spark: SparkSession, folder: str, options: dict | None = None) -> DataFrame:
    """path, modificationTime, length, content of every .pdf below the folder, any case.

    Files above maxInputBytes are dropped by their length, before they are read.
    """
    most = int(limits.merged(options)["maxInputBytes"])
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.filter((F.col("length") <= most) & F.lower("path").endswith(".pdf"))


def too_large(spark: SparkSession, folder: str, options: dict | None = None) -> DataFrame:
    """path and length of the files that read_folder leaves out for their size; contents are not read."""
    most = int(limits.merged(options)["maxInputBytes"])
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select("path", "length").filter((F.col("length") > most) & F.lower("path").endswith(".pdf"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A manifest of documents as JSON, in order. It is data and is never run."""
    rows = spark.read.schema(f"{MANIFEST}, _corrupt string").option("multiLine", "true").option("columnNameOfCorruptRecord", "_corrupt").json(path)
    return rows.filter("_corrupt is null").drop("_corrupt").withColumn("ordinal", F.monotonically_increasing_id()).withColumn("uploaded", F.lit(False))


def with_upload(manifest: DataFrame, title: str, path: str, size: int) -> DataFrame:
    """The manifest with one uploaded document before all others, in place of any uploaded before."""
    spark = manifest.sparkSession
    row = [("upload", None, None, title, None, path, size, -1, True)]
    new = spark.createDataFrame(row, f"{MANIFEST}, ordinal long, uploaded boolean")
    return new.unionByName(manifest.filter(~F.col("uploaded")))


def made(rows: DataFrame, key: str, columns: list[str], make) -> DataFrame:
    """path (the key as text), length, content: make(values of columns) for each row. A shuffle-free stage."""

    def run(batches):
        for b in batches:
            files = [make(*v) for v in zip(*(b.column(c).to_pylist() for c in columns), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("_key"), pa.array([len(f) for f in files], pa.int64()), pa.array(files, pa.binary())], ["path", "length", "content"]
            )

    return rows.select(F.col(key).cast("string").alias("_key"), *columns).mapInArrow(run, SCHEMA)
