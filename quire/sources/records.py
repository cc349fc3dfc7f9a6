"""Objects of very large files as a data source whose splits end at objects, so that one file is many tasks.

    records.register(spark)
    spark.read.format("pdf_objects").option("split", 1 << 26).schema("obj_id long, start long").load("s3://bucket/big.pdf")

A file is cut behind each `endobj`. A piece holds an object if there is a header
(`12 0 obj`) in it, the first of which counts, and an `endobj` ends it. A split has
the pieces that begin behind its start and up to its end, and reads on where the
last of them goes on, so every object is read once, whatever the splits. Unlike a
walk over streams' lengths, which can't begin in the middle of a file, this takes an
`endobj` inside a stream's data for the object's end.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.types import StructType

from quire.session import prepare

NAME, SPLIT, LONGEST, READ = "pdf_objects", 64 << 20, 256 << 20, 1 << 20
#: Splits, beyond which a task has several, and what it then has at least, in bytes.
MOST, LEAST = 2048, 4 << 20
END = b"endobj"
HEADER = re.compile(rb"(\d+)[\s\x00]+(\d+)[\s\x00]+obj\b")
SCHEMA = "path string, start long, length long, obj_id long, generation int, body binary"
TESTS = {EqualTo: lambda a, b: a == b, GreaterThan: lambda a, b: a > b, GreaterThanOrEqual: lambda a, b: a >= b, LessThan: lambda a, b: a < b, LessThanOrEqual: lambda a, b: a <= b, In: lambda a, b: a in b}


class Split(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        self.path, self.start, self.end = path, start, end


def _opened(path: str):
    """(file system, path in it): any that Arrow knows, local paths too."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


class ObjectReader(DataSourceReader):
    """Reads the columns of `schema` only; tests of path choose files, tests of obj_id and generation are made before a body is copied."""

    def __init__(self, schema: StructType, options: dict):
        self.columns, self.schema = schema.names, schema
        strange = set(self.columns) - {c.split()[0] for c in SCHEMA.split(", ")}
        if strange:
            raise ValueError(f"no such columns: {', '.join(sorted(strange))}")
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.split, self.longest, self.most = int(options.get("split", SPLIT)), int(options.get("longest", LONGEST)), int(options.get("most", MOST))
        self.last = options.get("last", "false").lower() == "true"
        self.tests: list[tuple[type, str, object]] = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  Spark's name
        for f in filters:
            column = getattr(f, "attribute", ())
            if type(f) in TESTS and column in (("path",), ("obj_id",), ("generation",)):
                self.tests.append((type(f), column[0], f.value))
            else:
                yield f

    def _passes(self, column: str, value) -> bool:
        return all(TESTS[kind](value, other) for kind, c, other in self.tests if c == column)

    def partitions(self):
        from pyarrow import fs

        found = []
        for path in self.paths:
            system, inside = _opened(path)
            info = system.get_file_info(inside)
            if info.type == fs.FileType.NotFound:
                raise FileNotFoundError(path)
            files = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inside, recursive=True))
            for f in files:
                shown = path if f.path == inside else path.rstrip("/") + f.path[len(inside.rstrip("/")) :]
                if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")) and self._passes("path", shown):
                    found.append((shown, f.size))
        splits = sum(math.ceil(size / self.split) for _, size in found)
        wide = self.split * (1 if splits <= self.most else max(math.ceil(splits / self.most), math.ceil(LEAST / self.split)))
        return [Split(path, at, min(at + wide, size)) for path, size in found for at in range(0, size, wide)] or [Split("", 0, 0)]

    def read(self, partition: Split) -> Iterator:
        import pyarrow as pa

        if not partition.path:
            return
        kinds = {"path": pa.string(), "start": pa.int64(), "length": pa.int64(), "obj_id": pa.int64(), "generation": pa.int32(), "body": pa.binary()}
        with_body = "body" in self.columns
        tested = {c for _, c, _ in self.tests}

        def batch(rows):
            columns = dict(zip(("start", "length", "obj_id", "generation", "body"), zip(*rows, strict=True), strict=True)) | {"path": [partition.path] * len(rows)}
            return pa.record_batch([pa.array(columns[n], kinds[n]) for n in self.columns], names=self.columns)

        rows, held = {}, 0
        for start, data, begin, end, length in self._pieces(partition):
            m = HEADER.search(data, begin, end)
            if not m:
                continue
            one, two = m.groups()
            if len(one) > 18 or len(two) > 9:
                continue
            found, generation = int(one), int(two)
            if tested and not (self._passes("obj_id", found) and self._passes("generation", generation)):
                continue
            skipped = m.start() - begin
            body = data[m.end() : end - len(END)] if with_body and length == end - begin and length <= self.longest else None
            rows[found if self.last else start] = (start + skipped, length - skipped, found, generation, body)
            held += 50 + (len(body) if body else 0)
            if held > READ:
                yield batch(rows.values())
                rows, held = {}, 0
        if rows:
            yield batch(rows.values())

    def _pieces(self, split: Split):
        """(start, data, begin, end, length) of the split's pieces, which are data[begin:end]; of those beyond `longest` the first bytes only."""
        system, inside = _opened(split.path)
        with system.open_input_file(inside) as file:
            # an `endobj` that ends behind the split's start may begin before it
            at = max(0, split.start - len(END) + 1)
            file.seek(at)
            data, begin, cut, start = b"", 0, 0, split.start
            owned = split.start == 0
            while True:
                end = data.find(END, max(begin, cut))
                if end < 0:
                    at, data, begin = at + begin, data[begin:], 0
                    keep = self.longest if owned else 0
                    cut = max(len(data) - len(END) + 1, 0)
                    if cut > keep:  # what is beyond is looked through, not kept
                        at, data, cut = at + cut - keep, data[:keep] + data[cut:], keep
                    # no more than the split has; behind its end only what its last piece takes, in growing steps
                    left = split.end - at - len(data)
                    more = file.read(min(left, READ) if left > 0 else min(max(len(data), READ >> 6), READ << 3))
                    if not more:
                        return
                    data += more
                    continue
                end += len(END)
                after = at + end
                if owned:
                    yield start, data, begin, end if after - start == end - begin else min(end, begin + self.longest), after - start
                if after > split.end:
                    return
                begin, cut, start, owned = end, 0, after, after > split.start


class ObjectSource(DataSource):
    """path, start, length, obj_id, generation, body of every object of the files.

    Options: path (files or folders, by commas), split (bytes), longest (objects
    beyond it have a null body), most (splits, beyond which a task has several),
    last (true: of objects with one id that stand close together in a file, all
    but the last may be left out, as `last_objects` would). A schema of fewer
    columns reads no more than those.
    """

    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> ObjectReader:
        return ObjectReader(schema, self.options)


def register(spark: SparkSession) -> None:
    """Make the source known, with its filters pushed down."""
    prepare(spark)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ObjectSource)


def last_objects(objects: DataFrame) -> DataFrame:
    """Of objects with one id in a file, the last."""
    rest = [c for c in objects.columns if c not in ("path", "obj_id")]
    # rows are sorted by these keys: by the number first, since paths are long and begin alike
    return objects.groupBy("obj_id", "path").agg(F.max_by(F.struct(*rest), "start").alias("x")).select("path", "obj_id", "x.*")


def packed_objects(streams: DataFrame, direct: DataFrame) -> DataFrame:
    """path, obj_id, compressed_in, value: members of object streams that are no direct objects, the first of each id.

    streams: path, obj_id, first, n, text (decoded): n pairs of id and place, then
    from place `first` on the members' text, each up to the next place.
    """
    numbers = F.transform(F.split(F.trim(F.regexp_replace(F.substring("text", F.lit(1), F.col("first")), "[\\s\\x00]+", " ")), " "), lambda x: x.try_cast("long"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.struct(i.alias("i"), F.get("numbers", i * 2).alias("id"), F.get("numbers", i * 2 + 1).alias("at")))
    rows = streams.filter("n > 0").withColumn("numbers", numbers).withColumn("pairs", F.filter(pairs, lambda p: p["id"].isNotNull() & p["at"].isNotNull()))
    stops = lambda p: F.array_min(F.filter(F.transform("pairs", lambda q: q["at"]), lambda a: a > p["at"]))
    text = lambda p: F.substring("text", F.col("first") + p["at"].cast("int") + 1, F.coalesce((stops(p) - p["at"]).cast("int"), F.length("text")))
    each = rows.select("path", F.col("obj_id").alias("compressed_in"), F.explode(F.transform("pairs", lambda p: F.struct(p["i"].alias("i"), p["id"].alias("obj_id"), F.trim(text(p)).alias("value")))).alias("m"))
    first = each.select("path", "compressed_in", "m.*").groupBy("path", "obj_id").agg(F.min_by(F.struct("compressed_in", "value"), F.struct("compressed_in", "i")).alias("x"))
    return first.select("path", "obj_id", "x.*").join(direct.select("path", "obj_id"), ["path", "obj_id"], "left_anti")
