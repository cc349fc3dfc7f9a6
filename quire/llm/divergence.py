"""How far sources stray from each other and from their language: exact sums by DuckDB over shards, merged by Spark.

1. Each task counts its documents' terms in DuckDB, so that a frequent term is
   one row a task and source, not one an occurrence.
2. Shards are hashes of (lang, term). Each reads its rows in order of the term,
   adds them up in SQL, a stretch of whole terms at a time, and keeps the terms
   of MIN_DOCS documents and more. Only sums of the open term are carried, so
   memory doesn't grow with a shard or with a frequent term.
3. Spark sums N and V, and shards add up, again in SQL, what their terms give
   to each pair of sources. A source without a term has the same share p for
   all such terms, its floor. So only pairs that both have a term are joined:
   with z the floors, the sum over all terms of f(p, q) is that of f(p, zq) over
   the source's terms, of f(zp, q) over the other's, of f(zp, zq) over the rest,
   and for each term of both f(p, q) - f(p, zq) - f(zp, q) + f(zp, zq). The
   first two need only how many terms have each share.
4. Spark merges the partial sums and ranks them.

Defined results: null lang, source and text are empty; a document without terms
still makes its source a group; rows that repeat a doc_id are documents of their
own; a lang without kept terms has pairs of value 0; ties are ordered by UTF-8;
an empty table gives no rows; other columns are ignored. All sums are integers
of up to 38 digits.
"""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.session import stage

MIN_DOCS, TOP, SCALE = 3, 200, 1_000_000_000
#: Longer texts are cut between terms before they are split; rows that a task holds before it gives its counts on; rows that a shard adds up at a time.
PIECE, HELD, STRETCH = 1 << 20, 400_000, 100_000
#: Bytes to what stands for them: letters in lower case, a space for the rest of ASCII, all else as it is.
PLAIN = np.array([b if b >= 0x80 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256)], np.uint8)


def _database():
    """A database in memory for one task: one thread, a fixed bound, no files."""
    db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "600MB"})
    db.execute("SET temp_directory = ''")
    return db


def _plain(texts: pa.Array) -> list[tuple[int, bytes]]:
    """(row, piece): every text with PLAIN applied, long ones cut at spaces."""
    texts = texts.cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or bounds[0] == bounds[-1]:
        return []
    data = PLAIN[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]].tobytes()
    out = []
    for row, (a, b) in enumerate(zip((bounds[:-1] - bounds[0]).tolist(), (bounds[1:] - bounds[0]).tolist(), strict=True)):
        while b - a > PIECE:
            cut = data.rfind(b" ", a, a + PIECE)
            cut = cut if cut > a else data.find(b" ", a + PIECE, b)
            if cut < 0:
                break
            out.append((row, data[a:cut]))
            a = cut + 1
        out.append((row, data[a:b]))
    return out


_COUNT = """INSERT INTO held
    WITH words AS (SELECT row, unnest(string_split(piece, ' ')) AS term FROM pieces),
        own AS (SELECT row, term, count(*) AS n FROM words WHERE term <> '' GROUP BY row, term)
    SELECT lang, source, term, sum(n) AS n, count(*) AS docs FROM own JOIN docs USING (row) GROUP BY lang, source, term
    UNION ALL SELECT lang, source, NULL, 0, count(*) FROM docs GROUP BY lang, source"""
_HELD = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM held GROUP BY ALL"
COUNTS = "lang string, source string, term string, n long, docs long"


def _counted(batches):
    """Counts of a task's documents by lang, source and term; a row without a term for each lang and source."""
    db, held = _database(), 0
    db.execute("CREATE TABLE held (lang VARCHAR, source VARCHAR, term VARCHAR, n BIGINT, docs BIGINT)")
    for batch in batches:
        found = _plain(batch["text"])
        docs = pa.table({"row": np.arange(batch.num_rows), "lang": batch["lang"], "source": batch["source"]})  # noqa: F841  read by name in SQL
        rows, texts = [r for r, _ in found], pa.array([t for _, t in found], pa.binary()).cast(pa.string())
        pieces = pa.table({"row": pa.array(rows, pa.int64()), "piece": texts})  # noqa: F841
        held += db.execute(_COUNT).fetchone()[0]
        if held > HELD:
            whole = db.sql(_HELD).to_arrow_table()
            db.execute("DELETE FROM held")
            if len(whole) > HELD // 2:
                yield from whole.to_batches()
                held = 0
            else:
                held = db.execute("INSERT INTO held SELECT * FROM whole").fetchone()[0]
    yield from db.sql(_HELD).to_arrow_table().to_batches()


def _gathered(batches):
    """Tables of STRETCH rows and more, the last one of what is left."""
    some, n = [], 0
    for batch in batches:
        if batch.num_rows:
            some.append(batch)
            n += batch.num_rows
        if n >= STRETCH:
            yield pa.Table.from_batches(some)
            some, n = [], 0
    if some:
        yield pa.Table.from_batches(some)


def _stretches(batches, add: str):
    """(db) with the table `rows` holding whole terms of a shard in order; the last term's rows, added up by `add`, go into the next stretch."""
    db, carried = _database(), None
    for more in _gathered(batches):
        read = more if carried is None else pa.concat_tables([carried, more])  # noqa: F841
        db.execute(f"CREATE OR REPLACE TEMP TABLE rows AS {add}")
        last = "(lang, coalesce(term, '')) = (SELECT (lang, coalesce(term, '')) FROM read LIMIT 1 OFFSET (SELECT count(*) - 1 FROM read))"
        carried = db.sql(f"SELECT * FROM rows WHERE {last}").to_arrow_table().cast(more.schema)
        db.execute(f"DELETE FROM rows WHERE {last}")
        yield db
    if carried is not None:
        db.execute("CREATE OR REPLACE TEMP TABLE rows AS SELECT * FROM carried")
        yield db


_ADD_COUNTS = "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(docs)::BIGINT AS docs FROM read GROUP BY ALL"
_KEEP = f"""SELECT lang, source, term, n, (term IS NOT NULL AND row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS terms
    FROM rows QUALIFY term IS NULL OR sum(docs) OVER (PARTITION BY lang, term) >= {MIN_DOCS}"""
KEPT = "lang string, source string, term string, n long, terms long"


def _kept(batches):
    """Of a shard, in order of the term: the kept terms' counts by source; `terms` is 1 in one row of each."""
    for db in _stretches(batches, _ADD_COUNTS):
        yield from db.sql(_KEEP).to_arrow_table().to_batches()


def _p(n: str, whole: str, v: str) -> str:
    return f"(1 + ({SCALE}::HUGEINT * ({n} + 1)) // ({whole} + {v}))::HUGEINT"


def _f(p: str, q: str) -> str:
    return f"((({p}) - ({q})) * (({p}) - ({q})) // ({q}))"


_SHARES = f"""CREATE OR REPLACE TEMP TABLE shares AS
    SELECT lang, source, term, {_p("n", "whole", "v")} AS p, {_p("0", "whole", "v")} AS z, {_p("sum(n) OVER (PARTITION BY lang, term)", "lang_whole", "v")} AS q FROM rows"""
_TERMS = f"""SELECT 'term' AS part, lang, source, term AS item, {_f("p", "q")}::DECIMAL(38, 0) AS value, 1::BIGINT AS times FROM shares WHERE p > q
    QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {TOP}"""
_PAIRS = f"""SELECT 'pair', a.lang, a.source, b.source, sum({_f("a.p", "b.p")} - {_f("a.p", "b.z")} - {_f("a.z", "b.p")} + {_f("a.z", "b.z")})::DECIMAL(38, 0), 1::BIGINT
    FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL"""
_LEVELS = "SELECT 'level', lang, source, NULL, p::DECIMAL(38, 0), count(*)::BIGINT FROM shares GROUP BY ALL"
_SUMS = """SELECT part, lang, source, item, sum(value)::DECIMAL(38, 0) AS value, 1::BIGINT AS times FROM sums WHERE part = 'pair' GROUP BY ALL
    UNION ALL SELECT part, lang, source, item, value, sum(times)::BIGINT FROM sums WHERE part = 'level' GROUP BY ALL"""
PARTIAL = "part string, lang string, source string, item string, value decimal(38,0), times long"


def _partial(batches):
    """Of a shard: its best terms, its part of each pair's sum, and how many of a source's terms have each share."""
    db, held = None, 0
    for db in _stretches(batches, "SELECT * FROM read"):
        db.execute("CREATE TEMP TABLE IF NOT EXISTS sums (part VARCHAR, lang VARCHAR, source VARCHAR, item VARCHAR, value DECIMAL(38, 0), times BIGINT)")
        db.execute(_SHARES)
        yield from db.sql(_TERMS).to_arrow_table().to_batches()
        held += db.execute(f"INSERT INTO sums {_PAIRS} UNION ALL {_LEVELS}").fetchone()[0]
        if held > HELD:
            yield from db.sql(_SUMS).to_arrow_table().to_batches()
            db.execute("DELETE FROM sums")
            held = 0
    if held:
        yield from db.sql(_SUMS).to_arrow_table().to_batches()


def _divergence(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / q) of longs; shares are at most 10^9 + 1, so nothing overflows."""
    return F.call_function("div", (p - q) * (p - q), q)


def _in_order(df: DataFrame, *columns: str) -> DataFrame:
    return df.repartition("lang", "term").sortWithinPartitions("lang", "term").select(*columns)


def kept_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n of the kept terms, and a row without a term for every group."""
    empty = F.lit("")
    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), empty).alias(c) for c in ("lang", "source", "text")))
    counts = rows.mapInArrow(_counted, COUNTS)
    return stage(_in_order(counts, "lang", "source", "term", "n", "docs").mapInArrow(_kept, KEPT), "divergence-kept")


def groups_of(kept: DataFrame) -> DataFrame:
    """lang, source, whole (N), v (V), lang_whole, z (the share of a term that the source hasn't) and mine, the source's kept terms."""
    own = kept.groupBy("lang", "source").agg(F.sum("n").alias("whole"), F.count("term").alias("mine"), F.sum("terms").alias("terms"))
    by = Window.partitionBy("lang")
    own = own.withColumn("v", F.sum("terms").over(by)).withColumn("lang_whole", F.sum("whole").over(by)).drop("terms")
    return stage(own.withColumn("z", F.when(F.col("whole") + F.col("v") > 0, 1 + F.expr(f"{SCALE} div (whole + v)"))), "divergence-groups")


def audit(docs: DataFrame, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank."""
    kept = kept_counts(docs)
    groups = groups_of(kept)
    rows = kept.filter("term is not null").join(groups.select("lang", "source", "whole", "v", "lang_whole"), ["lang", "source"])
    partial = stage(_in_order(rows, "lang", "source", "term", "n", "whole", "v", "lang_whole").mapInArrow(_partial, PARTIAL), "divergence-sums")
    terms = partial.filter("part = 'term'").select("lang", "source", "part", "item", F.col("value").cast("long").alias("value"))
    return _ranked(terms, top).unionByName(_ranked(_pairs(partial, groups), None))


def _pairs(partial: DataFrame, groups: DataFrame) -> DataFrame:
    """All ordered pairs of a lang's sources with their sums."""
    whole = "decimal(38,0)"
    one = groups.select("lang", "source", F.col("z").alias("zp"), F.col("mine").alias("p_terms"), "v")
    two = groups.select(F.col("lang").alias("l"), F.col("source").alias("item"), F.col("z").alias("zq"), F.col("mine").alias("q_terms"))
    each = one.join(two, (F.col("lang") == F.col("l")) & (F.col("source") != F.col("item"))).drop("l")
    rest = F.coalesce(_divergence(F.col("zp"), F.col("zq")), F.lit(0)).cast(whole) * (F.col("v") - F.col("p_terms") - F.col("q_terms"))
    floors = each.select("lang", "source", "item", rest.cast(whole).alias("value"))
    level = partial.filter("part = 'level'").groupBy("lang", "source", F.col("value").cast("long").alias("p")).agg(F.sum("times").alias("times"))
    met = level.join(two, (F.col("lang") == F.col("l")) & (F.col("source") != F.col("item")))
    times = F.col("times").cast("decimal(18,0)")
    mine = (_divergence(F.col("p"), F.col("zq")).cast("decimal(19,0)") * times).alias("mine")
    theirs = (_divergence(F.col("zq"), F.col("p")).cast("decimal(19,0)") * times).alias("theirs")
    met = met.select("lang", "source", "item", mine, theirs).groupBy("lang", "source", "item").agg(F.sum("mine").alias("mine"), F.sum("theirs").alias("theirs"))
    sides = [met.select("lang", "source", "item", F.col("mine").cast(whole).alias("value")), met.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("theirs").cast(whole).alias("value"))]
    both = partial.filter("part = 'pair'").select("lang", "source", "item", "value")
    parts = floors.unionByName(both).unionByName(sides[0]).unionByName(sides[1])
    sums = parts.groupBy("lang", "source", "item").agg(F.sum("value").cast("long").alias("value"))
    return sums.select("lang", "source", F.lit("pair").alias("part"), "item", "value")


def _ranked(rows: DataFrame, top: int | None) -> DataFrame:
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = rows.withColumn("rank", F.row_number().over(order).cast("int"))
    return ranked if top is None else ranked.filter(F.col("rank") <= top)


def op11(docs: DataFrame) -> DataFrame:
    return audit(docs)


SQL = r"""WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    c AS (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL),
    k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT row) >= 3),
    v AS (SELECT lang, count(k.term) AS v FROM (SELECT DISTINCT lang FROM d) LEFT JOIN k USING (lang) GROUP BY lang),
    g AS (SELECT DISTINCT lang, source FROM d),
    t AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS whole, v.v,
            sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, k.term) AS lang_n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS lang_whole
          FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    s AS (SELECT lang, source, term, n, (1 + (1000000000::HUGEINT * (n + 1)) // (whole + v)) AS p, (1 + (1000000000::HUGEINT * (lang_n + 1)) // (lang_whole + v)) AS q FROM t),
    pair AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(pair.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN pair ON pair.lang = a.lang AND pair.source = a.source AND pair.item = b.source),
    terms AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM s WHERE n > 0 AND p > q),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200"""
