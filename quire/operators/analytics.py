"""Questions over the tables, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quire.operators.scans import as_of, running_sums
from quire.session import stage, unused

# The state of support of features.
PARTIAL = ["shading:paint", "transparency:soft-mask", "transparency:blend-mode", "transparency:group"]
UNSUPPORTED = ["text:clip-mode", "transparency:nonisolated-group", "transparency:knockout-group", "transparency:unsupported-soft-mask", "transparency:unsupported-blend-mode"]
FALLBACK = ["font:embedded-fallback", "font:form-resource-uncollected"]
KNOWN_FILTERS = ["FlateDecode", "Fl", "DCTDecode", "DCT", "ASCIIHexDecode", "AHx", "ASCII85Decode", "A85", "RunLengthDecode", "RL"]


def deduplicate(files: DataFrame, key: str = "sha256") -> DataFrame:
    """files with `duplicate_of`, the first path with the same content; null for that path itself.

    Groups are summed before they are joined back, so a file with many copies
    is no single task's load: the join is by content, and skewed joins split.
    """
    first = unused(files, "first")
    firsts = files.groupBy(key).agg(F.min("path").alias(first))
    return files.join(firsts, key).withColumn("duplicate_of", F.when(F.col("path") != F.col(first), F.col(first))).drop(first)


def feature_status(feature: Column) -> Column:
    """observed, partial, unsupported, fallback or unverified."""
    strange = feature.startswith("image:filter:") & ~F.regexp_replace(feature, "^image:filter:", "").isin(KNOWN_FILTERS)
    return (
        F.when(feature.isin("operator:BX", "operator:EX"), "observed")
        .when(feature.isin(PARTIAL), "partial")
        .when(feature.isin(UNSUPPORTED) | feature.startswith("operator:") | feature.startswith("shading:unsupported-type:") | strange, "unsupported")
        .when(feature.isin(FALLBACK), "fallback")
        .when(feature == "font:browser-install-unverified", "unverified")
        .otherwise("observed")
    )


def census_summary(features: DataFrame, examples: int = 5) -> DataFrame:
    """By feature: status, documents, pages, occurrences, and the first examples by file and page.

    Examples are picked by a ranked limit, which Spark applies before the
    shuffle, so a feature of every page gathers no list.
    """
    counted = features.groupBy("feature", "path", "page_no").agg(F.sum("n").alias("n"))
    sums = counted.groupBy("feature").agg(
        F.countDistinct("path").alias("documents"), F.count(F.lit(1)).alias("pages"), F.sum("n").alias("occurrences")
    )
    first = F.row_number().over(Window.partitionBy("feature").orderBy("path", "page_no"))
    picked = counted.withColumn("_r", first).filter(F.col("_r") <= examples)
    picked = picked.groupBy("feature").agg(F.array_sort(F.collect_list(F.struct(F.col("path").alias("file"), F.col("page_no").alias("page")))).alias("examples"))
    return sums.join(picked, "feature").withColumn("status", feature_status(F.col("feature")))


def top_features(summary: DataFrame, n: int = 25) -> DataFrame:
    """The most widespread features, in the report's order (names by code point)."""
    return summary.orderBy(F.desc("documents"), F.desc("pages"), "feature").limit(n)


def census_totals(documents: DataFrame, page_errors: DataFrame) -> DataFrame:
    """One row: files, parsed, pages, scanned pages and pages with errors, of files that are no duplicates."""
    wrong = page_errors.groupBy("path", "page_no").agg(F.max(F.col("fatal").cast("int")).alias("fatal"))
    wrong = wrong.agg(F.count(F.lit(1)).alias("page_errors"), F.coalesce(F.sum("fatal"), F.lit(0)).alias("failed"))
    sums = documents.agg(
        F.count(F.lit(1)).alias("files"), F.count_if(F.col("error").isNull()).alias("parsed"), F.coalesce(F.sum("pages"), F.lit(0)).alias("pages")
    )
    failed = F.col("pages") - wrong.select("failed").scalar()
    return sums.select("files", "parsed", "pages", failed.alias("scanned_pages"), wrong.select("page_errors").scalar().alias("page_errors"))


def parse_page_range(text: Column, count: Column) -> Column:
    """`all`, `*`, `3`, `1-5` and `1,3,7-9` as ascending distinct page indexes from 0; bad input raises."""
    source = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    parts = F.filter(F.transform(F.split(source, ","), lambda p: F.trim(p)), lambda p: p != "")

    def span(p):
        low = F.regexp_extract(p, r"^(\d+)", 1).cast("int")
        high = F.regexp_extract(p, r"(\d+)$", 1).cast("int")
        bounds = F.concat(F.lit("Page range must be between 1 and "), count.cast("string"), F.lit(", with ranges in ascending order."))
        return (
            F.when(~p.rlike(r"^\d+(\s*-\s*\d+)?$"), F.raise_error(F.concat(F.lit("Invalid page range: "), p)).cast("array<int>"))
            .when((low < 1) | (high > count) | (low > high), F.raise_error(bounds).cast("array<int>"))
            .otherwise(F.sequence(low - 1, high - 1))
        )

    chosen = F.array_sort(F.array_distinct(F.flatten(F.transform(parts, span))))
    everything = F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.expr("cast(array() as array<int>)"))
    return (
        F.when(source.isin("", "all", "*"), everything)
        .when(F.size(parts) == 0, F.raise_error(F.lit("Page range did not include any pages.")).cast("array<int>"))
        .otherwise(chosen)
    )


def page_runs(pages: DataFrame, keys: list[str], page: str) -> DataFrame:
    """keys, first, last of every run of consecutive pages: gaps and islands."""
    rows = pages.select(*keys, F.col(page).alias("_p")).distinct()
    island = F.col("_p") - F.row_number().over(Window.partitionBy(*keys).orderBy("_p"))
    return rows.withColumn("_i", island).groupBy(*keys, "_i").agg(F.min("_p").alias("first"), F.max("_p").alias("last")).drop("_i")


def compact_pages(pages: DataFrame, keys: list[str], page: str, to: str = "page_list") -> DataFrame:
    """keys with pages as text such as 1-3,7."""
    runs = page_runs(pages, keys, page)
    said = F.when(F.col("first") == F.col("last"), F.col("first").cast("string")).otherwise(F.concat_ws("-", "first", "last"))
    listed = F.array_sort(F.collect_list(F.struct("first", said.alias("said"))))
    return runs.groupBy(*keys).agg(F.concat_ws(",", F.transform(listed, lambda r: r["said"])).alias(to))


def page_selection(chosen: Column, count: Column, compact: Column) -> Column:
    """`9 pages` or `3 of 9 pages (1-2,5)`."""
    some = F.concat(F.size(chosen).cast("string"), F.lit(" of "), count.cast("string"), F.lit(" pages ("), compact, F.lit(")"))
    return F.when(F.size(chosen) == count, F.concat(count.cast("string"), F.lit(" pages"))).otherwise(some)


def upper_median(df: DataFrame, keys: list[str], value: str, to: str = "median") -> DataFrame:
    """The value at place floor(n / 2) in order, exactly; nulls don't count.

    Values are counted first, and places are running sums over ranges of the
    value, so no task sorts a key's values.
    """
    n, upto, whole = (unused(df, c) for c in ("n", "upto", "whole"))
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias(n))
    placed = running_sums(counted, keys, [value], {upto: whole}, **{upto: F.col(n)})
    middle = F.expr(f"{whole} div 2")
    return placed.filter((F.col(upto) > middle) & (F.col(upto) - F.col(n) <= middle)).select(*keys, F.col(value).alias(to))


def difference_rollup(diffs: DataFrame, keys: list[str]) -> DataFrame:
    """Sums, the mean change weighted by changed pixels, and the maximum, by keys and for all (null keys)."""
    changed = F.sum("changed")
    return diffs.rollup(*keys).agg(
        changed.alias("changed"), F.sum("substantial").alias("substantial"), F.sum("total").alias("total"), F.sum("red").alias("red"), F.sum("green").alias("green"),
        F.when(changed > 0, F.sum(F.col("mean") * F.col("changed")) / changed).otherwise(0.0).alias("mean"), F.max("max").alias("max"),
    )


def difference_text(total: Column, changed: Column, red: Column, green: Column, mean: Column, most: Column) -> Column:
    percent = F.when(total > 0, changed / total * 100).otherwise(0.0)
    return F.format_string("%.2f%% changed, red %d, green %d, mean %.1f, max %d", percent, red, green, mean, most)


def novel(new: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of new that seen has not."""
    return new.select(keys).distinct().join(seen.select(keys).distinct(), keys, "left_anti")


def keep_most_novel(corpus: DataFrame, novelty: str, most: int = 512, keep: int = 384) -> DataFrame:
    """All rows up to `most`; of more, the `keep` with the highest novelty."""
    n = corpus.agg(F.count(F.lit(1))).scalar()
    ranked = corpus.orderBy(F.desc(novelty)).limit(most + 1).withColumn("_n", n)
    return ranked.withColumn("_r", F.row_number().over(Window.orderBy(F.desc(novelty)))).filter((F.col("_n") <= most) | (F.col("_r") <= keep)).drop("_n", "_r")


def weighted_pick(corpus: DataFrame, weight: str, draws: int, seed: int) -> DataFrame:
    """`draws` rows, each picked with a chance in proportion to 1 + its weight: drawn numbers find their row as of cumulative sums."""
    upto, whole, start, at, row = (unused(corpus, c) for c in ("upto", "whole", "start", "at", "found"))
    mark = unused(corpus, "mark")
    summed = running_sums(corpus.withColumn(mark, F.xxhash64(*corpus.columns)), [], [mark, *corpus.columns], **{upto: F.col(weight) + 1})
    summed = stage(summed.select(*corpus.columns, (F.col(upto) - F.col(weight) - 1).alias(start), F.col(upto).alias(whole)), "weights")
    total = summed.agg(F.max(whole)).scalar()
    drawn = corpus.sparkSession.range(draws).select(F.col("id").alias("draw"), (F.rand(seed) * total).alias(at))
    picked = as_of(stage(drawn, "draws"), summed.drop(whole), [], at, start, row)
    return picked.select(*(F.col(row)[c].alias(c) for c in corpus.columns), "draw")


def unsupported_report(unsupported: DataFrame, keys: list[str]) -> DataFrame:
    """keys with one text: `operator: count` lines, the highest count first, then by name."""
    sums = unsupported.groupBy(*keys, "operator").agg(F.sum("n").alias("n"))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "operator", "n")))
    lines = F.transform(listed, lambda x: F.concat(x["operator"], F.lit(": "), x["n"].cast("string")))
    return sums.groupBy(*keys).agg(F.concat_ws("\n", lines).alias("report"))


def agreement(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """key, outcome of two parses (columns: key, pages, error): agree, both-rejected, accept-mismatch, page-mismatch."""
    a = first.select(F.col(key), F.col("pages").alias("_p1"), F.col("error").alias("_e1"), F.lit(True).alias("_h1"))
    b = second.select(F.col(key), F.col("pages").alias("_p2"), F.col("error").alias("_e2"), F.lit(True).alias("_h2"))
    both = a.join(b, key, "full_outer")
    ok1, ok2 = (F.coalesce(F.col(f"_h{i}"), F.lit(False)) & F.col(f"_e{i}").isNull() for i in (1, 2))
    return both.select(
        key,
        F.when(~ok1 & ~ok2, "both-rejected").when(ok1 != ok2, "accept-mismatch").when(F.col("_p1") != F.col("_p2"), "page-mismatch").otherwise("agree").alias("outcome"),
    )


def bounded_prefix(parts: DataFrame, keys: list[str], order: list[str], size: str, most: int) -> DataFrame:
    """Parts in order, up to the first whose running total is above `most`."""
    total = unused(parts, "total")
    return running_sums(parts, keys, order, **{total: F.col(size)}).filter(F.col(total) <= most).drop(total)


def resolve_references(values: DataFrame, objects: DataFrame, hops: int = 20) -> DataFrame:
    """values (path, ref, ...) with `value`, what ref stands for through up to `hops` + 1 objects.

    objects: path, obj_id, value as tagged JSON. A reference is {"r":id,...}; object 0 is none.
    Pointer doubling: objects that are references are joined with themselves
    until they jump 2, 4, 8 ... objects, and the jumps that make up `hops` are
    taken; where a chain ends earlier, jumps stay there. Only references travel.
    """
    target = F.get_json_object("value", "$.r").cast("long")
    links = objects.select("path", F.col("obj_id").alias("at"), target.alias("to")).filter("to <> 0")
    jumps = stage(links.dropDuplicates(["path", "at"]), "references")
    at, value = unused(values, "at"), unused(values, "held")
    now = values.drop("value").withColumn(at, F.col("ref").cast("long"))

    def follow(rows: DataFrame, column: str, by: DataFrame) -> DataFrame:
        """column moved along by's jumps, where there is one."""
        step = by.select(F.col("path").alias("of_path"), F.col("at").alias("of_at"), F.col("to").alias("of_to"))
        moved = rows.join(step, (rows["path"] == step["of_path"]) & (rows[column] == step["of_at"]), "left")
        return moved.withColumn(column, F.coalesce("of_to", column)).drop("of_path", "of_at", "of_to")

    left = hops
    while left:
        if left & 1:
            now = follow(now, at, jumps)
        if left := left >> 1:
            jumps = stage(follow(jumps, "to", jumps), "references")
    ends = objects.select(F.col("path").alias("of_path"), F.col("obj_id").alias("of_at"), F.col("value").alias(value))
    found = now.join(ends, (now["path"] == ends["of_path"]) & (now[at] == ends["of_at"]) & (now[at] != 0), "left").drop("of_path", "of_at", at)
    return found.withColumnRenamed(value, "value")


# -- text and colours as columns


def document_label(number: Column, kind: Column, title: Column, doc_id: Column) -> Column:
    parts = F.concat_ws(" · ", *(F.when(c != "", c) for c in (number, kind, title)))
    return F.coalesce(F.when(parts != "", parts), F.when(doc_id != "", doc_id), F.lit("Untitled PDF"))


def join_url(base: Column, path: Column) -> Column:
    left = F.regexp_replace(F.coalesce(base, F.lit("")), "/$", "")
    return F.concat(left, F.lit("/"), F.regexp_replace(F.coalesce(path, F.lit("")), "^/", ""))


def escape_html(text: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def cmyk_to_rgb(c: Column, m: Column, y: Column, k: Column) -> list[Column]:
    """Bytes to bytes, half up."""
    return [F.floor(F.lit(255.0) * (1 - v / 255.0) * (1 - k / 255.0) + 0.5).cast("int") for v in (c, m, y)]


def gray_level(g: Column) -> Column:
    return F.floor(g * 255 + 0.5).cast("int")


def page_point(x: Column, y: Column, box: list[Column], rotate: Column, scale: float = 1.0) -> tuple[Column, Column]:
    """User space to the shown page: box is [x0, y0, x1, y1], rotation any number of degrees."""
    dx, dy = x - box[0], y - box[1]
    w, h = F.abs(box[2] - box[0]), F.abs(box[3] - box[1])
    turn = F.pmod(rotate, F.lit(360))
    px = F.when(turn == 90, dy).when(turn == 180, w - dx).when(turn == 270, h - dy).otherwise(dx)
    py = F.when(turn == 90, dx).when(turn == 180, dy).when(turn == 270, w - dx).otherwise(h - dy)
    return px * scale, py * scale


def clamp_side(value: Column, fallback: float) -> Column:
    return F.when((value > 0) & (value <= 1_000_000), value).otherwise(F.lit(fallback))


def base_font_name(base: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(base, F.lit(""))), "^[a-z]{6}\\+", ""), "[,_-]", "")


def font_style(base: Column) -> tuple[Column, Column, Column]:
    """(style, weight, family) that a base font's name asks for."""
    from quire.functions.fonts import FALLBACK_FAMILY, FAMILIES, WEIGHTS

    name = base_font_name(base)
    style = F.when(name.contains("italic") | name.contains("oblique"), "italic").otherwise("normal")
    weight = F.lit("400")
    for word, w in reversed(WEIGHTS):
        weight = F.when(name.contains(word), w).otherwise(weight)
    family = F.lit(FALLBACK_FAMILY)
    for names, f in reversed(FAMILIES):
        hit = F.lit(False)
        for n in names:
            hit = hit | name.contains(n)
        family = F.when(hit, f).otherwise(family)
    return style, weight, F.when(name.contains("roboto") & name.contains("mono"), "Roboto Mono, ui-monospace, monospace").otherwise(family)
