"""Files to tables: each stage parses a file in one task and gives rows of one table.

A file that cannot be used has a row with its error in `documents`, and none
elsewhere; no input makes a stage fail. Stages work file by file and need no
shuffle; `content` is dropped at once. To build several tables from many
files, stage the files by size first (`spread`).
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from quire.functions import codecs, graphics
from quire.functions.document import Document, load, shown
from quire.functions.fonts import style_of
from quire.functions.interpreter import Geometry, Interpreter
from quire.functions.limits import PdfError, merged
from quire.functions.values import number_text, to_json

DOCUMENTS = (
    "path string, sha256 string, bytes long, version string, pages int, objects int, direct_objects int, object_streams int, decoded_object_streams int, "
    "filters map<string,bigint>, active_content map<string,bigint>, warnings array<struct<stage:string,message:string>>, error string"
)
OBJECTS = "path string, obj_id long, generation int, scan_ord int, value string, stream binary, compressed_in long"
PAGES = "path string, page_no int, media_box array<double>, crop_box array<double>, rotate int, width double, height double, resources string, contents string"
TOKENS = "path string, page_no int, ord int, kind string, value string"
SPANS = (
    "path string, page_no int, ord int, text string, font string, resource string, size double, x double, y double, page_x double, page_y double, "
    "advance double, mode int, fill string, form_path string"
)
PAINTS = (
    "path string, page_no int, ord int, kind string, rule string, points string, fill string, stroke string, line_width double, alpha double, "
    "blend string, form_path string, detail string"
)
UNSUPPORTED = "path string, page_no int, operator string, n long"
FEATURES = "path string, page_no int, feature string, n long"
PAGE_ERRORS = "path string, page_no int, error string, fatal boolean"
FONTS = (
    "path string, font_ord int, name string, object_id long, subtype string, base_font string, has_embedded boolean, format string, error string, "
    "outline_loaded boolean, outline_usable boolean, to_unicode map<string,string>, widths map<int,double>, default_width double, is_cid boolean, "
    "code_widths array<int>, names map<int,string>, css_style string, css_weight string, css_family string"
)
IMAGES = (
    "path string, object_id long, width int, height int, bits int, filters array<string>, color_space string, has_mask boolean, has_soft_mask boolean, "
    "image_mask boolean, rgba binary, error string"
)
STREAMS = "path string, obj_id long, filters array<string>, data binary, error string"
GLYPHS = "path string, font_name string, glyph int, commands array<struct<cmd:string,args:array<double>>>"


def spread(files: DataFrame, partitions: int) -> DataFrame:
    """Files dealt out by a hash of their path, so that large ones don't stand together."""
    return files.repartition(partitions, F.xxhash64("path"))


def _stage(files: DataFrame, schema: str, rows_of: Callable[[str, bytes], Iterator[tuple]]) -> DataFrame:
    kinds = to_arrow_schema(_as_struct(schema))

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                out += rows_of(path, content or b"")
                if len(out) >= 20_000:
                    yield _batch(out, kinds)
                    out = []
            yield _batch(out, kinds)

    return files.select("path", "content").mapInArrow(run, schema)


def _as_struct(schema: str) -> StructType:
    return _parse_datatype_string(schema)


def _batch(rows: list[tuple], kinds: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, kinds, strict=True)], schema=kinds)


def _clean(text: str | None) -> str | None:
    """Text without lone surrogates, which no column can hold."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode("utf-8")


def _open(content: bytes, options: dict | None, password: str) -> tuple[Document | None, str | None]:
    try:
        return load(content, options, password), None
    except PdfError as e:
        return None, str(e)
    except Exception as e:  # whatever a hostile file brings about is its own error, not the job's
        return None, f"internal: {type(e).__name__}: {e}"


def _per_document(rows: Callable[[str, Document], Iterator[tuple]], options, password):
    def run(path: str, content: bytes):
        doc, _ = _open(content, options, password)
        if doc is None:
            return
        try:
            yield from list(rows(path, doc))
        except Exception:  # as in _open
            return

    return run


def _per_page(rows: Callable, options, password):
    """Rows of each page; a page that breaks off gives none."""

    def each(path: str, doc: Document):
        for page in doc.pages:
            try:
                yield from list(rows(path, doc, page))
            except (PdfError, RecursionError, ValueError, OverflowError, TypeError, ArithmeticError):
                continue

    return _per_document(each, options, password)


def too_large_rows(files: DataFrame, options: dict | None = None) -> DataFrame:
    """Rows of `documents` for files that are not read for their size (path, length)."""
    most = int(merged(options)["maxInputBytes"])
    error = F.concat(F.lit("PDF limit exceeded: Input PDF size "), F.col("length").cast("string"), F.lit(f" > {most}"))
    known = {"path": F.col("path"), "bytes": F.col("length"), "error": error}
    return files.select(*(known.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in _as_struct(DOCUMENTS)))


def broken_pages(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    """path, page_no, error of the pages whose content breaks off, which have no rows in the tables of operations, spans and paints."""

    def rows(path, doc):
        for page in doc.pages:
            try:
                Interpreter(doc, page).run()
            except Exception as e:  # as in _open
                yield path, page.number, str(e) if isinstance(e, PdfError) else f"internal: {type(e).__name__}: {e}"

    return _stage(files, "path string, page_no int, error string", _per_document(rows, options, password))


def documents(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    """One row for each file: what is in it, or why it can't be used."""

    def rows(path, content):
        sha = hashlib.sha256(content).hexdigest()
        doc, error = _open(content, options, password)
        if doc is None:
            yield (path, sha, len(content), None, None, None, None, None, None, None, None, [], _clean(error))
            return
        notes = [{"stage": s, "message": _clean(m)} for s, m in doc.warnings]
        yield (
            path, sha, len(content), _clean(doc.version()), len(doc.pages), len(doc.objects), doc.direct, doc.object_streams, doc.decoded_object_streams,
            sorted(doc.filters.items()), sorted(doc.active.items()), notes, None,
        )

    return _stage(files, DOCUMENTS, rows)


def objects(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    def rows(path, doc):
        for i, o in enumerate(doc.objects.values()):
            yield (path, int(o.id), int(o.generation), i, to_json(o.value), o.stream, None if o.compressed_in is None else int(o.compressed_in))

    return _stage(files, OBJECTS, _per_document(rows, options, password))


def streams(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    """Every stream after its filters, within the document's budget; an error where one can't be decoded."""

    def rows(path, doc):
        for o in doc.objects.values():
            if o.stream is None:
                continue
            names = [shown(f) for f in codecs.filter_list(doc.get(o.value, "Filter"))]
            try:
                yield (path, int(o.id), names, doc.decoded(o), None)
            except PdfError as e:
                yield (path, int(o.id), names, None, str(e))

    return _stage(files, STREAMS, _per_document(rows, options, password))


def pages(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    def rows(path, doc, page):
        g = Geometry(page, doc.limits)
        box = [float(v) for v in page.media_box]
        crop = [float(v) for v in page.crop_box] if page.crop_box else None
        yield (path, page.number, box, crop, int(page.rotate), float(g.width), float(g.height), to_json(page.resources or None), to_json(page.contents or None))

    return _stage(files, PAGES, _per_page(rows, options, password))


def content_tokens(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    def rows(path, doc, page):
        for i, (is_operator, v) in enumerate(doc.page_tokens(page)):
            yield (path, page.number, i, "operator" if is_operator else "value", v if is_operator else to_json(v))

    return _stage(files, TOKENS, _per_page(rows, options, password))


def content_ops(tokens: DataFrame) -> DataFrame:
    """path, page_no, ord, op, operands: each operator with the values since the one before. Native."""
    from pyspark.sql.window import Window

    before = Window.partitionBy("path", "page_no").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)
    numbered = tokens.withColumn("op_ord", F.coalesce(F.sum((F.col("kind") == "operator").cast("int")).over(before), F.lit(0)))
    values = F.array_sort(F.collect_list(F.when(F.col("kind") == "value", F.struct("ord", "value"))))
    found = numbered.groupBy("path", "page_no", F.col("op_ord").alias("ord")).agg(F.max(F.when(F.col("kind") == "operator", F.col("value"))).alias("op"), values.alias("v"))
    return found.filter("op is not null").select("path", "page_no", "ord", "op", F.transform("v", lambda x: x["value"]).alias("operands"))


def text_spans(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    """Each string that a page shows, with its place and state."""

    def rows(path, doc, page):
        for s in Interpreter(doc, page).run().spans:
            yield (
                path, page.number, s["ord"], _clean(s["text"]), _clean(s["font"]), _clean(s["resource"]), s["size"], float(s["x"]), float(s["y"]),
                float(s["page_x"]), float(s["page_y"]), s["advance"], s["mode"], s["fill"], s["form_path"],
            )

    return _stage(files, SPANS, _per_page(rows, options, password))


def paint_ops(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    def rows(path, doc, page):
        for p in Interpreter(doc, page).run().paints:
            yield (
                path, page.number, p["ord"], p["kind"], p["rule"], p["path"], p["fill"], p["stroke"], p["line_width"], p["alpha"], p["blend"], p["form_path"], p["detail"],
            )

    return _stage(files, PAINTS, _per_page(rows, options, password))


def unsupported(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    def rows(path, doc, page):
        for k, n in sorted(Interpreter(doc, page).run().unsupported.items()):
            yield (path, page.number, _clean(k), n)

    return _stage(files, UNSUPPORTED, _per_page(rows, options, password))


def features(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    """path, page_no, feature, n: the census of every page that can be read."""

    def rows(path, doc, page):
        for k, n in sorted(doc.census(page)[0].items()):
            yield (path, page.number, _clean(k), n)

    return _stage(files, FEATURES, _per_page(rows, options, password))


def page_errors(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    """What is wrong on pages; fatal where a page has no census at all."""

    def each(path, doc):
        for page in doc.pages:
            try:
                for e in doc.census(page)[1]:
                    yield (path, page.number, _clean(e), False)
            except PdfError as e:
                yield (path, page.number, _clean(str(e)), True)

    return _stage(files, PAGE_ERRORS, _per_document(each, options, password))


def fonts(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    def rows(path, doc):
        for i, f in enumerate(doc.fonts.values()):
            style = style_of(f["base_font"])
            widths = [(int(k), float(v)) for k, v in f["widths"].items() if abs(k) < 2**31 and k == int(k)]
            names = [(int(k), _clean(v)) for k, v in f["names"].items() if abs(k) < 2**31 and k == int(k)]
            yield (
                path, i, _clean(f["name"]), f["object_id"], _clean(f["subtype"]), _clean(f["base_font"]), f["embedded"], f["format"], f["error"], f["program"] is not None,
                f["outline_usable"], [(k, _clean(v)) for k, v in f["to_unicode"].items()], widths, float(f["default_width"]), f["is_cid"], f["code_widths"], names, *style,
            )

    return _stage(files, FONTS, _per_document(rows, options, password))


def glyph_outlines(files: DataFrame, options: dict | None = None, password: str = "") -> DataFrame:
    """The outlines of embedded font programs, glyph by glyph; glyphs without one have no row."""

    def rows(path, doc):
        for f in doc.fonts.values():
            p = f["program"]
            for glyph in range((p.glyphs if p.kind == "truetype" else len(p.char_strings)) if p else 0):
                drawn = p.outline(glyph)
                if drawn:
                    yield (path, _clean(f["name"]), glyph, [{"cmd": c, "args": [float(v) for v in args]} for c, args in drawn])

    return _stage(files, GLYPHS, _per_document(rows, options, password))


def images(files: DataFrame, options: dict | None = None, password: str = "", pixels: bool = True) -> DataFrame:
    """Every image object's facts and, where its filters allow, its RGBA samples."""

    def rows(path, doc):
        for i in doc.images():
            obj, rgba, error = doc.objects[i["object"]], None, None
            try:
                found = graphics.rgba(doc, obj) if pixels and obj.stream is not None else None
                rgba = None if found is None else found.tobytes()
                error = None if rgba is not None or not pixels else "pixels are not supported"
            except PdfError as e:
                error = str(e)
            yield (path, i["object"], i["width"], i["height"], i["bits"], i["filters"], i["color_space"], i["has_mask"], i["has_soft_mask"], i["image_mask"], rgba, error)

    return _stage(files, IMAGES, _per_document(rows, options, password))


def audit(files: DataFrame, options: dict | None = None, password: str = "", profile: str = "full") -> DataFrame:
    """path, audit: a report of each usable file as JSON. The profiles viewer and text give three fields only."""

    def rows(path, doc):
        said: dict = {"url": path, "version": doc.version()}
        if profile == "full":
            said |= {
                "objects": len(doc.objects), "directObjects": doc.direct, "objectStreams": doc.object_streams, "decodedObjectStreams": doc.decoded_object_streams,
                "pages": len(doc.pages), "filters": dict(sorted(doc.filters.items())), "fonts": [
                    {
                        "name": f["name"], "subtype": f["subtype"], "baseFont": f["base_font"], "hasEmbeddedFont": f["embedded"], "embeddedFontFormat": f["format"],
                        "embeddedFontError": f["error"], "embeddedOutlineLoaded": f["program"] is not None, "embeddedOutlineUsable": f["outline_usable"],
                        "hasToUnicode": bool(f["to_unicode"]), "cmapEntries": len(f["to_unicode"]), "hasWidths": bool(f["widths"]), "defaultWidth": f["default_width"],
                    } for f in doc.fonts.values()
                ], "images": doc.images(), "activeContent": dict(sorted(doc.active.items())), "limits": merged(options), "warnings": [m for _, m in doc.warnings],
            }
        else:
            said["pages"] = len(doc.pages)
        yield (path, _clean(json.dumps(said, ensure_ascii=False)))

    return _stage(files, "path string, audit string", _per_document(rows, options, password))


def box_text(box: list | None) -> str | None:
    return None if box is None else " ".join(map(number_text, box))
