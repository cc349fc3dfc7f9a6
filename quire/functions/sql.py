"""The engine's functions for Spark SQL.

Scalar functions run over Arrow batches, table functions give rows:

- pdf_value(source): a PDF value as tagged JSON
- pdf_decode(data, filters): a stream's bytes after its filters, null if it can't be decoded
- pdf_win_ansi(data), pdf_string_bytes(json): text and bytes of strings
- pdf_to_unicode(cmap): a ToUnicode map
- pdf_tokens(content): ord, kind, value of a content stream's tokens
- pdf_objects(content): obj_id, generation, scan_ord, value, compressed_in
- pdf_spans(content): page_no, ord, text, x, y
"""

from __future__ import annotations

import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quire.functions import codecs, limits
from quire.functions.document import load
from quire.functions.fonts import to_unicode, win_ansi
from quire.functions.interpreter import Interpreter
from quire.functions.limits import PdfError
from quire.functions.values import hex_bytes, parse, to_json, tokens


def _value(source):
    return None if source is None else to_json(parse(source))


def _decode(data, filters):
    try:
        return None if data is None else codecs.decode(bytes(data), list(filters or []), limits.DEFAULTS["maxDecodedStreamBytes"])
    except PdfError:
        return None


def _win_ansi(data):
    return None if data is None else win_ansi(bytes(data))


def _string_bytes(said):
    value = json.loads(said) if said else None
    if not isinstance(value, dict):
        return None
    return hex_bytes(value["h"]) if "h" in value else value["s"].encode("latin-1", "replace") if "s" in value else None


def _cmap(source):
    return None if source is None else to_unicode(source, limits.DEFAULTS["maxCMapEntries"])


class _Tokens:
    def eval(self, content: bytes):
        try:
            found = tokens(bytes(content or b"").decode("latin-1"), limits.DEFAULTS["maxContentTokens"])
        except PdfError:
            return
        for i, (is_operator, v) in enumerate(found):
            yield i, "operator" if is_operator else "value", v if is_operator else to_json(v)


class _Objects:
    def eval(self, content: bytes):
        try:
            doc = load(bytes(content or b""))
        except PdfError:
            return
        for i, o in enumerate(doc.objects.values()):
            yield int(o.id), int(o.generation), i, to_json(o.value), None if o.compressed_in is None else int(o.compressed_in)


class _Spans:
    def eval(self, content: bytes):
        try:
            doc = load(bytes(content or b""))
        except PdfError:
            return
        for page in doc.pages:
            try:
                spans = Interpreter(doc, page).run().spans
            except PdfError:
                continue
            for s in spans:
                yield page.number, s["ord"], s["text"], float(s["x"]), float(s["y"])


SCALARS = {
    "pdf_value": (_value, "string"), "pdf_decode": (_decode, "binary"), "pdf_win_ansi": (_win_ansi, "string"), "pdf_string_bytes": (_string_bytes, "binary"),
    "pdf_to_unicode": (_cmap, "map<string,string>"),
}
TABLES = {
    "pdf_tokens": (_Tokens, "ord int, kind string, value string"),
    "pdf_objects": (_Objects, "obj_id bigint, generation int, scan_ord int, value string, compressed_in bigint"),
    "pdf_spans": (_Spans, "page_no int, ord int, text string, x double, y double"),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to a session."""
    from quire.session import prepare

    prepare(spark)
    for name, (f, kind) in SCALARS.items():
        spark.udf.register(name, F.udf(f, kind, useArrow=True))
    for name, (cls, kind) in TABLES.items():
        spark.udtf.register(name, F.udtf(cls, returnType=kind))
