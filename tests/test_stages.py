import json

import pytest
from pyspark.sql import functions as F

from quire import registry
from quire.functions import limits
from quire.operators import analytics, raster, stages
from quire.sources import files, writer
from quire.streaming import census

SF = "/root/testdata/sf0.001"


def as_files(spark, contents):
    return spark.createDataFrame([(f"f{i}", len(c or b""), c) for i, c in enumerate(contents)], files.SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def corpus(spark):
    more = {4: writer.stream(b"0 0 0 1 k (in) Tj", b"/Subtype /Form"), 5: writer.stream(bytes(range(4)), b"/Subtype /Image /Width 2 /Height 2 /BitsPerComponent 8 /ColorSpace /DeviceGray")}
    drawn = writer.pages_file([b"/F Do /I Do BT /F1 10 Tf (x) Tj ET 0 0 1 1 re f Zap", b"/No Do"], b"/XObject << /F 4 0 R /I 5 0 R >>", more=more)
    return as_files(spark, [drawn, drawn, b"junk", None, b"", writer.text_file("a\nb"), drawn[: len(drawn) // 2]])


def test_bad_files_are_rows_with_errors(corpus):
    got = {r.path: r for r in stages.documents(corpus).collect()}
    assert len(got) == 7 and got["f0"].pages == 2 and got["f0"].error is None and got["f5"].version == "1.4"
    assert all("missing %PDF-" in got[f"f{i}"].error for i in (2, 3, 4)) and got["f0"].sha256 == got["f1"].sha256


def test_tables_of_a_file(corpus):
    one = corpus.filter("path = 'f0'")
    assert [(r.page_no, r.text, r.form_path) for r in stages.text_spans(one).orderBy("page_no", "ord").collect()] == [(1, "in", "4"), (1, "x", "")]
    assert sorted(r.kind for r in stages.paint_ops(one).collect()) == ["fill", "image"]
    assert [(r.page_no, r.operator, r.n) for r in stages.unsupported(one).orderBy("page_no").collect()] == [(1, "Zap", 1), (2, "Do", 1)]
    assert {r.feature: r.n for r in stages.features(one).collect()} == {"form:xobject": 1, "image:xobject": 1, "image:bits:8": 1, "color:DeviceCMYK-fill": 1, "font:Type1": 1, "operator:Zap": 1}
    assert [(r.page_no, r.error, r.fatal) for r in stages.page_errors(one).collect()] == [(2, "Missing XObject No", False)]
    assert [(r.obj_id, r.filters, r.error) for r in stages.streams(one).orderBy("obj_id").collect()][:2] == [(4, [], None), (5, [], None)]
    image = stages.images(one).first()
    assert (image.object_id, image.width, bytes(image.rgba)[:8]) == (5, 2, bytes([0, 0, 0, 255, 1, 1, 1, 255]))
    font = stages.fonts(one).first()
    assert (font.base_font, font.css_family, font.names[65]) == ("Helvetica", "Arial, Helvetica, sans-serif", "A")
    assert stages.pages(one).count() == 2 and stages.objects(one).filter("obj_id = 4").first().stream == b"0 0 0 1 k (in) Tj"
    ops = stages.content_ops(stages.content_tokens(one)).filter("page_no = 1").orderBy("ord").collect()
    assert [r.op for r in ops] == ["Do", "Do", "BT", "Tf", "Tj", "ET", "re", "f", "Zap"] and ops[3].operands == ['{"n":"F1"}', "10"]
    said = json.loads(stages.audit(one).first().audit)
    assert said["pages"] == 2 and said["images"][0]["object"] == 5 and said["limits"]["maxPages"] == 10000
    assert set(json.loads(stages.audit(one, profile="text").first().audit)) == {"url", "version", "pages"}
    assert stages.glyph_outlines(one).count() == 0


def test_limits_are_errors(corpus):
    assert stages.documents(corpus, {"maxInputBytes": 10}).filter("error like '%Input PDF size%'").count() == 4
    assert stages.page_errors(corpus.filter("path = 'f0'"), {"maxOperands": 3}).filter("fatal").count() == 1


def test_empty_tables(corpus):
    none = corpus.limit(0)
    for f in (stages.documents, stages.objects, stages.pages, stages.text_spans, stages.features, stages.fonts, stages.images):
        assert f(none).count() == 0


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name, data in (("b.pdf", writer.text_file("x")), ("a.PDF", writer.text_file("x")), ("sub/c.pdf", writer.pages_file([b"/No Do Zap", b""])), ("d.pdf", b"junk"), ("e.txt", b"no")):
        (tmp_path / "in" / name).write_bytes(data)
    return tmp_path


def test_folder_census(spark, folder):
    got = census.census_folder(spark, str(folder / "in"))
    told = {r.path.rpartition("/")[2]: r.duplicate_of for r in got["files"].collect()}
    assert told["a.PDF"] is None and told["b.pdf"].endswith("a.PDF") and len(told) == 4
    total = got["totals"].first()
    assert (total.files, total.parsed, total.pages, total.scanned_pages, total.page_errors, total.duplicates) == (3, 2, 3, 3, 1, 1)
    assert {(r.feature, r.status, r.documents, r.pages, r.occurrences) for r in got["summary"].collect()} == {("font:Type1", "observed", 1, 1, 1), ("operator:Zap", "unsupported", 1, 1, 1)}
    census.write_report(got, str(folder / "report"))
    assert spark.read.json(str(folder / "report/summary")).count() == 2
    assert files.too_large(spark, str(folder / "in"), {"maxInputBytes": 100}).count() == 3 and files.read_folder(spark, str(folder / "in"), {"maxInputBytes": 100}).count() == 1


def test_streaming_census(spark, folder):
    def follow():
        census.stream_census(spark, str(folder / "in"), str(folder / "out"), str(folder / "state")).awaitTermination()
        return spark.read.parquet(str(folder / "out"))

    assert follow().count() == 2
    (folder / "in/new.pdf").write_bytes(writer.pages_file([b"Zip"]))
    (folder / "in/again.pdf").write_bytes(writer.text_file("x"))
    assert follow().count() == 3


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text(json.dumps([{"id": "1", "title": "One", "pdfUrl": "x"}, {"id": "2", "number": "7", "type": "T"}]))
    rows = files.read_manifest(spark, str(tmp_path / "m.json"))
    rows = files.with_upload(files.with_upload(rows, "Up", "/u", 3), "Up2", "/v", 4)
    label = analytics.document_label(F.col("number"), F.col("type"), F.col("title"), F.col("id"))
    assert [r[0] for r in rows.orderBy("ordinal").select(label).collect()] == ["Up2", "One", "7 · T"]


def test_feature_status(spark):
    names = {"operator:BX": "observed", "operator:x": "unsupported", "image:filter:JPXDecode": "unsupported", "image:filter:Fl": "observed", "shading:paint": "partial", "font:embedded-fallback": "fallback", "font:browser-install-unverified": "unverified"}
    got = spark.createDataFrame([(n,) for n in names], "f string").select("f", analytics.feature_status(F.col("f"))).collect()
    assert {r[0]: r[1] for r in got} == names


def test_page_ranges(spark):
    ranges = {"all": 4, "*": 4, "": 4, "2": 1, " 1 - 3 ": 3, "1,3,,2-4": 4}
    got = spark.createDataFrame([(r,) for r in ranges], "r string").select("r", analytics.parse_page_range(F.col("r"), F.lit(4)).alias("p")).collect()
    assert {r.r: len(r.p) for r in got} == ranges and next(r.p for r in got if r.r == "1,3,,2-4") == [0, 1, 2, 3]
    for bad in ("x", "0", "3-2", "9", ",", "1-2-3"):
        with pytest.raises(Exception, match="Page range|Invalid page range"):
            spark.createDataFrame([(bad,)], "r string").select(analytics.parse_page_range(F.col("r"), F.lit(4)).alias("p")).collect()


def test_small_operators(spark):
    pages = spark.createDataFrame([("a", p) for p in (1, 2, 3, 7, 7)], "k string, p int")
    assert analytics.compact_pages(pages, ["k"], "p").first().page_list == "1-3,7"
    chosen = spark.range(1).select(analytics.page_selection(F.array(F.lit(0), F.lit(1)), F.lit(9), F.lit("1-2")), analytics.page_selection(F.array(F.lit(0)), F.lit(1), F.lit("1"))).first()
    assert tuple(chosen) == ("2 of 9 pages (1-2)", "1 pages")
    corpus = spark.range(600).withColumn("novelty", F.col("id"))
    assert analytics.keep_most_novel(corpus, "novelty").count() == 384 and analytics.keep_most_novel(corpus.limit(500), "novelty").count() == 500
    assert spark.range(1).select(analytics.difference_text(*(F.lit(v) for v in (200, 3, 1, 2, 4.25, 9)))).first()[0] == "1.50% changed, red 1, green 2, mean 4.3, max 9"
    sides = spark.createDataFrame([(0.0,), (-1.0,), (7.0,), (2e6,)], "v double").select(analytics.clamp_side(F.col("v"), 595)).collect()
    assert [r[0] for r in sides] == [595, 595, 7, 595]


def test_weighted_pick_and_report(spark):
    corpus = spark.createDataFrame([("a", 0), ("b", 98), ("c", 0)], "name string, novelty long")
    got = analytics.weighted_pick(corpus, "novelty", 200, 7).collect()
    assert len(got) == 200 and sum(r.name == "b" for r in got) > 180
    rows = spark.createDataFrame([("f", "Do", 1), ("f", "sh", 3), ("f", "BI", 1), ("f", "sh", 1)], "path string, operator string, n long")
    assert analytics.unsupported_report(rows, ["path"]).first().report == "sh: 4\nBI: 1\nDo: 1"


def test_agreement(spark):
    a = spark.createDataFrame([("1", 1, None), ("2", 1, None), ("3", 2, None), ("4", None, "x")], "path string, pages int, error string")
    b = spark.createDataFrame([("1", 1, None), ("2", None, "x"), ("3", 1, None), ("5", 1, None)], "path string, pages int, error string")
    assert {r.path: r.outcome for r in analytics.agreement(a, b, "path").collect()} == {"1": "agree", "2": "accept-mismatch", "3": "page-mismatch", "4": "both-rejected", "5": "accept-mismatch"}


def test_difference():
    white, other = b"\xff\xff\xff\xff" * 2, b"\xee\xee\xee\xff\xdd\xdd\xdd\xff"
    assert raster.difference(white, other) == (2, 1, 2, 2, 0, 25.5, 34) and raster.difference(b"", b"") == (0, 0, 0, 0, 0, 0.0, 0)


def test_writer_limits_and_chains():
    assert limits.DEFAULTS["maxFormXObjectDepth"] == 12 and len(limits.DEFAULTS) == 27


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    said = lambda v: "-" if v is None or v != v else str(int(v)) if isinstance(v, float) and v.is_integer() else str(v)
    for name, f in registry.queries().items():
        got = f(spark, SF)
        columns = sorted(got.columns)
        mine = sorted(tuple(said(r[c]) for c in columns) for r in got.collect())
        want = sorted(tuple(said(v) for v in r) for r in con.sql(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall())
        assert mine == want, name


def test_oversized_files_have_a_row(spark, tmp_path):
    (tmp_path / "large.pdf").write_bytes(b"%PDF-1.4\n" + b"x" * 5000)
    (tmp_path / "small.pdf").write_bytes(writer.text_file("x"))
    found = census.census_folder(spark, str(tmp_path), {"maxInputBytes": 4000})
    rows = {r.path.rsplit("/", 1)[1]: r for r in found["documents"].collect()}
    assert rows.keys() == {"large.pdf", "small.pdf"} and "PDF limit exceeded" in rows["large.pdf"].error and rows["large.pdf"].bytes == 5009
    assert found["totals"].count() == 1
