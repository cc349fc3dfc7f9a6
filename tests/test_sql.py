from quire.functions import sql
from quire.sources import files, writer


def test_functions_in_sql(spark):
    sql.register(spark)
    one = spark.sql("SELECT pdf_value('<< /A (x) >>') v, pdf_decode(X'343141', array('AHx')) d, pdf_decode(X'00', array('LZW')) n, pdf_win_ansi(X'80') w, pdf_string_bytes('{\"h\":\"41\"}') s, pdf_to_unicode('beginbfchar <01> <0041> endbfchar') c").first()
    assert (one.v, bytes(one.d), one.n, one.w, bytes(one.s), one.c) == ('{"d":{"A":{"s":"x"}}}', b"A\xa0", None, "€", b"A", {"01": "A"})
    rows = spark.sql("SELECT * FROM pdf_tokens(CAST('1 (a) Tj' AS BINARY))").collect()
    assert [(r.ord, r.kind, r.value) for r in rows] == [(0, "value", "1"), (1, "value", '{"s":"a"}'), (2, "operator", "Tj")]
    data = [("a", 0, writer.text_file("x\ny")), ("b", 0, b"junk")]
    spark.createDataFrame(data, files.SCHEMA).createOrReplaceTempView("pdf_files")
    got = spark.sql("SELECT path, s.text FROM pdf_files, LATERAL pdf_spans(content) s").collect()
    assert sorted((r.path, r.text) for r in got) == [("a", "x"), ("a", "y")]
    assert spark.sql("SELECT count(*) n FROM pdf_files, LATERAL pdf_objects(content) o").first().n == 5
