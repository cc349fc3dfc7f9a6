import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quire.functions import codecs, limits
from quire.functions.limits import PdfError
from quire.functions.values import Hex, Name, Ref, Text, number, parse, to_json, tokens
from quire.sources import writer


@pytest.mark.parametrize(
    ("source", "value"),
    [
        ("/A#42c", Name("ABc")), ("(a(b)\\)\\101\\n\\\nx)", Text("a(b))A\nx")), ("<4 1 4>", Hex("414")), ("12 0 R", Ref(12, 0)), ("12 0 X", 12), ("-.5", -0.5),
        ("[1 2 R 3]", [Ref(1, 2), 3]), ("[1 2 0 R]", [1, Ref(2, 0)]), ("<< /A 1 /A 2 /B [true null] >>", {"A": 2, "B": [True, None]}), ("% note\n 7", 7), ("1e3", 1000), ("0x10", 16), ("word", Name("word")),
        ("(cut", Text("cut")), ("[1 [2", [1, [2]]), ("", 0), ("(\\5\\53\\053a)", Text("\x05++a")), ("(a\\\r\nb)", Text("ab")),
    ],
)
def test_values(source, value):
    assert parse(source) == value


def test_numbers_are_those_of_text():
    assert [number(x) for x in ("", "5.", ".5", "+1", "1e400", "1_0", "--1", "Infinity", "0b11")] == [0, 5, 0.5, 1, None, None, None, None, 3]


def test_tokens_and_caps():
    assert tokens("/F 1 Tf true (x) <41> [1] ]", 99) == [(False, "F"), (False, 1), (True, "Tf"), (True, "true"), (False, Text("x")), (False, Hex("41")), (False, [1]), (True, "]")]
    with pytest.raises(PdfError, match="content tokens > 2"):
        tokens("1 2 3", 2)


def test_tagged_json_keeps_kinds_apart():
    assert to_json({"A": Name("x"), "B": [Text("x"), Hex("78"), Ref(1, 0), None, 1.5]}) == '{"d":{"A":{"n":"x"},"B":[{"s":"x"},{"h":"78"},{"r":1,"g":0},null,1.5]}}'


@given(st.text(st.characters(max_codepoint=255)))
@settings(max_examples=200, deadline=None)
def test_strings_come_back(text):
    assert parse(writer.escaped(text).decode("latin-1")) == Text(text)


@given(st.binary(max_size=400))
@settings(max_examples=300, deadline=None)
def test_any_bytes_parse_to_an_end(data):
    parse(data.decode("latin-1"))
    tokens(data.decode("latin-1"), 10_000)


def test_deep_nesting_is_bounded():
    parse("[" * 100_000)
    parse("<</A" * 50_000)


@given(st.binary(max_size=2000), st.lists(st.sampled_from(sorted(codecs.FILTERS)), max_size=3))
@settings(max_examples=150, deadline=None)
def test_filters_come_back(data, names):
    assert codecs.decode(writer.filtered(data, names), names, 1 << 20) == data


@given(st.binary(max_size=300), st.sampled_from(sorted(codecs.FILTERS)))
@settings(max_examples=200, deadline=None)
def test_filters_on_any_bytes_end_within_caps(data, name):
    try:
        assert len(codecs.decode(data, [name], 500)) <= 500
    except PdfError:
        pass


def test_filter_quirks():
    most = 100
    assert codecs.ascii_hex(b"4 1\n4>zz", most) == b"A@" and codecs.ascii_hex(b"4G", most) == b"\x04"
    assert codecs.ascii85(b"<~z!~>", most) == b"\0\0\0\0\3" and codecs.ascii85(b"87cURD]i,\"Ebo80~>", most) == b"Hello World!"
    assert codecs.run_length(b"\x02abc\xfeX\x80zz", most) == b"abcXXX"
    assert codecs.decode(b"41>", ["AHx"], most) == b"A"
    with pytest.raises(PdfError, match="Unsupported stream filter LZWDecode"):
        codecs.decode(b"", ["LZWDecode"], most)
    with pytest.raises(PdfError, match="Flate stream size"):
        codecs.decode(writer.filtered(bytes(5000), ["FlateDecode"]), ["FlateDecode"], 4999)


def test_predictors():
    assert codecs.tiff_predictor(bytes([1, 1, 1, 250, 10, 1]), 1, 3, 2) == bytes([1, 2, 3, 250, 4, 5])
    rows = bytes([0, 1, 2, 3, 4, 1, 1, 1, 1, 1, 2, 1, 1, 1, 1, 3, 2, 2, 2, 2, 4, 1, 1, 1, 1])
    assert codecs.png_predictor(rows, 2, 2, 5)[:12] == bytes([1, 2, 3, 4, 1, 1, 2, 2, 2, 2, 3, 3])
    assert codecs.png_predictor(b"\x00\x05", 1, 4, 2) == bytes([5, 0, 0, 0, 0, 0, 0, 0])


def test_rc4_and_keys():
    assert codecs.rc4(b"Key", b"Plaintext").hex() == "bbf316e8d940af0ad3"
    assert codecs.rc4(b"Wiki", codecs.rc4(b"Wiki", b"pedia")) == b"pedia"


def test_limits_take_known_positive_numbers():
    got = limits.merged({"maxPages": "5", "maxObjects": -1, "maxKids": 3, "maxOperands": math.inf, "maxPageKids": None})
    assert got["maxPages"] == 5 and {k: v for k, v in got.items() if k != "maxPages"} == {k: v for k, v in limits.DEFAULTS.items() if k != "maxPages"}


def test_standard_strings_and_glyph_names():
    from quire.functions import fonts, outlines

    assert len(outlines.STANDARD_STRINGS) == 229 and len(set(outlines.STANDARD_STRINGS)) == 229
    assert [outlines.STANDARD_STRINGS[i] for i in (1, 18, 34, 66, 150, 171, 200, 228)] == ["space", "one", "A", "a", "onesuperior", "Aacute", "aacute", "zcaron"]
    assert [fonts.standard_glyph_name(c) for c in (31, 32, 48, 65, 128, 202, 240, 255)] == [None, "space", "zero", "A", "Adieresis", "space", "apple", "caron"]
