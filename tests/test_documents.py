import random

import numpy as np
import pytest

from quire.functions import fonts, graphics, outlines
from quire.functions.document import load
from quire.functions.fonts import cid_widths, encoding_names, simple_widths, standard_glyph_name, style_of, to_unicode, win_ansi
from quire.functions.interpreter import Interpreter, unsupported_text
from quire.functions.limits import PdfError
from quire.sources import writer


def run(data, page=0, **options):
    doc = load(data, options)
    return Interpreter(doc, doc.pages[page]).run()


def one(content: bytes, resources: bytes = b"", more=None, page: bytes = b"") -> Interpreter:
    return run(writer.pages_file([content], resources, more=more, page=page))


def test_text_and_pages():
    doc = load(writer.text_file("a (b)\n\nc\\" + "\nd" * 60))
    assert len(doc.pages) == 2 and doc.version() == "1.4"
    spans = Interpreter(doc, doc.pages[0]).run().spans
    assert [(s["text"], s["x"], s["y"]) for s in spans[:2]] == [("a (b)", 72, 720), ("c\\", 72, 692)]
    assert load(writer.text_file("日本 🙂")) and run(writer.text_file("日本 🙂")).spans[0]["text"] == "日本 🙂"


@pytest.mark.parametrize(("rotate", "point", "size"), [(0, (24, 40), (240, 160)), (90, (120, 24), (160, 240)), (180, (216, 120), (240, 160)), (270, (40, 216), (160, 240)), (-90, (40, 216), (160, 240)), (450, (120, 24), (160, 240))])
def test_rotation(rotate, point, size):
    i = run(writer.pages_file([b"BT /F1 18 Tf 24 120 Td (x) Tj ET"], page=b"/Rotate %d" % rotate, box=b"[0 0 240 160]"))
    assert (i.spans[0]["page_x"], i.spans[0]["page_y"]) == point and i.geometry.pixels == size


def test_rejects_in_order():
    for data, message in (
        (b"", "missing %PDF- header"), (b"%PDF-1.4", "no objects"), (writer.build({1: b"<< /Type /Catalog >>"}), "no pages"), (b"1 0 obj 1 endobj", "missing %PDF-"),
    ):
        with pytest.raises(PdfError, match=message):
            load(data)
    with pytest.raises(PdfError, match="Input PDF size 9 > 8"):
        load(b"%PDF-1.4\n", {"maxInputBytes": 8})


def test_objects_last_wins_first_place():
    doc = load(writer.build([(9, b"1"), (1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [3 0 R 3 0 R] >>"), (3, b"<< /Type /Page >>"), (9, b"2")]))
    assert next(iter(doc.objects)) == 9 and doc.objects[9].value == 2 and doc.direct == 5
    assert len(doc.pages) == 1 and doc.warnings == [("pages", "Cycle detected in page tree; bailing out of branch.")]


def test_streams_by_length():
    def body(length):
        return load(b"%PDF-1.4\n" + writer.build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Page >>", 3: b"<< " + length + b" >>\nstream\nab cd\r\nendstream", 4: b"5"})).objects[3].stream

    assert body(b"/Length 5") == b"ab cd" and body(b"/Length 4 0 R") == b"ab cd" and body(b"") == b"ab cd" and body(b"/Length 3") is None and body(b"/Length 999") is None


def test_references_and_inheritance():
    doc = load(writer.build({1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Kids [3 0 R 4 0 R] /MediaBox 5 0 R /Rotate 90 >>", 3: b"<< /Type /Page /MediaBox [0 (x) 1 1] >>", 4: b"<< /Type /Page /CropBox [1 2 3 4] /Rotate 0 >>", 5: b"[0 0 10 20]"}))
    assert [(p.media_box, p.crop_box, p.rotate) for p in doc.pages] == [([0, 0, 10, 20], None, 90), ([0, 0, 10, 20], [1, 2, 3, 4], 0)]
    loop = load(writer.build({1: b"<< /Type /Catalog /Pages 3 0 R >>", 2: b"2 0 R", 3: b"<< /Type /Page /MediaBox 2 0 R >>"}))
    assert loop.pages[0].media_box == [0, 0, 595, 842]


def test_encryption():
    data = writer.encrypted_text_file("hush (now)", "reader", "owner")
    for password in ("reader", "owner"):
        doc = load(data, password=password)
        assert Interpreter(doc, doc.pages[0]).run().spans[0]["text"] == "hush (now)"
    with pytest.raises(PdfError, match="valid password"):
        load(data, password="wrong")
    with pytest.raises(PdfError, match="Unsupported PDF encryption: Standard revision 3"):
        load(data.replace(b"/R 2", b"/R 3"), password="reader")


def test_operators():
    i = one(b"q 2 0 0 2 10 20 cm 1 0 0 rg 0 0 5 5 re f Q 0.5 G 3 w 0 0 m 10 10 l S 0 0 m 1 1 2 2 3 3 c h B* n 0 0 0 1 K Zz (a) Tj")
    assert [(p["kind"], p["rule"], p["fill"], p["stroke"]) for p in i.paints] == [("fill", "nonzero", "rgb(255, 0, 0)", None), ("stroke", None, None, "rgb(128, 128, 128)"), ("fill", "evenodd", "#000", None), ("stroke", None, None, "rgb(128, 128, 128)")]
    assert i.paints[0]["path"] == "M 10 772 L 20 772 L 20 762 L 10 762 Z" and dict(i.unsupported) == {"Zz": 1}
    assert unsupported_text(i.unsupported) == "Zz: 1" and i.spans[0]["font"] is None


def test_zero_operands_mean_defaults():
    i = one(b"BT /F1 9 Tf /F1 0 Tf 0 Tz 0 w 0 M (a) Tj T* (b) Tj ET")
    assert i.state.width == 1 and i.state.miter == 10 and i.state.scale == 1 and i.spans[1]["y"] == pytest.approx(-10.8)


def test_forms_masks_and_limits():
    more = {
        4: writer.stream(b"/F Do 1 g 0 0 1 1 re f", b"/Subtype /Form /BBox [0 0 1 1] /Matrix [2 0 0 2 0 0]"), 5: writer.stream(b"0 0 1 1 re f", b"/Subtype /Form /Group << /S /Transparency /I true >>"),
        6: b"<< /SMask << /S /Alpha /G 5 0 R >> /BM [/Odd /Multiply] /ca 0.5 >>", 7: b"<< /SMask << /S /Other >> /BM /Odd >>",
    }
    res = b"/XObject << /F 4 0 R /T 5 0 R >> /ExtGState << /A 6 0 R /B 7 0 R >>"
    i = one(b"/F Do", res, more)
    assert dict(i.unsupported) == {"Do/FormDepth": 1} and i.paints[-1]["form_path"] == "4" and i.paints[0]["form_path"] == "/".join(["4"])
    i = one(b"/A gs 0 0 1 1 re f /T Do /Nope Do", res, more)
    assert dict(i.unsupported) == {"gs/SoftMaskNonXObject": 1, "Do": 1} and i.state.blend == "Multiply" and i.state.fill_alpha == 0.5
    assert dict(one(b"/B gs", res, more).unsupported) == {"gs/BlendMode": 1, "gs/SoftMask": 1}
    assert dict(one(b"q " * 300).unsupported) == {"q/StackDepth": 44}
    with pytest.raises(PdfError, match="content operators > 3"):
        run(writer.pages_file([b"q q q q"]), maxContentOperators=3)
    with pytest.raises(PdfError, match="content operands > 4"):
        run(writer.pages_file([b"1 2 3 4 5 q"]), maxOperands=4)


def test_census_counts_forms_by_use():
    more = {
        4: writer.stream(b"/I Do /I Do 0 0 0 1 k /S sh", b"/Subtype /Form /Group << /S /Transparency >>"), 5: writer.stream(b"\0", b"/Subtype /Image /BitsPerComponent 1 /Width 1 /Height 1 /SMask 5 0 R", ["FlateDecode"]),
        6: b"<< /ShadingType 3 >>",
    }
    doc = load(writer.pages_file([b"/F Do /F Do /No Do", b""], b"/XObject << /F 4 0 R /I 5 0 R >> /Shading << /S 6 0 R >>", more=more))
    found, errors = doc.census(doc.pages[0])
    assert dict(found) == {
        "form:xobject": 2, "transparency:group": 2, "transparency:nonisolated-group": 2, "image:xobject": 4, "image:bits:1": 4, "image:filter:FlateDecode": 4, "image:soft-mask": 4,
        "color:DeviceCMYK-fill": 2, "shading:paint": 2, "shading:unsupported-type:3": 2,
    }
    assert errors == ["Missing XObject No"] and doc.census(doc.pages[1]) == ({}, [])


def test_active_content_counts_each_value_once():
    doc = load(writer.build({1: b"<< /Type /Catalog /Pages 2 0 R /OpenAction 4 0 R /AA << /O 4 0 R >> >>", 2: b"<< /Type /Page >>", 4: b"<< /S /JavaScript /JS (x) >>"}))
    assert dict(doc.active) == {"OpenAction": 1, "AA": 1, "JavaScript": 1, "JS": 1}


def test_images():
    def pixels(samples, entries, filters=None, more=None):
        doc = load(writer.pages_file([b""], more={4: writer.stream(samples, b"/Subtype /Image " + entries, filters)} | (more or {})))
        return graphics.rgba(doc, doc.objects[4])

    assert pixels(b"\x80\x40", b"/Width 3 /Height 2 /BitsPerComponent 1 /ColorSpace /DeviceGray")[:, 0].tolist() == [255, 0, 0, 0, 255, 0]
    assert pixels(b"\x00\xff\x00\x80", b"/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceCMYK").tolist() == [[127, 0, 127, 255]]
    assert pixels(bytes([0, 255]), b"/Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Decode [1 0]")[:, 0].tolist() == [255, 0]
    assert pixels(b"\x10", b"/Width 2 /Height 1 /BitsPerComponent 4 /ColorSpace [/Indexed /DeviceGray 1 (\\377\\007)]")[:, 0].tolist() == [7, 255]
    mask = {5: writer.stream(b"\x09", b"/Subtype /Image /Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceGray /Decode [1 0]")}
    assert pixels(b"abc", b"/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /SMask 5 0 R", None, mask).tolist() == [[97, 98, 99, 246]]
    with pytest.raises(graphics.MaskProblem):
        pixels(b"abc", b"/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB /SMask 9 0 R")
    assert pixels(b"ab", b"/Width 1 /Height 1 /BitsPerComponent 8 /ColorSpace /DeviceRGB") is None
    assert one(b"/I Do", b"/XObject << /I 4 0 R >>", {4: writer.stream(b"", b"/Subtype /Image /Width 50000 /Height 50000")}).unsupported == {"Do/ImageLimit": 1}


def test_color_functions():
    doc = load(writer.pages_file([b""], more={4: writer.stream(bytes([0, 255, 0, 51]), b"/FunctionType 0 /Size [2] /BitsPerSample 16 /Domain [0 2] /Range [0 1]")}))
    f = graphics.color_function(doc, next(iter([__import__("quire.functions.values", fromlist=["Ref"]).Ref(4, 0)])))
    assert f(0) == [pytest.approx(255 / 65535)] and f(5) == [pytest.approx(51 / 65535)] and f(1)[0] == pytest.approx(153 / 65535)
    assert graphics.color_function(doc, {"FunctionType": 2, "N": 1, "C0": [0, 1], "C1": [1, 0]})(0.25) == [0.25, 0.75]
    assert graphics.color_function(doc, {"FunctionType": 4}) is None and graphics.color_function(doc, {"FunctionType": 2, "N": 0}) is None
    assert graphics.space_color("DeviceRGB", [0, 0, 0, 0.5]) == "rgb(128, 128, 128)" and graphics.space_color("Odd", [0.5]) == "rgb(128, 128, 128)"


def test_font_tables():
    cmap = to_unicode("beginbfchar <01> <0041> <0a> <D83DDE42> endbfchar beginbfrange <0002> <0004> <0061> <0010> <0012> [<0031> <0032>] endbfrange", 100)
    assert cmap == {"01": "A", "0A": "🙂", "0002": "a", "0003": "b", "0004": "c", "0010": "1", "0011": "2"}
    listed = to_unicode("beginbfrange <01> <03> [<0041> <0042> <0043>] endbfrange", 100)
    assert listed["01"] == "A" and listed["03"] == "C"
    assert len(to_unicode("beginbfrange <0000> <FFFF> <0000> endbfrange", 10_000)) == 512 and len(to_unicode("beginbfrange <00> <FF> <0000> endbfrange", 7)) == 7
    assert simple_widths(65, [500, None, 600]) == {65: 500, 67: 600}
    assert cid_widths([1, [10, 20], 5, 7, 30]) == {1: 10, 2: 20, 5: 30, 6: 30, 7: 30}
    assert encoding_names({"Differences": [65, "x", "y", 90, "z"]})[66] == "y" and standard_glyph_name(0x8E) == "eacute" and standard_glyph_name(220) == "guilsinglleft"
    assert win_ansi(b"\x80\x81A\xe9") == "€\x81Aé"
    assert style_of("ABCDEF+Roboto_Mono-BoldItalic") == ("italic", "700", "Roboto Mono, ui-monospace, monospace") and style_of(None)[1] == "400"


def test_advance_and_glyph_runs():
    more = {4: b"<< /Type /Font /Subtype /TrueType /FirstChar 97 /Widths [500 250] /MissingWidth 100 >>"}
    i = one(b"BT /F 10 Tf 2 Tc 3 Tw 50 Tz (ab c) Tj [(a) 1000 (b)] TJ ET", more=more, page=b"/Resources << /Font << /F 4 0 R >> >>")
    assert i.spans[0]["advance"] == pytest.approx(0.5 * (5 + 2.5 + 1 + 1 + 4 * 2 + 3)) and i.spans[2]["x"] == pytest.approx(i.spans[1]["x"] + i.spans[1]["advance"] - 5)
    assert one(b"BT (a) Tj (b) Tj ET").spans[1]["advance"] is None


def truetype(os2=False) -> bytes:
    glyph = np.array([1, 0, 0, 10, 10, 2, 0], ">i2").tobytes() + bytes([1, 1, 1]) + np.array([0, 10, 0], ">i2").tobytes() + np.array([0, 0, 10], ">i2").tobytes() + b"\0"
    tables = {
        "head": bytes(18) + b"\x03\xe8" + bytes(30) + b"\0\0" + bytes(2), "maxp": b"\0\1\0\0\0\2", "loca": np.array([0, 0, len(glyph) // 2], ">u2").tobytes(), "glyf": glyph,
        "cmap": outlines.cmap_table({65: 1}), "hhea": bytes(36), "hmtx": bytes(8),
    } | ({"OS/2": bytes(78)} if os2 else {})
    return outlines.build_sfnt(b"\0\1\0\0", tables)


def test_truetype_outlines_and_rebuild():
    f = outlines.read_truetype(truetype())
    assert f.cmap == {65: 1} and f.glyphs == 2 and f.problem == outlines.NO_OS2 and f.outline(0) is None
    assert f.outline(1) == [("M", [0, 0]), ("L", [10, 0]), ("L", [10, 10]), ("Z", [])]
    again = outlines.read_truetype(outlines.rebuild_truetype(f, {0x263A: 1}, "Face"))
    assert again.cmap == {0x263A: 1} and again.problem is None and again.outline(1) == f.outline(1)
    assert outlines.contour_commands([(0, 0, False), (10, 0, False), (10, 10, False)])[0] == ("M", [5, 0])
    for n in range(0, len(truetype()), 7):
        outlines.read_truetype(truetype()[:n])


def cff(charset: bytes = b"", cid: bool = False) -> bytes:
    def index(items):
        if not items:
            return b"\0\0"
        ends = np.cumsum([1, *map(len, items)])
        return len(items).to_bytes(2, "big") + b"\2" + b"".join(int(e).to_bytes(2, "big") for e in ends) + b"".join(items)

    glyphs = index([b"\x0e", bytes([139 + 5, 139 + 5, 21, 139 + 10, 6, 139 + 1, 139 + 2, 139 + 3, 139 + 4, 139 + 5, 139 + 6, 8, 14])])
    names, strings, subrs = index([b"F"]), index([b"odd"]), b"\0\0"

    def top(place, where):
        number = lambda n: b"\x1d" + n.to_bytes(4, "big")
        return index([(b"\x8b\x8b\x8b\x0c\x1e" if cid else b"") + number(where) + b"\x0f" + number(place) + b"\x11"])

    base = 4 + len(names) + len(top(0, 0)) + len(strings) + len(subrs)
    return b"\1\0\4\1" + names + top(base, base + len(glyphs) if charset else 0) + strings + subrs + glyphs + charset


def test_cff_outlines():
    f = outlines.read_cff(cff(b"\0\x01\x87"))
    assert f.charset == [".notdef", "odd"] and f.outline(0) is None and f.glyph_of["odd"] == 1
    assert f.outline(1) == [("M", [5, 5]), ("L", [15, 5]), ("C", [16, 7, 19, 11, 24, 17])]
    assert outlines.read_cff(cff(b"\1\0\x07\0", cid=True)).charset == [0, 7]
    with pytest.raises(PdfError, match="Truncated CID"):
        outlines.read_cff(cff(b"\2\0", cid=True))
    for n in range(0, len(cff())):
        try:
            outlines.read_cff(cff()[:n])
        except PdfError:
            pass


def test_embedded_fonts():
    def font(data, kind, key, entries=b""):
        more = {4: b"<< /Type /Font /Subtype /%b /BaseFont /B /FontDescriptor 5 0 R %b >>" % (kind, entries), 5: b"<< /%b 6 0 R >>" % key, 6: writer.stream(data, b"/Subtype /Type1C" if key == b"FontFile3" else b"")}
        doc = load(writer.pages_file([b"/F 1 Tf"], more=more, page=b"/Resources << /Font << /F 4 0 R >> >>"))
        return doc, next(iter(doc.fonts.values()))

    doc, f = font(truetype(), b"TrueType", b"FontFile2")
    assert f["outline_usable"] and f["error"] is None and fonts.rebuilt(f, "X")[:4] == b"\0\1\0\0"
    doc, f = font(cff(b"\0\x01\x87"), b"Type1", b"FontFile3", b"/Encoding << /Differences [65 /odd] >>")
    assert f["unverified"] and dict(doc.census(doc.pages[0])[0]) == {"font:Type1": 1, "font:browser-install-unverified": 1}
    doc, f = font(b"junk", b"Type1", b"FontFile")
    assert f["error"] == "Unsupported embedded font format type1" and "font:embedded-fallback" in doc.census(doc.pages[0])[0]


def test_mutated_files_end_in_results_or_errors():
    rng = random.Random(9)
    more = {4: writer.stream(b"/F Do (x) Tj", b"/Subtype /Form"), 5: writer.stream(b"\0" * 64, b"/Subtype /Image /Width 8 /Height 8 /BitsPerComponent 8 /ColorSpace /DeviceGray", ["FlateDecode"])}
    base = writer.pages_file([b"BT /F1 12 Tf (abc) Tj ET /F Do /I Do /S sh"], b"/XObject << /F 4 0 R /I 5 0 R >>", more=more)
    for _ in range(400):
        b = bytearray(base)
        for _ in range(rng.randint(1, 8)):
            at = rng.randrange(len(b))
            choice = rng.randrange(4)
            if choice == 0:
                b[at] = rng.randrange(256)
            elif choice == 1:
                del b[at : at + rng.randrange(20)]
            elif choice == 2:
                b[at:at] = rng.choice([b"<<", b"[", b"(", b" 1 0 R ", b"endobj", b"stream\n", b"/Kids [2 0 R]", b"9" * 30])
            else:
                b[at:at] = b[: rng.randrange(60)]
        try:
            doc = load(bytes(b), {"maxDecodedStreamBytes": 1 << 20})
            for page in doc.pages:
                Interpreter(doc, page).run()
                doc.census(page)
        except PdfError:
            pass
