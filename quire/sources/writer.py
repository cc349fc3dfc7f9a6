"""A small PDF writer, for queries over tables that hold no PDFs and for tests. Its output depends on its input alone."""

from __future__ import annotations

import base64
import zlib

LINES, TOP, LEFT, LEADING, SIZE = 50, 720, 72, 14, 12


def escaped(text: str) -> bytes:
    """A literal string's bytes."""
    raw = text.encode("latin-1")
    for a, b in ((b"\\", b"\\\\"), (b"(", b"\\("), (b")", b"\\)"), (b"\r", b"\\r"), (b"\n", b"\\n")):
        raw = raw.replace(a, b)
    return b"(" + raw + b")"


def plain(text: str) -> bool:
    """Whether every character has a code of its own in WinAnsi as this engine decodes it."""
    return all(c < "\x80" or "\xa0" <= c <= "\xff" for c in text)


def shown(text: str, wide: bool) -> bytes:
    return b"<" + text.encode("utf-16-be", "surrogatepass").hex().encode() + b">" if wide else escaped(text)


def filtered(data: bytes, filters: list[str]) -> bytes:
    """data as a stream with these filters, the first of which is undone first."""
    for name in reversed(filters):
        if name == "FlateDecode":
            data = zlib.compress(data, 6)
        elif name == "ASCIIHexDecode":
            data = data.hex().encode() + b">"
        elif name == "ASCII85Decode":
            data = base64.a85encode(data) + b"~>"
        elif name == "RunLengthDecode":
            data = b"".join(bytes([len(data[i : i + 128]) - 1]) + data[i : i + 128] for i in range(0, len(data), 128)) + b"\x80"
        else:
            raise ValueError(name)
    return data


def stream(data: bytes, entries: bytes = b"", filters: list[str] | None = None) -> bytes:
    body = filtered(data, filters or [])
    names = b" ".join(b"/" + f.encode() for f in filters or [])
    said = b"/Filter [%b] " % names if len(filters or []) > 1 else b"/Filter %b " % names if filters else b""
    return b"<< %b%b/Length %d >>\nstream\n%b\nendstream" % (entries + b" " * bool(entries), said, len(body), body)


def build(objects: dict[int, bytes] | list[tuple[int, bytes]], trailer: bytes = b"/Root 1 0 R", version: bytes = b"1.4") -> bytes:
    """A file with these object bodies, in order, and a valid cross-reference table of the last of each id."""
    out, places = bytearray(b"%PDF-" + version + b"\n"), {}
    for n, body in objects.items() if isinstance(objects, dict) else objects:
        places[n] = len(out)
        out += b"%d 0 obj\n%b\nendobj\n" % (n, body)
    start, top = len(out), max(places, default=0)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (top + 1)
    for n in range(1, top + 1):
        out += b"%010d 00000 n \n" % places[n] if n in places else b"0000000000 65535 f \n"
    return bytes(out + b"trailer\n<< /Size %d %b >>\nstartxref\n%d\n%%%%EOF\n" % (top + 1, trailer, start))


def pages_file(contents: list[bytes], resources: bytes = b"", filters: list[str] | None = None, page: bytes = b"", more: dict[int, bytes] | None = None, box: bytes = b"[0 0 612 792]") -> bytes:
    """A file with a page for each content stream. Objects 1 to 3 are the catalog, the tree and a plain font."""
    first = 4 + len(more or {})
    kids = b" ".join(b"%d 0 R" % (first + 2 * i) for i in range(len(contents)))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [%b] /Count %d /MediaBox %b /Resources << /Font << /F1 3 0 R >> %b >> >>" % (kids, len(contents), box, resources),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
    } | (more or {})
    for i, c in enumerate(contents):
        objects[first + 2 * i] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R %b >>" % (first + 2 * i + 1, page)
        objects[first + 2 * i + 1] = stream(c, b"", filters)
    return build(objects)


def text_pages(text: str) -> tuple[list[bytes], bool]:
    """Content streams that show a text line by line, and whether they use two-byte codes."""
    wide, lines = not plain(text), text.split("\n")
    contents = []
    for low in range(0, len(lines), LINES):
        shows = b"\n".join(shown(line, wide) + b" Tj T*" for line in lines[low : low + LINES])
        contents.append(b"BT\n/F1 %d Tf\n%d TL\n%d %d Td\n%b\nET" % (SIZE, LEADING, LEFT, TOP, shows))
    return contents, wide


def text_file(text: str | None, filters: list[str] | None = None) -> bytes:
    contents, wide = text_pages(text or "")
    if not wide:
        return pages_file(contents, filters=filters)
    more = {4: b"<< /Type /Font /Subtype /Type0 /BaseFont /Wide /Encoding /Identity-H /DescendantFonts [5 0 R] >>", 5: b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Wide >>"}
    return pages_file(contents, filters=filters, more=more, page=b"/Resources << /Font << /F1 4 0 R >> >>")


def encrypted_text_file(text: str | None, user: str, owner: str) -> bytes:
    """text_file with the Standard handler, revision 2, opened by either password. The text must be plain."""
    import hashlib
    import struct

    from quire.functions.codecs import PASSWORD_PADDING, object_key, rc4

    def padded(password: str) -> bytes:
        return (password.encode("latin-1")[:32] + PASSWORD_PADDING)[:32]

    file_id = hashlib.md5((text or "").encode("utf-8", "replace")).digest()
    o = rc4(hashlib.md5(padded(owner)).digest()[:5], padded(user))
    key = hashlib.md5(padded(user) + o + struct.pack("<i", -4) + file_id).digest()[:5]
    u = rc4(key, PASSWORD_PADDING)
    contents, _ = text_pages(text or "")
    kids = b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(contents)))
    objects = {
        1: b"<< /Type /Catalog /Pages 2 0 R >>",
        2: b"<< /Type /Pages /Kids [%b] /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F1 3 0 R >> >> >>" % (kids, len(contents)),
        3: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>",
        4: b"<< /Filter /Standard /V 1 /R 2 /O <%b> /U <%b> /P -4 >>" % (o.hex().encode(), u.hex().encode()),
    }
    for i, c in enumerate(contents):
        n = 6 + 2 * i
        objects[n - 1] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % n
        objects[n] = stream(rc4(object_key(key, n, 0), c))
    return build(objects, b"/Root 1 0 R /Encrypt 4 0 R /ID [<%b> <%b>]" % ((file_id.hex().encode(),) * 2))
