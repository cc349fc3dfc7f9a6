"""Font programs: TrueType tables and glyphs, CFF and Type 2 charstrings, and sfnt files made from them.

Reads past the end of a program give 0, as damaged fonts are common. A glyph's
outline is a list of commands (kind, args): M, L, C as in CFF, Q for TrueType.
"""

from __future__ import annotations

import string
import struct
from dataclasses import dataclass, field

from quire.functions.limits import PdfError


class Reader:
    """Big-endian numbers at any place."""

    def __init__(self, data: bytes):
        self.data = data

    def _take(self, at: int, n: int) -> bytes:
        return self.data[at : at + n].ljust(n, b"\0") if at >= 0 else bytes(n)

    def u8(self, at: int) -> int:
        return self._take(at, 1)[0]

    def u16(self, at: int) -> int:
        return struct.unpack(">H", self._take(at, 2))[0]

    def i16(self, at: int) -> int:
        return struct.unpack(">h", self._take(at, 2))[0]

    def u32(self, at: int) -> int:
        return struct.unpack(">I", self._take(at, 4))[0]

    def u16s(self, at: int, n: int) -> tuple[int, ...]:
        return struct.unpack(f">{n}H", self._take(at, 2 * n))


NO_OS2 = "TrueType subset is missing browser-required OS/2 table"


@dataclass
class TrueType:
    r: Reader
    tables: dict[str, tuple[int, int]]
    units: int
    long_loca: bool
    glyphs: int
    cmap: dict[int, int]
    kind: str = "truetype"

    @property
    def problem(self) -> str | None:
        return None if "OS/2" in self.tables else NO_OS2

    def glyph_range(self, glyph: int) -> tuple[int, int] | None:
        if not 0 <= glyph < self.glyphs:
            return None
        loca = self.tables["loca"][0]
        if self.long_loca:
            return self.r.u32(loca + 4 * glyph), self.r.u32(loca + 4 * glyph + 4)
        return 2 * self.r.u16(loca + 2 * glyph), 2 * self.r.u16(loca + 2 * glyph + 2)

    def contours(self, glyph: int) -> list[list[tuple[int, int, bool]]] | None:
        """Points (x, y, on the curve) of a simple glyph; none for empty and composite ones."""
        span = self.glyph_range(glyph)
        if not span or span[0] == span[1]:
            return None
        r, at = self.r, self.tables["glyf"][0] + span[0]
        n = r.i16(at)
        if n <= 0:
            return None
        ends = r.u16s(at + 10, n)
        points = ends[-1] + 1
        at += 10 + 2 * n
        at += 2 + r.u16(at)
        flags: list[int] = []
        while len(flags) < points:
            if at >= len(r.data):
                return None
            flag = r.u8(at)
            again = r.u8(at + 1) if flag & 8 else 0
            at += 2 if flag & 8 else 1
            flags += [flag] * (1 + again)
        axes = []
        for short, same in ((2, 16), (4, 32)):
            place, values = 0, []
            for flag in flags:
                if flag & short:
                    place += r.u8(at) if flag & same else -r.u8(at)
                    at += 1
                elif not flag & same:
                    place += r.i16(at)
                    at += 2
                values.append(place)
            axes.append(values)
        every = [(x, y, bool(f & 1)) for x, y, f in zip(*axes, flags, strict=True)]
        return [every[a:b] for a, b in zip([0, *(e + 1 for e in ends[:-1])], [e + 1 for e in ends], strict=True)]

    def outline(self, glyph: int) -> list[tuple[str, list[float]]] | None:
        found = self.contours(glyph)
        return None if found is None else [c for contour in found for c in contour_commands(contour)]


def contour_commands(points: list[tuple[float, float, bool]]) -> list[tuple[str, list[float]]]:
    """A TrueType contour as commands; between two points off the curve lies their midpoint."""
    if not points:
        return []

    def middle(p, q):
        return ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2, True)

    # put every implied point in, then start on the curve
    full = []
    for p, q in zip(points, points[1:] + points[:1], strict=True):
        full.append(p)
        if not p[2] and not q[2]:
            full.append(middle(p, q))
    turn = next((i for i, p in enumerate(full) if p[2]), None)
    if turn is None:
        return []
    if not points[0][2] and points[-1][2]:
        turn = len(full) - 1
    full = full[turn:] + full[:turn]
    out, i = [("M", [full[0][0], full[0][1]])], 1
    while i < len(full):
        p = full[i]
        if p[2]:
            out.append(("L", [p[0], p[1]]))
            i += 1
        else:
            q = full[(i + 1) % len(full)]
            out.append(("Q", [p[0], p[1], q[0], q[1]]))
            i += 2
    return [*out, ("Z", [])]


def read_truetype(data: bytes) -> TrueType | None:
    r = Reader(data)
    tables = {}
    for i in range(min(r.u16(4), len(data) // 16)):
        at = 12 + 16 * i
        tables[data[at : at + 4].decode("latin-1")] = (r.u32(at + 8), r.u32(at + 12))
    if not {"head", "maxp", "loca", "glyf", "cmap"} <= tables.keys():
        return None
    head = tables["head"][0]
    return TrueType(r, tables, r.u16(head + 18) or 1000, r.i16(head + 50) != 0, r.u16(tables["maxp"][0] + 4), read_cmap(r, tables["cmap"][0]))


def read_cmap(r: Reader, table: int) -> dict[int, int]:
    """Formats 0 and 4; a subtable for platform 1 comes before any other."""
    first = None
    for i in range(r.u16(table + 2)):
        at = table + 4 + 8 * i
        sub = table + r.u32(at + 4)
        how = {0: _cmap_bytes, 4: _cmap_segments}.get(r.u16(sub)) if sub < len(r.data) else None
        if how:
            if r.u16(at) == 1:
                return how(r, sub)
            first = first if first is not None else how(r, sub)
    return first or {}


def _cmap_bytes(r: Reader, at: int) -> dict[int, int]:
    return {code: r.u8(at + 6 + code) for code in range(256)}


def _cmap_segments(r: Reader, at: int) -> dict[int, int]:
    n = r.u16(at + 6) // 2
    ends = r.u16s(at + 14, n)
    starts = r.u16s(at + 16 + 2 * n, n)
    deltas = r.u16s(at + 16 + 4 * n, n)
    offsets_at = at + 16 + 6 * n
    found = {}
    for i, (low, high, delta, offset) in enumerate(zip(starts, ends, deltas, r.u16s(offsets_at, n), strict=True)):
        for code in range(low, min(high, 0xFFFE) + 1):
            glyph = code if not offset else r.u16(offsets_at + 2 * i + offset + 2 * (code - low))
            found[code] = (glyph + delta) & 0xFFFF if glyph or not offset else 0
    return found


@dataclass
class Cff:
    char_strings: list[bytes]
    charset: list
    cid_keyed: bool
    matrix: list[float]
    local: list[bytes] = field(default_factory=list)
    shared: list[bytes] = field(default_factory=list)
    kind: str = "cff"
    units: int = 1000

    @property
    def glyph_of(self) -> dict:
        return {name: i for i, name in enumerate(self.charset)}

    def outline(self, glyph: int) -> list[tuple[str, list[float]]] | None:
        if not 0 <= glyph < len(self.char_strings):
            return None
        pen = _Type2(self)
        pen.run(self.char_strings[glyph], 0)
        return pen.out or None


def _index(r: Reader, at: int) -> tuple[list[bytes], int]:
    n = r.u16(at)
    if not n:
        return [], at + 2
    size = r.u8(at + 2)
    if not 1 <= size <= 4 or at + 3 + (n + 1) * size > len(r.data):
        raise PdfError("Invalid CFF index")
    places = [int.from_bytes(r.data[at + 3 + i * size : at + 3 + (i + 1) * size], "big") for i in range(n + 1)]
    base = at + 2 + (n + 1) * size
    return [r.data[base + a : base + b] if b >= a else b"" for a, b in zip(places, places[1:], strict=False)], base + places[-1]


def _number(data: bytes, at: int) -> tuple[float, int]:
    """A number of a DICT or a charstring, but for those that only one of them has."""
    b, r = data[at], Reader(data)
    if 32 <= b <= 246:
        return b - 139, at + 1
    if 247 <= b <= 250:
        return (b - 247) * 256 + r.u8(at + 1) + 108, at + 2
    if 251 <= b <= 254:
        return -(b - 251) * 256 - r.u8(at + 1) - 108, at + 2
    if b == 28:
        return r.i16(at + 1), at + 3
    return 0, at + 1


def _real(data: bytes, at: int) -> tuple[float, int]:
    text = ""
    while at < len(data):
        for nibble in divmod(data[at], 16):
            if nibble == 15:
                break
            text += ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", ".", "E", "E-", "", "-")[nibble]
        else:
            at += 1
            continue
        at += 1
        break
    try:
        return float(text), at
    except ValueError:
        return 0, at


def read_dict(data: bytes) -> dict[int, list[float]]:
    """Operands by operator; two-byte operators count from 1200."""
    found, operands, at = {}, [], 0
    while at < len(data):
        b = data[at]
        if b <= 21:
            key = b if b != 12 else 1200 + Reader(data).u8(at + 1)
            found[key], operands = operands, []
            at += 2 if b == 12 else 1
            continue
        if b == 29:
            n, at = Reader(data).u32(at + 1), at + 5
        elif b == 30:
            n, at = _real(data, at + 1)
        else:
            n, at = _number(data, at)
        operands.append(n)
    return found


_ACCENTED = (
    "Aacute Acircumflex Adieresis Agrave Aring Atilde Ccedilla Eacute Ecircumflex Edieresis Egrave Iacute Icircumflex Idieresis Igrave "
    "Ntilde Oacute Ocircumflex Odieresis Ograve Otilde Scaron Uacute Ucircumflex Udieresis Ugrave Yacute Ydieresis Zcaron"
)
# The names of string ids 0 to 228; letters stand for themselves, and small accented ones follow the capitals' order.
STANDARD_STRINGS = [
    *".notdef space exclam quotedbl numbersign dollar percent ampersand quoteright parenleft parenright asterisk plus comma hyphen period slash".split(),
    *"zero one two three four five six seven eight nine colon semicolon less equal greater question at".split(),
    *string.ascii_uppercase,
    *"bracketleft backslash bracketright asciicircum underscore quoteleft".split(),
    *string.ascii_lowercase,
    *"braceleft bar braceright asciitilde exclamdown cent sterling fraction yen florin section currency quotesingle quotedblleft guillemotleft".split(),
    *"guilsinglleft guilsinglright fi fl endash dagger daggerdbl periodcentered paragraph bullet quotesinglbase quotedblbase quotedblright".split(),
    *"guillemotright ellipsis perthousand questiondown grave acute circumflex tilde macron breve dotaccent dieresis ring cedilla".split(),
    *"hungarumlaut ogonek caron emdash AE ordfeminine Lslash Oslash OE ordmasculine ae dotlessi lslash oslash oe germandbls".split(),
    *"onesuperior logicalnot mu trademark Eth onehalf plusminus Thorn onequarter divide brokenbar degree thorn threequarters".split(),
    *"twosuperior registered minus eth multiply threesuperior copyright".split(),
    *_ACCENTED.split(),
    *(n[0].lower() + n[1:] for n in _ACCENTED.split()),
]


def read_cff(data: bytes, standard_strings: list[str] | None = None) -> Cff | None:
    """standard_strings: the names of the lowest string ids, where they are wanted; else they are sidN."""
    r = Reader(data)
    _, at = _index(r, r.u8(2) or 4)
    tops, at = _index(r, at)
    strings, at = _index(r, at)
    shared, _ = _index(r, at)
    top = read_dict(tops[0] if tops else b"")
    if not top.get(17) or not top[17][0]:
        return None
    char_strings, _ = _index(r, int(top[17][0]))
    cid = 1230 in top
    where = int(top[15][0]) if top.get(15) else 0
    names = standard_strings or []

    def name(sid: int) -> str:
        if sid < len(names):
            return names[sid]
        return strings[sid - 391].decode("latin-1") if 391 <= sid < 391 + len(strings) else ".notdef" if sid == 0 else f"sid{sid}"

    sids = _charset(r, where, len(char_strings), cid)
    matrix = top.get(1207, [])
    made = Cff(char_strings, sids if cid else [name(s) for s in sids], cid, matrix[:6] if len(matrix) >= 6 else [0.001, 0, 0, 0.001, 0, 0], [], shared)
    if len(top.get(18, [])) >= 2:
        size, place = int(top[18][0]), int(top[18][1])
        subrs = read_dict(data[place : place + size]).get(19)
        if subrs and subrs[0]:
            made.local = _index(r, place + int(subrs[0]))[0]
    return made


def _charset(r: Reader, at: int, n: int, cid: bool) -> list[int]:
    """String or character ids of the glyphs, the first of which is 0."""
    if at <= 0 or at >= len(r.data):
        if cid:
            raise PdfError("CID CFF charset is missing")
        return list(range(min(n, 229)))
    form, at, ids = r.u8(at), at + 1, [0]
    if form > 2:
        if cid:
            raise PdfError(f"Unsupported CID CFF charset format {form}")
        return ids
    step = (2, 3, 4)[form]
    while len(ids) < n:
        if at + step > len(r.data):
            if cid:
                raise PdfError("Truncated CID CFF charset")
            break
        first, more = r.u16(at), (0, r.u8(at + 2), r.u16(at + 2))[form]
        if cid and (first + more > 0xFFFF or len(ids) + more + 1 > n):
            raise PdfError("Invalid CID CFF charset range")
        ids += range(first, first + more + 1)
        at += step
    return ids[:n]


class _Type2:
    """Draws a charstring."""

    def __init__(self, font: Cff):
        self.font, self.out, self.stack = font, [], []
        self.x = self.y = 0.0
        self.stems, self.steps = 0, 0

    def run(self, code: bytes, depth: int) -> bool:
        """False when the glyph has ended."""
        at = 0
        while at < len(code) and depth <= 10:
            self.steps += 1
            if self.steps > 200_000:
                return False
            b = code[at]
            if b >= 32 or b == 28:
                if b == 255:
                    r = Reader(code)
                    n, at = r.i16(at + 1) + r.u16(at + 3) / 65536, at + 5
                else:
                    n, at = _number(code, at)
                self.stack.append(n)
                continue
            at += 1
            if b in (10, 29):
                subrs = self.font.local if b == 10 else self.font.shared
                bias = 107 if len(subrs) < 1240 else 1131 if len(subrs) < 33900 else 32768
                i = int(self.stack.pop() if self.stack else 0) + bias
                if 0 <= i < len(subrs) and not self.run(subrs[i], depth + 1):
                    return False
                continue
            if b == 11:
                return True
            if b == 14:
                return False
            if b in (1, 3, 18, 23, 19, 20):
                self.stems += len(self.stack) // 2
                at += (self.stems + 7) // 8 if b in (19, 20) else 0
            elif b == 12:
                self._flex(code[at] if at < len(code) else 0)
                at += 1
            else:
                self._draw(b, self.stack)
            self.stack = []
        return True

    def _move(self, dx: float, dy: float, kind: str = "M") -> None:
        self.x, self.y = self.x + dx, self.y + dy
        self.out.append((kind, [self.x, self.y]))

    def _curve(self, *d: float) -> None:
        args = []
        for dx, dy in zip(d[::2], d[1::2], strict=True):
            self.x, self.y = self.x + dx, self.y + dy
            args += [self.x, self.y]
        self.out.append(("C", args))

    def _lines(self, v: list[float]) -> None:
        for dx, dy in zip(v[::2], v[1::2], strict=False):
            self._move(dx, dy, "L")

    def _curves(self, v: list[float]) -> None:
        for i in range(0, len(v) - 5, 6):
            self._curve(*v[i : i + 6])

    def _draw(self, op: int, v: list[float]) -> None:
        last = [0.0, 0.0, *v]
        if op == 4:
            self._move(0, last[-1])
        elif op == 21:
            self._move(last[-2], last[-1])
        elif op == 22:
            self._move(last[-1], 0)
        elif op == 5:
            self._lines(v)
        elif op in (6, 7):
            for i, n in enumerate(v):
                flat = (i % 2 == 0) == (op == 6)
                self._move(n if flat else 0, 0 if flat else n, "L")
        elif op == 8:
            self._curves(v)
        elif op == 24:
            self._curves(v[:-2])
            self._move(last[-2], last[-1], "L")
        elif op == 25:
            self._lines(v[:-6])
            self._curves(v[-6:])
        elif op in (26, 27):
            extra, v = (v[0], v[1:]) if len(v) % 2 else (0, v)
            for i in range(0, len(v) - 3, 4):
                a, b, c, d = v[i : i + 4]
                self._curve(*((extra, a, b, c, 0, d) if op == 26 else (a, extra, b, c, d, 0)))
                extra = 0
        elif op in (30, 31):
            flat = op == 31
            for i in range(0, len(v) - 3, 4):
                a, b, c, d = v[i : i + 4]
                end = v[i + 4] if len(v) - i == 5 else 0
                self._curve(*((a, 0, b, c, end, d) if flat else (0, a, b, c, d, end)))
                flat = not flat

    def _flex(self, op: int) -> None:
        v = self.stack
        if op == 34 and len(v) >= 7:
            self._curve(v[0], 0, v[1], v[2], v[3], 0)
            self._curve(v[4], 0, v[5], -v[2], v[6], 0)
        elif op == 35 and len(v) >= 13:
            self._curve(*v[:6])
            self._curve(*v[6:12])
        elif op == 36 and len(v) >= 9:
            self._curve(*v[:5], 0)
            self._curve(v[5], 0, *v[6:9], -(v[1] + v[3] + v[7]))
        elif op == 37 and len(v) >= 11:
            dx, dy = sum(v[0:10:2]), sum(v[1:10:2])
            self._curve(*v[:6])
            self._curve(*v[6:10], *((v[10], -dy) if abs(dx) > abs(dy) else (-dx, v[10])))


# -- sfnt files


def checksum(data: bytes) -> int:
    data += bytes(-len(data) % 4)
    return sum(struct.unpack(f">{len(data) // 4}I", data)) & 0xFFFFFFFF


def build_sfnt(version: bytes, tables: dict[str, bytes]) -> bytes:
    """Tables by tag in order; the head table's adjustment makes the whole file add up."""
    n = len(tables)
    power = max(0, n.bit_length() - 1)
    head = struct.pack(">4sHHHH", version, n, 16 << power, power, 16 * n - (16 << power))
    place, entries, bodies, head_at = 12 + 16 * n, b"", b"", None
    for tag in sorted(tables):
        data = tables[tag]
        entries += struct.pack(">4sIII", tag.encode("latin-1"), checksum(data), place, len(data))
        if tag == "head":
            head_at = place
        body = data + bytes(-len(data) % 4)
        bodies, place = bodies + body, place + len(body)
    whole = bytearray(head + entries + bodies)
    if head_at is not None and len(tables["head"]) >= 12:
        struct.pack_into(">I", whole, head_at + 8, (0xB1B0AFBA - checksum(bytes(whole))) & 0xFFFFFFFF)
    return bytes(whole)


def cmap_table(cmap: dict[int, int]) -> bytes:
    """One format 4 subtable, a segment for each code."""
    codes = sorted(c for c in cmap if 0 <= c < 0xFFFF)
    n = len(codes) + 1
    power = n.bit_length() - 1
    deltas = [(cmap[c] - c) & 0xFFFF for c in codes]
    body = struct.pack(">HHHH", 2 * n, 2 << power, power, 2 * n - (2 << power))
    body += struct.pack(f">{n}H", *codes, 0xFFFF) + b"\0\0" + struct.pack(f">{n}H", *codes, 0xFFFF)
    body += struct.pack(f">{n}H", *deltas, 1) + bytes(2 * n)
    return struct.pack(">HHHHI", 0, 1, 3, 1, 12) + struct.pack(">HHH", 4, len(body) + 6, 0) + body


def name_table(family: str) -> bytes:
    texts = {1: family, 2: "Regular", 4: family, 6: family.replace(" ", "")}
    records, store = b"", b""
    for number, text in texts.items():
        raw = text.encode("utf-16-be")
        records += struct.pack(">HHHHHH", 3, 1, 0x409, number, len(raw), len(store))
        store += raw
    return struct.pack(">HHH", 0, len(texts), 6 + len(records)) + records + store


# The metrics in the following tables are fixed values.
def os2_table(cmap: dict[int, int]) -> bytes:
    codes = [c for c in cmap if c < 0xFFFF] or [0]
    out = struct.pack(">HhHHH", 3, 500, 400, 5, 0) + struct.pack(">10h", 650, 700, 0, 140, 650, 700, 0, 480, 50, 300)
    out += struct.pack(">h", 0) + bytes(10) + bytes(16) + b"QUIR" + struct.pack(">HHH", 0x40, min(codes), min(max(codes), 0xFFFF))
    return out + struct.pack(">hhhHHIIhhHHH", 800, -200, 200, 1000, 200, 1, 0, 500, 700, 0, 32, 1)


def cff_tables(cff: bytes, cmap: dict[int, int], widths: list[int], family: str) -> dict[str, bytes]:
    n = len(widths)
    head = struct.pack(">IIIIHH", 0x10000, 0x10000, 0, 0x5F0F3CF5, 3, 1000) + bytes(16) + struct.pack(">hhhhHHhhh", 0, -200, 1000, 800, 0, 8, 2, 0, 0)
    hhea = struct.pack(">IhhhHhhhhhh", 0x10000, 800, -200, 0, min(65535, max(widths)), 0, 0, 1000, 1, 0, 0) + bytes(10) + struct.pack(">H", n)
    hmtx = b"".join(struct.pack(">Hh", w, 0) for w in widths)
    post = struct.pack(">IIhhIIIII", 0x30000, 0, -75, 50, 0, 0, 0, 0, 0)
    return {"CFF ": cff, "OS/2": os2_table(cmap), "cmap": cmap_table(cmap), "head": head, "hhea": hhea, "hmtx": hmtx, "maxp": struct.pack(">IH", 0x5000, n), "name": name_table(family), "post": post}


def rebuild_truetype(font: TrueType, cmap: dict[int, int], family: str) -> bytes:
    """The program with a Unicode cmap, names and OS/2 of its own."""
    if not 0 < len(cmap) <= 8190:
        raise PdfError("No usable Unicode-to-glyph mappings in embedded TrueType font")
    tables = {}
    for tag, (at, n) in font.tables.items():
        if at + n > len(font.r.data):
            raise PdfError(f"Invalid TrueType table {tag}")
        if tag not in ("cmap", "name", "OS/2"):
            data = font.r.data[at : at + n]
            tables[tag] = data[:8] + bytes(4) + data[12:] if tag == "head" else data
    for tag in ("head", "hhea", "hmtx", "maxp", "glyf", "loca"):
        if tag not in tables:
            raise PdfError(f"Missing TrueType table {tag}")
    tables |= {"cmap": cmap_table(cmap), "name": name_table(family), "OS/2": os2_table(cmap)}
    tables.setdefault("post", struct.pack(">IIhhIIIII", 0x30000, 0, -75, 50, 0, 0, 0, 0, 0))
    return build_sfnt(b"\0\1\0\0", tables)
