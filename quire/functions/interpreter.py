"""The fold over a page's operators: text spans, paint operations, and what is not supported.

Nothing is drawn. A span or paint row says what would be, where, and with
which state. Where a font has no widths an advance cannot be known: it is None,
and the text position stays where it is.
"""

from __future__ import annotations

import copy
import math
from collections import Counter
from dataclasses import dataclass, field

from quire.functions import codecs, graphics
from quire.functions.document import BLEND_MODES, Document, Page, font_key, numbers
from quire.functions.fonts import glyph_run, token_bytes
from quire.functions.graphics import IDENTITY, apply, multiply
from quire.functions.limits import PdfError
from quire.functions.values import MISSING, as_number, number_text, truthy_number

CAPS, JOINS = ("butt", "round", "square"), ("miter", "round", "bevel")
SHADING_STOPS = 128
#: All Forms that a page draws may have this many times the operators of one stream.
TOTAL_FACTOR = 8
# Operators that change nothing here.
IGNORED = frozenset("BX EX ri i ET BDC BMC EMC MP DP".split())


@dataclass
class State:
    ctm: tuple = IDENTITY
    fill: str = "#000"
    stroke: str = "#000"
    fill_space: object = "DeviceGray"
    stroke_space: object = "DeviceGray"
    fill_alpha: float = 1
    stroke_alpha: float = 1
    blend: str = "Normal"
    mask: tuple | None = None
    width: float = 1
    dash: list = field(default_factory=list)
    dash_phase: float = 0
    miter: float = 10
    cap: str = "butt"
    join: str = "miter"
    current: tuple | None = None
    start: tuple | None = None
    font: object = None
    size: float = 10
    char_spacing: float = 0
    word_spacing: float = 0
    scale: float = 1
    leading: float = 0
    mode: float = 0
    rise: float = 0
    text: tuple = IDENTITY
    line: tuple = IDENTITY


class Geometry:
    """From user space to the page as it is shown, at a scale."""

    def __init__(self, page: Page, limits: dict, scale: float = 1.0):
        box = page.crop_box or page.media_box
        box = [*box, 0, 0, 0, 0][:4]
        self.x, self.y, self.scale, self.rotate = box[0], box[1], scale, page.rotate
        self.width, self.height = side(abs(box[2] - box[0]), 595), side(abs(box[3] - box[1]), 842)
        turned = self.rotate in (90, 270)
        shown = (self.height, self.width) if turned else (self.width, self.height)
        most = limits["maxPageDimensionPx"]
        self.pixels = tuple(int(min(most, max(1, math.floor(s * scale)))) for s in shown)

    def point(self, x: float, y: float) -> tuple[float, float]:
        x, y, w, h, s = x - self.x, y - self.y, self.width, self.height, self.scale
        a, b = {90: (y, x), 180: (w - x, y), 270: (h - y, w - x)}.get(self.rotate, (x, h - y))
        return a * s, b * s


def side(value: float, fallback: float) -> float:
    return value if 0 < value <= 1_000_000 else fallback


def _at(operands: list, i: int):
    return operands[i] if -len(operands) <= i < len(operands) else MISSING


def _n(operands: list, i: int, default: float = 0) -> float:
    return truthy_number(_at(operands, i), default)


def _real(value) -> bool:
    return isinstance(value, int | float) and not isinstance(value, bool)


class Interpreter:
    def __init__(self, doc: Document, page: Page, scale: float = 1.0):
        self.doc, self.page, self.geometry = doc, page, Geometry(page, doc.limits, scale)
        self.state, self.stack = State(), []
        self.resources = page.resources
        self.spans: list[dict] = []
        self.paints: list[dict] = []
        self.unsupported: Counter = Counter()
        self.path: list[str] = []
        self.forms: list[int] = []
        self.active_mask, self.open_groups = None, 0
        self.operators = 0

    def run(self) -> Interpreter:
        width, height = self.geometry.pixels
        most = self.doc.limits["maxPagePixels"]
        if width * height > most:
            raise PdfError(f"PDF limit exceeded: Page canvas pixels {width * height} > {most}")
        self.fold(self.doc.page_tokens(self.page))
        return self

    def fold(self, toks) -> None:
        operands: list = []
        count = 0
        for is_operator, v in toks:
            if not is_operator:
                operands.append(v)
                if len(operands) > self.doc.limits["maxOperands"]:
                    raise PdfError(f"PDF limit exceeded: content operands > {self.doc.limits['maxOperands']}")
                continue
            count += 1
            if count > self.doc.limits["maxContentOperators"]:
                raise PdfError(f"PDF limit exceeded: content operators > {self.doc.limits['maxContentOperators']}")
            self.operators += 1
            if self.operators > TOTAL_FACTOR * self.doc.limits["maxContentOperators"]:
                raise PdfError("PDF limit exceeded: operators of all Forms")
            if v not in IGNORED:
                handler = OPERATORS.get(v)
                if handler:
                    handler(self, operands)
                else:
                    self.unsupported[v] += 1
            operands = []

    # -- resources

    def resource(self, kind: str, name):
        holder = self.doc.get(self.doc.resolve(self.resources), kind)
        return holder.get(str(name), MISSING) if isinstance(holder, dict) and isinstance(name, str) else MISSING

    def font(self) -> dict | None:
        entry = self.resource("Font", self.state.font)
        return self.doc.fonts.get(font_key(entry)) if entry else None

    def space(self, name):
        return self.doc.resolve(self.resource("ColorSpace", name)) or name

    # -- state

    def save(self, o) -> None:
        if len(self.stack) >= self.doc.limits["maxGraphicsStackDepth"]:
            self.unsupported["q/StackDepth"] += 1
        else:
            self.stack.append(copy.copy(self.state))

    def restore(self, o) -> None:
        self.state = self.stack.pop() if self.stack else State()

    def concat(self, o) -> None:
        m = [as_number(v) for v in o[-6:]]
        self.state.ctm = multiply(self.state.ctm, m + [math.nan] * (6 - len(m)))

    def set_dash(self, o) -> None:
        first = _at(o, 0)
        self.state.dash = [as_number(v) for v in first] if isinstance(first, list) else []
        self.state.dash_phase = _n(o, 1)

    def set_color(self, o, operator: str) -> None:
        kind = "fill" if operator.islower() else "stroke"
        name = {"g": "DeviceGray", "r": "DeviceRGB", "k": "DeviceCMYK"}.get(operator[0].lower())
        if operator.lower() == "cs":
            setattr(self.state, f"{kind}_space", _at(o, -1) or getattr(self.state, f"{kind}_space"))
        elif operator.lower() in ("sc", "scn"):
            setattr(self.state, kind, graphics.space_color(self.space(getattr(self.state, f"{kind}_space")), o))
        else:
            setattr(self.state, f"{kind}_space", name)
            setattr(self.state, kind, graphics.space_color(name, o) if name == "DeviceCMYK" else graphics.device_color(operator, o))

    def ext_state(self, o) -> None:
        g = self.doc.resolve(self.resource("ExtGState", _at(o, -1)))
        if not isinstance(g, dict):
            return
        for key, name in (("ca", "fill_alpha"), ("CA", "stroke_alpha"), ("LW", "width"), ("ML", "miter")):
            if _real(g.get(key)):
                setattr(self.state, name, g[key])
        for key, name, kinds in (("LC", "cap", CAPS), ("LJ", "join", JOINS)):
            if _real(g.get(key)):
                setattr(self.state, name, kinds[g[key]] if g[key] in (0, 1, 2) else kinds[0])
        if isinstance(g.get("D"), list):
            self.set_dash(g["D"])
        if mode := g.get("BM"):
            known = next((m for m in (mode if isinstance(mode, list) else [mode]) if isinstance(m, str) and m in BLEND_MODES), None)
            if known:
                self.state.blend = str(known)
            else:
                self.unsupported["gs/BlendMode"] += 1
        if "SMask" in g:
            mask = self.doc.resolve(g["SMask"])
            if g["SMask"] == "None":
                self.state.mask = None
            elif isinstance(mask, dict) and mask.get("S") in ("Alpha", "Luminosity") and mask.get("G"):
                self.state.mask = (id(mask), str(mask["S"]), self.state.ctm, mask)
            else:
                self.unsupported["gs/SoftMask"] += 1

    def pending_mask(self):
        """The soft mask that is not being applied around what is drawn now."""
        mask = self.state.mask
        return mask if mask and mask[:3] != self.active_mask else None

    def unmasked(self) -> None:
        if self.pending_mask():
            self.unsupported["gs/SoftMaskNonXObject"] += 1

    # -- text

    def move(self, x: float, y: float) -> None:
        self.state.line = self.state.text = multiply(self.state.line, (1, 0, 0, 1, x, y))

    def next_line(self, o=()) -> None:
        self.move(0, -self.state.leading or -self.state.size * 1.2)

    def set_matrix(self, o) -> None:
        m = [as_number(v) for v in o[:6]]
        self.state.line = self.state.text = tuple(m + [math.nan] * (6 - len(m)))

    def set_font(self, o) -> None:
        self.state.font = _at(o, 0)
        self.state.size = _n(o, 1, self.state.size)

    def move_leading(self, o) -> None:
        self.state.leading = -_n(o, 1)
        self.move(_n(o, 0), _n(o, 1))

    def advance(self, by: float) -> None:
        self.state.text = multiply(self.state.text, (1, 0, 0, 1, by, 0))

    def show(self, o) -> None:
        self.show_value(_at(o, -1))

    def show_next(self, o) -> None:
        self.next_line()
        self.show(o)

    def show_spaced(self, o) -> None:
        self.state.word_spacing, self.state.char_spacing = _n(o, 0), _n(o, 1)
        self.show_next(o)

    def show_list(self, o) -> None:
        parts = _at(o, -1)
        for part in parts if isinstance(parts, list) else ():
            if _real(part):
                self.advance(-(part / 1000) * self.state.size * self.state.scale)
            else:
                self.show_value(part)

    def show_value(self, value) -> None:
        s, font = self.state, self.font()
        run = glyph_run(token_bytes(value), font)
        codes, names, texts, widths = map(list, zip(*run, strict=True)) if run else ([], [], [], [])
        text = whole_text("".join(texts))
        if not text:
            return
        by = None
        if None not in widths:
            gaps = len(text) * s.char_spacing + text.count(" ") * s.word_spacing
            by = sum(w / 1000 * s.size for w in widths) + gaps
        matrix = multiply(s.ctm, s.text)
        tall = math.hypot(matrix[2], matrix[3]) or math.hypot(matrix[0], matrix[1]) or 1
        x, y = apply(matrix, 0, s.rise)
        px, py = self.geometry.point(x, y)
        self.unmasked()
        if s.mode >= 4:
            self.unsupported["Tr/TextClip"] += 1
        self.spans.append(
            {
                "ord": len(self.spans), "text": text, "font": font["base_font"] if font else None, "resource": str(s.font) if isinstance(s.font, str) else None,
                "size": float(abs(s.size * tall) or 1), "x": x, "y": y, "page_x": px, "page_y": py, "advance": None if by is None else float(by * s.scale),
                "mode": int(s.mode), "fill": s.fill, "form_path": self.form_path(), "codes": codes, "names": names,
            }
        )
        if by is not None:
            self.advance(by * s.scale)

    # -- paths

    def form_path(self) -> str:
        return "/".join(map(str, self.forms))

    def to_page(self, x, y) -> tuple[float, float]:
        return self.geometry.point(*apply(self.state.ctm, truthy_number(x), truthy_number(y)))

    def draw(self, kind: str, *points) -> None:
        coords = (f"{v:.6g}" for x, y in points for v in self.to_page(x, y))
        self.path.append(" ".join((kind, *coords)))

    def path_move(self, o) -> None:
        self.draw("M", (_n(o, 0), _n(o, 1)))
        self.state.current = self.state.start = (_n(o, 0), _n(o, 1))

    def path_line(self, o) -> None:
        self.draw("L", (_n(o, 0), _n(o, 1)))
        self.state.current = (_n(o, 0), _n(o, 1))

    def path_curve(self, o, kind: str = "c") -> None:
        given = [(_n(o, i), _n(o, i + 1)) for i in range(0, 6 if kind == "c" else 4, 2)]
        points = {"c": given, "v": [self.state.current or (0, 0), *given], "y": [*given, given[-1]]}[kind]
        self.draw("C", *points)
        self.state.current = points[-1]

    def path_rect(self, o) -> None:
        x, y, w, h = (_n(o, i) for i in range(4))
        self.draw("M", (x, y))
        for p in ((x + w, y), (x + w, y + h), (x, y + h)):
            self.draw("L", p)
        self.path.append("Z")
        self.state.current = None

    def path_close(self, o=()) -> None:
        self.path.append("Z")
        self.state.current = self.state.start

    def end_path(self, o=()) -> None:
        self.path = []
        self.state.current = self.state.start = None

    def paint(self, kind: str, rule: str | None = None, **more) -> None:
        s = self.state
        row = {
            "ord": len(self.paints), "kind": kind, "rule": rule, "path": " ".join(self.path) if kind in ("fill", "stroke", "clip") else None,
            "fill": s.fill if kind != "stroke" else None, "stroke": s.stroke if kind == "stroke" else None, "line_width": float(s.width) if kind == "stroke" else None,
            "alpha": float(s.stroke_alpha if kind == "stroke" else s.fill_alpha), "blend": s.blend, "form_path": self.form_path(), "detail": None,
        }
        self.paints.append(row | more)

    def paint_path(self, o, fill: str | None, stroke: bool, close: bool = False) -> None:
        if close:
            self.path_close()
        if fill:
            self.unmasked()
            self.paint("fill", fill)
        if stroke:
            self.unmasked()
            self.paint("stroke")
        self.end_path()

    # -- shadings and XObjects

    def isolated(self, draw, mask) -> None:
        width, height = self.geometry.pixels
        most = self.doc.limits["maxTransparencyPixels"]
        if width * height > most:
            raise PdfError(f"PDF limit exceeded: Transparency layer pixels {width * height} > {most}")
        before, self.active_mask = self.active_mask, mask[:3] if mask else self.active_mask
        try:
            draw()
        finally:
            self.active_mask = before
        if mask:
            self.apply_mask(mask)

    def apply_mask(self, mask) -> None:
        form = self.doc.object_for(mask[3].get("G"))
        group = self.doc.get(form.value, "Group") if form else None
        if not form or form.stream is None or form.value.get("Subtype") != "Form" or not isinstance(group, dict) or group.get("S") != "Transparency":
            self.unsupported["gs/SoftMaskGroup"] += 1
            return
        if mask[3].get("TR") not in (None, "Identity"):
            self.unsupported["gs/SoftMaskTransfer"] += 1
        if len(self.forms) >= self.doc.limits["maxFormXObjectDepth"]:
            self.unsupported["Do/FormDepth"] += 1
            return
        inner = Interpreter(self.doc, self.page, self.geometry.scale)
        inner.state = copy.copy(self.state)
        inner.state.ctm, inner.state.mask, inner.state.blend = mask[2], None, "Normal"
        inner.resources, inner.forms = self.resources, [*self.forms, int(form.id)]
        inner.paint_form(form, False)
        self.unsupported += inner.unsupported

    def shade(self, o) -> None:
        if self.open_groups and self.active_mask:
            self.unsupported["sh/NonIsolatedSoftMask"] += 1
        elif mask := self.pending_mask():
            self.isolated(lambda: self.shade_now(o), mask)
        else:
            self.shade_now(o)

    def shade_now(self, o) -> None:
        problem, stops = self.shading(self.doc.resolve(self.resource("Shading", _at(o, -1))))
        if problem:
            self.unsupported[f"sh/{problem}"] += 1
        else:
            self.paint("shading", detail=stops)

    def shading(self, d) -> tuple[str | None, str | None]:
        """(what is not supported, or the axis and its colours)."""
        coords = d.get("Coords") if isinstance(d, dict) else None
        if not isinstance(d, dict) or d.get("ShadingType") != 2 or not isinstance(coords, list) or len(coords) != 4 or not all(map(_real, coords)):
            return "ShadingType", None
        space = self.doc.color_space(d.get("ColorSpace", MISSING))
        if not isinstance(space, str) or space not in ("DeviceGray", "DeviceRGB", "DeviceCMYK"):
            return "ColorSpace", None
        extend = d.get("Extend")
        if not isinstance(extend, list) or len(extend) < 2 or extend[0] is not True or extend[1] is not True:
            return "Extend", None
        f = graphics.color_function(self.doc, d.get("Function"))
        if not f:
            return "Function", None
        a, b = self.to_page(*coords[:2]), self.to_page(*coords[2:])
        if a == b:
            return "Coords", None
        domain = d.get("Domain") or [0, 1]
        if not isinstance(domain, list) or len(domain) != 2 or not all(map(_real, domain)) or domain[0] >= domain[1]:
            return "Domain", None
        low, high = domain
        colors = [graphics.space_color(space, f(low + (high - low) * i / SHADING_STOPS)) for i in range(SHADING_STOPS + 1)]
        return None, f"{a[0]:.6g} {a[1]:.6g} {b[0]:.6g} {b[1]:.6g}: " + ";".join(colors)

    def x_object(self, o) -> None:
        obj = self.doc.object_for(self.resource("XObject", _at(o, -1)))
        if not obj or obj.stream is None or not isinstance(obj.value, dict):
            self.unsupported["Do"] += 1
            return
        kind = obj.value.get("Subtype")
        if kind == "Form":
            self.paint_form(obj)
        elif kind == "Image":
            mask = self.pending_mask()
            if mask:
                self.isolated(lambda: self.paint_image(obj), mask)
            else:
                self.paint_image(obj)
        else:
            self.unsupported[f"Do/{kind or 'unknown'}"] += 1

    def paint_image(self, obj) -> None:
        filters = codecs.filter_list(self.doc.get(obj.value, "Filter"))
        if not graphics.image_size(self.doc, obj.value):
            self.unsupported["Do/ImageLimit"] += 1
            return
        said = "+".join(map(str, filters)) or "raw"
        try:
            made = graphics.rgba(self.doc, obj)
        except graphics.MaskProblem:
            self.unsupported["Do/ImageSoftMask"] += 1
            made = None
        except PdfError:
            self.unsupported["Do/ImageDecode"] += 1
            return
        if made is None:
            # JPEG pixels need a decoder that is not here; the image still counts as painted
            if filters in (["DCTDecode"], ["DCT"]):
                self.paint("image", detail=f"{int(obj.id)} jpeg")
            else:
                self.unsupported[f"Do/Image/{said}"] += 1
            return
        corners = " ".join(f"{v:.6g}" for p in ((0, 0), (1, 0), (1, 1), (0, 1)) for v in self.to_page(*p))
        self.paint("image", detail=f"{int(obj.id)} {corners}")

    def paint_form(self, obj, count_depth: bool = True) -> None:
        if count_depth and len(self.forms) >= self.doc.limits["maxFormXObjectDepth"]:
            self.unsupported["Do/FormDepth"] += 1
            return
        d = obj.value
        try:
            toks = self.doc.form_tokens(obj)
        except PdfError as e:
            if "content tokens" in str(e):
                raise
            self.unsupported["Do/FormFilter"] += 1
            return
        group = self.doc.get(d, "Group")
        group = group if isinstance(group, dict) and group.get("S") == "Transparency" else None
        alone = group is not None and group.get("I") is True
        if group and not alone:
            self.unsupported["Do/TransparencyNonIsolated"] += 1
        if group and group.get("K") is True:
            self.unsupported["Do/TransparencyKnockout"] += 1
        mask = self.pending_mask()

        def draw():
            self.open_groups += bool(group and not alone)
            try:
                self.form_content(obj, toks, count_depth)
            finally:
                self.open_groups -= bool(group and not alone)

        if alone or mask:
            self.isolated(draw, mask)
        else:
            draw()

    def form_content(self, obj, toks, push: bool) -> None:
        kept, resources = copy.copy(self.state), self.resources
        if push:
            self.forms.append(int(obj.id))
        try:
            self.resources = self.doc.get(obj.value, "Resources") or resources
            matrix = numbers(self.doc.get(obj.value, "Matrix"))
            if matrix and len(matrix) == 6:
                self.state.ctm = multiply(self.state.ctm, matrix)
            box = numbers(self.doc.get(obj.value, "BBox"))
            if box and len(box) == 4:
                a, b, c, d = box
                said = " ".join(f"{v:.6g}" for p in ((a, b), (c, b), (c, d), (a, d)) for v in self.to_page(*p))
                self.paint("form", detail=said)
            self.fold(toks)
        finally:
            self.state, self.resources = kept, resources
            if push:
                self.forms.pop()


def _setter(name: str, index: int, default: float = 0, scale: float = 1):
    def run(self, o):
        setattr(self.state, name, _n(o, index, default) / scale)

    return run


def _choice(name: str, kinds: tuple):
    def run(self, o):
        n = as_number(o[-1]) if o else math.nan
        setattr(self.state, name, kinds[int(n)] if n in (0, 1, 2) else kinds[0])

    return run


def _color(operator: str):
    return lambda self, o: self.set_color(o, operator)


def _path(fill: str | None, stroke: bool, close: bool = False):
    return lambda self, o: self.paint_path(o, fill, stroke, close)


def _begin_text(self, o):
    self.state.text = self.state.line = IDENTITY


OPERATORS = {
    "q": Interpreter.save, "Q": Interpreter.restore, "cm": Interpreter.concat, "d": Interpreter.set_dash, "gs": Interpreter.ext_state,
    "w": _setter("width", -1, 1), "M": _setter("miter", -1, 10), "J": _choice("cap", CAPS), "j": _choice("join", JOINS),
    "Tc": _setter("char_spacing", 0), "Tw": _setter("word_spacing", 0), "Tz": _setter("scale", 0, 100, 100), "TL": _setter("leading", 0),
    "Tr": _setter("mode", 0), "Ts": _setter("rise", 0), "BT": _begin_text, "Tf": Interpreter.set_font, "Tm": Interpreter.set_matrix,
    "Td": lambda self, o: self.move(_n(o, 0), _n(o, 1)), "TD": Interpreter.move_leading, "T*": Interpreter.next_line,
    "Tj": Interpreter.show, "'": Interpreter.show_next, '"': Interpreter.show_spaced, "TJ": Interpreter.show_list,
    "m": Interpreter.path_move, "l": Interpreter.path_line, "c": Interpreter.path_curve, "re": Interpreter.path_rect, "h": Interpreter.path_close,
    "v": lambda self, o: self.path_curve(o, "v"), "y": lambda self, o: self.path_curve(o, "y"), "n": Interpreter.end_path,
    "W": lambda self, o: self.paint("clip", "nonzero"), "W*": lambda self, o: self.paint("clip", "evenodd"),
    "S": _path(None, True), "s": _path(None, True, True), "f": _path("nonzero", False), "F": _path("nonzero", False), "f*": _path("evenodd", False),
    "B": _path("nonzero", True), "B*": _path("evenodd", True), "b": _path("nonzero", True, True), "b*": _path("evenodd", True, True),
    "sh": Interpreter.shade, "Do": Interpreter.x_object,
} | {op: _color(op) for op in ("g", "G", "rg", "RG", "k", "K", "cs", "CS", "sc", "SC", "scn", "SCN")}


def whole_text(text: str) -> str:
    """text with pairs of surrogates joined; a lone one is replaced, as it is no character."""
    return text if text.isascii() or not any("\ud800" <= c <= "\udfff" for c in text) else text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def unsupported_text(counts: Counter) -> str:
    """Counts as lines, the highest first, then by name."""
    lines = [f"{k}: {number_text(n)}" for k, n in sorted(counts.items(), key=lambda x: (-x[1], x[0]))]
    return "\n".join(lines) or "None seen in interpreted content streams."
