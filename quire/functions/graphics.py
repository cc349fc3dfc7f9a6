"""Matrices, colours, colour functions, and images as RGBA samples."""

from __future__ import annotations

import math

import numpy as np

from quire.functions import codecs
from quire.functions.limits import PdfError
from quire.functions.values import MISSING, Hex, Text, as_number, truthy_number

IDENTITY = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)


def multiply(m, n):
    """n first, then m."""
    a, b, c, d, e, f = m
    p, q, r, s, t, u = n
    return (a * p + c * q, b * p + d * q, a * r + c * s, b * r + d * s, a * t + c * u + e, b * t + d * u + f)


def apply(m, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


def half_up(x: float) -> int:
    return math.floor(x + 0.5)


def unit(value) -> float:
    n = as_number(value) if value is not MISSING else 0
    return min(1.0, max(0.0, n)) if n == n else 0.0


def component(value) -> int:
    return half_up(unit(value) * 255)


def css(r: int, g: int, b: int) -> str:
    return f"rgb({r}, {g}, {b})"


def device_color(operator: str, operands: list) -> str:
    """g, G, rg, RG: components are not clamped."""
    if operator in ("g", "G"):
        return css(*[half_up(truthy_number(operands[0] if operands else 0) * 255)] * 3)
    last = [0, 0, 0, *operands][-3:] if len(operands) < 3 else operands[-3:]
    return css(*(half_up(truthy_number(v) * 255) for v in last))


def space_color(space, operands: list) -> str:
    """One component is gray and four are CMYK, whatever the space; else what the space's name says."""
    parts = [v for v in operands if isinstance(v, int | float) and not isinstance(v, bool)]
    name = space[0] if isinstance(space, list) and space else space
    if name == "DeviceGray" or len(parts) == 1:
        return css(*[component(parts[0] if parts else 0)] * 3)
    if name == "DeviceCMYK" or len(parts) >= 4:
        c, m, y, k = (unit(v) for v in (parts + [0, 0, 0, 0])[:4])
        return css(*(component((1 - v) * (1 - k)) for v in (c, m, y)))
    return css(*(component(v) for v in (parts[-3:] + [0, 0, 0])[:3]))


def cmyk_bytes(samples: np.ndarray) -> np.ndarray:
    s = samples.astype(float) / 255
    return np.floor(255 * (1 - s[:, :3]) * (1 - s[:, 3:4]) + 0.5).astype(np.uint8)


# -- colour functions


def _finite(values) -> bool:
    return isinstance(values, list) and all(isinstance(v, int | float) and not isinstance(v, bool) and math.isfinite(v) for v in values)


def color_function(doc, reference, path: tuple = ()):
    """number -> list of components, for types 0 (one input), 2 and 3; None for what is not supported."""
    if len(path) > 8:
        return None
    if isinstance(reference, list):
        made = [color_function(doc, r, (*path, None)) for r in reference]
        return (lambda x: [v for f in made for v in f(x)]) if all(made) else None
    d = doc.resolve(reference)
    if not isinstance(d, dict) or id(d) in path:
        return None
    domain = d.get("Domain") or [0, 1]
    if not _finite(domain) or len(domain) != 2 or domain[0] >= domain[1]:
        return None
    low, high = domain
    make = {2: _exponential, 3: _stitched, 0: _sampled}.get(d.get("FunctionType"))
    made = make and make(doc, d, reference, (*path, id(d)), low, high)
    return made and (lambda x: made(min(high, max(low, x))))


def _exponential(doc, d, reference, path, low, high):
    first, last, n = d.get("C0") or [0], d.get("C1") or [1], d.get("N")
    if not (_finite(first) and _finite(last) and _finite([n]) and len(first) == len(last) and n > 0):
        return None
    return lambda x: [a + ((x - low) / (high - low)) ** n * (b - a) for a, b in zip(first, last, strict=True)]


def _stitched(doc, d, reference, path, low, high):
    parts, encode, bounds = d.get("Functions"), d.get("Encode"), [low, *(d.get("Bounds") or []), high]
    fine = isinstance(parts, list) and parts and _finite(encode) and len(encode) == 2 * len(parts) and len(bounds) == len(parts) + 1 and _finite(bounds)
    if not fine or any(b <= a for a, b in zip(bounds, bounds[1:], strict=False)):
        return None
    made = [color_function(doc, p, path) for p in parts]
    if not all(made):
        return None

    def run(x):
        i = max(0, min(len(parts) - 1, sum(x >= b for b in bounds[1:-1])))
        a, b = encode[2 * i], encode[2 * i + 1]
        return made[i](a + (x - bounds[i]) / (bounds[i + 1] - bounds[i]) * (b - a))

    return run


def _sampled(doc, d, reference, path, low, high):
    size, bits, ranges = d.get("Size"), d.get("BitsPerSample"), d.get("Range")
    fine = d.get("Order") in (None, 0, 1) and isinstance(size, list) and len(size) == 1 and isinstance(size[0], int) and size[0] >= 1 and bits in (8, 16)
    obj = doc.object_for(reference)
    if not fine or not _finite(ranges) or not ranges or len(ranges) % 2 or not obj or obj.stream is None:
        return None
    n, outs = size[0], len(ranges) // 2
    raw = doc.decoded(obj)
    if len(raw) < n * outs * bits // 8:
        raise PdfError("Truncated sampled PDF color function")
    encode, decode = d.get("Encode") or [0, n - 1], d.get("Decode") or ranges
    if not _finite(encode) or not _finite(decode) or len(encode) != 2 or len(decode) != len(ranges):
        return None
    lows, highs = np.array(decode[::2], float), np.array(decode[1::2], float)
    table = np.frombuffer(raw, ">u2" if bits == 16 else "u1", n * outs).reshape(n, outs) / (2**bits - 1) * (highs - lows) + lows

    def run(x):
        at = min(n - 1, max(0, encode[0] + (x - low) / (high - low) * (encode[1] - encode[0])))
        before = int(at)
        mixed = table[before] * (1 - (at - before)) + table[min(n - 1, before + 1)] * (at - before)
        return np.clip(mixed, ranges[::2], ranges[1::2]).tolist()

    return run


# -- images


def image_size(doc, d) -> tuple[int, int] | None:
    """Width and height, if they are whole, positive and within the caps."""
    sides = []
    for key in ("Width", "Height"):
        n = doc.get(d, key)
        n = math.nan if n is MISSING else as_number(n)
        if n != n or math.isinf(n) or n != int(n) or not 0 < n <= doc.limits["maxImageDimension"]:
            return None
        sides.append(int(n))
    return tuple(sides) if sides[0] * sides[1] <= doc.limits["maxImagePixels"] else None


def components_of(space, n_bytes: int, pixels: int) -> int:
    name = space[0] if isinstance(space, list) and space else space
    fixed = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(name) if isinstance(name, str) else None
    if fixed:
        return fixed
    if name == "ICCBased" and len(space) > 1 and isinstance(space[1], dict) and space[1].get("N") in (1, 3, 4):
        return space[1]["N"]
    return n_bytes // pixels if n_bytes % max(1, pixels) == 0 else 0


def undo_predictor(data: bytes, d: dict, width: int, height: int) -> bytes:
    """The first DecodeParms' predictor, for 8-bit components only."""
    parms = d.get("DecodeParms") or d.get("DP")
    parms = (parms[0] if parms else None) if isinstance(parms, list) else parms
    parms = parms if isinstance(parms, dict) else {}
    kind = truthy_number(parms.get("Predictor", MISSING), 1)
    if kind <= 1:
        return data
    colors = int(truthy_number(parms.get("Colors", MISSING)) or components_of(d.get("ColorSpace"), len(data), width * height) or 1)
    bits = truthy_number(parms.get("BitsPerComponent", MISSING)) or truthy_number(d.get("BitsPerComponent", MISSING), 8)
    columns = int(truthy_number(parms.get("Columns", MISSING), width))
    if bits != 8 or colors < 1 or columns < 1 or colors * columns * height > 1 << 28:
        return data
    if kind == 2:
        return codecs.tiff_predictor(data, colors, columns, height)
    return codecs.png_predictor(data, colors, columns, height) if 10 <= kind <= 15 else data


def unpack(data: bytes, bits: int, width: int, height: int, decode=None) -> np.ndarray:
    """Samples of 1, 2, 4 or 8 bits, rows padded to bytes; what is missing is 0."""
    if bits not in (1, 2, 4, 8):
        return np.zeros(width * height, np.uint8)
    row = -(-width * bits // 8)
    a = np.zeros(row * height, np.uint8)
    raw = np.frombuffer(data, np.uint8)[: row * height]
    a[: len(raw)] = raw
    per = 8 // bits
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    out = ((a[:, None] >> shifts) & ((1 << bits) - 1)).reshape(height, row * per)[:, :width].reshape(-1).astype(np.uint8)
    two = decode[:2] if isinstance(decode, list) else None
    if two and len(two) == 2 and _finite(two):
        out = np.floor(two[0] + out / ((1 << bits) - 1) * (two[1] - two[0]) + 0.5).astype(np.int64).astype(np.uint8)
    return out


def palette(doc, space) -> np.ndarray | None:
    """RGB rows of an Indexed space."""
    if not isinstance(space, list) or len(space) < 4 or space[0] not in ("Indexed", "I"):
        return None
    base, high = doc.resolve(space[1]), doc.resolve(space[2])
    high = math.nan if high is MISSING else as_number(high)
    name = base[0] if isinstance(base, list) and base else base
    n = {"DeviceGray": 1, "DeviceRGB": 3, "DeviceCMYK": 4}.get(name, 0) if isinstance(name, str) else 0
    if name == "ICCBased" and len(base) > 1 and isinstance(base[1], dict) and base[1].get("N") in (1, 3, 4):
        n = base[1]["N"]
    if high != high or n < 1 or high + 1 > doc.limits["maxIndexedPaletteEntries"]:
        return None
    look = doc.resolve(space[3])
    obj = doc.object_for(space[3])
    raw = look.bytes() if isinstance(look, Hex | Text) else doc.decoded(obj) if obj and obj.stream is not None else b""
    if not raw or high < 0:
        return None
    table = np.zeros((int(high) + 1) * n, np.uint8)
    part = np.frombuffer(raw, np.uint8)[: len(table)]
    table[: len(part)] = part
    table = table.reshape(-1, n)
    if name == "DeviceCMYK":
        return cmyk_bytes(table)
    if name == "DeviceGray":
        return np.repeat(table, 3, axis=1)
    return np.concatenate((table, np.zeros((len(table), 3), np.uint8)), axis=1)[:, :3]


def _ranged(samples: np.ndarray, decode) -> np.ndarray:
    """Samples through a Decode array, component by component."""
    out = samples.copy()
    for i in range(samples.shape[1]):
        two = decode[2 * i : 2 * i + 2] if isinstance(decode, list) else []
        if len(two) == 2 and _finite(two):
            out[:, i] = np.floor(np.clip(two[0] + samples[:, i] / 255 * (two[1] - two[0]), 0, 1) * 255 + 0.5)
    return out


def alpha(doc, d: dict, width: int, height: int) -> np.ndarray | None:
    """The soft mask's samples, if it is an 8-bit gray image of the same size."""
    obj = doc.object_for(d.get("SMask"))
    if not obj or obj.stream is None or not isinstance(obj.value, dict):
        return None
    m = obj.value
    fine = image_size(doc, m) == (width, height) and doc.get(m, "BitsPerComponent") == 8 and "Matte" not in m and doc.get(m, "ColorSpace") == "DeviceGray"
    if not fine or not all(map(codecs.is_data_filter, codecs.filter_list(doc.get(m, "Filter")))):
        return None
    raw = undo_predictor(doc.decoded(obj), m, width, height)
    if len(raw) < width * height:
        return None
    samples = np.frombuffer(raw, np.uint8)[: width * height]
    decode = doc.get(m, "Decode")
    if decode is MISSING:
        return samples
    return _ranged(samples[:, None], decode)[:, 0] if _finite(decode) and len(decode) == 2 else None


class MaskProblem(PdfError):
    """An image's soft mask cannot be used."""


def rgba(doc, obj) -> np.ndarray | None:
    """Rows of RGBA; None for images that are not supported, MaskProblem for their masks."""
    d = obj.value
    size = image_size(doc, d)
    bits = doc.get(d, "BitsPerComponent")
    bits = math.nan if bits is MISSING else as_number(bits)
    if not size or bits != bits or not all(map(codecs.is_data_filter, codecs.filter_list(doc.get(d, "Filter")))):
        return None
    width, height = size
    space = doc.resolve(d.get("ColorSpace", MISSING))
    colors = palette(doc, space)
    if colors is None and bits != 8 and (bits not in (1, 2, 4) or space != "DeviceGray"):
        return None
    raw = undo_predictor(doc.decoded(obj), d, width, height)
    if colors is not None:
        at = unpack(raw, int(bits), width, height, d.get("Decode"))
        rgb = colors[np.where(at < len(colors), at, 0)]
    else:
        if bits != 8:
            if len(raw) < -(-width * int(bits) // 8) * height:
                return None
            raw = np.floor(unpack(raw, int(bits), width, height) * 255 / ((1 << int(bits)) - 1) + 0.5).astype(np.uint8).tobytes()
        n = components_of(space, len(raw), width * height)
        if n not in (1, 3, 4) or len(raw) < width * height * n:
            return None
        samples = _ranged(np.frombuffer(raw, np.uint8)[: width * height * n].reshape(-1, n), d.get("Decode"))
        rgb = np.repeat(samples, 3, axis=1) if n == 1 else cmyk_bytes(samples) if n == 4 else samples
    mask = alpha(doc, d, width, height)
    if d.get("SMask") and mask is None:
        raise MaskProblem("the soft mask is not supported")
    a = np.full((width * height, 1), 255, np.uint8) if mask is None else mask[:, None]
    return np.concatenate((rgb.astype(np.uint8), a), axis=1)
