"""Stream filters with output caps, image predictors, RC4 and the Standard security handler's 40-bit key."""

from __future__ import annotations

import hashlib
import re
import struct
import zlib

import numpy as np

from quire.functions.limits import PdfError, check
from quire.functions.values import Hex, Text, hex_bytes

#: Fixed value: the padding of the Standard security handler.
PASSWORD_PADDING = bytes.fromhex("28bf4e5e4e758a4164004e56fffa01082e2e00b6d0683e802f0ca9fe6453697a")
#: Full name by short name.
SHORT_NAMES = {"Fl": "FlateDecode", "AHx": "ASCIIHexDecode", "A85": "ASCII85Decode", "RL": "RunLengthDecode", "DCT": "DCTDecode"}


def inflate(data: bytes, most: int) -> bytes:
    d = zlib.decompressobj()
    try:
        out = d.decompress(data, most + 1)
    except zlib.error as e:
        raise PdfError(f"invalid Flate data: {e}") from None
    check("Decoded Flate stream size", len(out), most)
    if not d.eof:
        raise PdfError("Flate data is cut off")
    if d.unused_data:
        raise PdfError("Flate data is followed by other bytes")
    return out


def ascii_hex(data: bytes, most: int) -> bytes:
    digits = re.sub(r"\s+", "", data.decode("latin-1")).partition(">")[0]
    check("Decoded ASCIIHex stream size", (len(digits) + 1) // 2, most)
    return hex_bytes(digits)


def ascii85(data: bytes, most: int) -> bytes:
    """Bytes outside ! to u are passed over, z counts between groups only, and a lone last digit still gives a byte."""
    s = re.sub(r"\s+", "", data.decode("latin-1")).removeprefix("<~").removesuffix("~>")
    out, group = bytearray(), []
    for c in s:
        if c == "z" and not group:
            out += bytes(4)
        elif "!" <= c <= "u":
            group.append(ord(c) - 33)
            if len(group) == 5:
                out += _base85(group)
                group = []
        check("Decoded ASCII85 stream size", len(out), most)
    if group:
        out += _base85(group + [84] * (5 - len(group)))[: max(1, len(group) - 1)]
        check("Decoded ASCII85 stream size", len(out), most)
    return bytes(out)


def _base85(digits: list[int]) -> bytes:
    n = 0
    for d in digits:
        n = n * 85 + d
    return struct.pack(">I", n & 0xFFFFFFFF)


def run_length(data: bytes, most: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and data[at] != 128:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        else:
            out += (data[at + 1 : at + 2] or b"\0") * (257 - n)
            at += 2
        check("Decoded RunLength stream size", len(out), most)
    return bytes(out)


FILTERS = {"FlateDecode": inflate, "ASCIIHexDecode": ascii_hex, "ASCII85Decode": ascii85, "RunLengthDecode": run_length}


def filter_list(value) -> list:
    """A Filter entry as a list."""
    return [] if not value else value if isinstance(value, list) else [value]


def is_data_filter(name) -> bool:
    return isinstance(name, str) and SHORT_NAMES.get(name, name) in FILTERS


def decode(data: bytes, filters: list, most: int) -> bytes:
    for name in filters:
        run = FILTERS.get(SHORT_NAMES.get(name, name)) if isinstance(name, str) else None
        if run is None:
            raise PdfError(f"Unsupported stream filter {name}")
        data = run(data, most)
    return data


def tiff_predictor(data: bytes, colors: int, columns: int, rows: int) -> bytes:
    """Sums along each row, component by component; bytes past the rows stay."""
    width = colors * columns
    a = np.frombuffer(data, np.uint8)
    out = a.copy()
    full = min(rows, len(a) // width)
    if full:
        body = a[: full * width].reshape(full, columns, colors)
        out[: full * width] = np.cumsum(body, axis=1, dtype=np.uint64).astype(np.uint8).reshape(-1)
    tail = a[full * width : (full + 1) * width] if full < rows else a[:0]
    for c in range(colors):
        part = tail[c::colors]
        out[full * width : full * width + len(tail)][c::colors] = np.cumsum(part, dtype=np.uint64).astype(np.uint8)
    return out.tobytes()


def png_predictor(data: bytes, colors: int, columns: int, rows: int) -> bytes:
    """Rows of one filter byte and samples; what the data doesn't reach is 0."""
    width = colors * columns
    out, above, at = bytearray(), bytes(width), 0
    for _ in range(rows):
        if at >= len(data):
            break
        kind, raw = data[at], data[at + 1 : at + 1 + width]
        at += 1 + len(raw)
        row = bytearray(raw)
        if kind == 1:
            for i in range(colors, len(row)):
                row[i] = (row[i] + row[i - colors]) & 255
        elif kind == 2:
            row = bytearray((np.frombuffer(raw, np.uint8) + np.frombuffer(above, np.uint8)[: len(raw)]).tobytes())
        elif kind == 3:
            for i in range(len(row)):
                row[i] = (row[i] + ((row[i - colors] if i >= colors else 0) + above[i]) // 2) & 255
        elif kind == 4:
            for i in range(len(row)):
                a, b, c = (row[i - colors], above[i], above[i - colors]) if i >= colors else (0, above[i], 0)
                near = min((abs(b - c), 0, a), (abs(a - c), 1, b), (abs(a + b - 2 * c), 2, c))
                row[i] = (row[i] + near[2]) & 255
        above = bytes(row) + bytes(width - len(row))
        out += above
    return bytes(out) + bytes(width * rows - len(out))


def rc4(key: bytes, data: bytes) -> bytes:
    s, j = list(range(256)), 0
    for i in range(256):
        j = (j + s[i] + key[i % len(key)]) & 255
        s[i], s[j] = s[j], s[i]
    out, i, j = bytearray(len(data)), 0, 0
    for n, byte in enumerate(data):
        i = (i + 1) & 255
        j = (j + s[i]) & 255
        s[i], s[j] = s[j], s[i]
        out[n] = byte ^ s[(s[i] + s[j]) & 255]
    return bytes(out)


def file_key(password: bytes, owner: bytes, user: bytes, permissions: int, file_id: bytes) -> bytes:
    """The 40-bit key that a user or owner password opens; raises if it opens nothing."""

    def key(padded: bytes) -> bytes:
        return hashlib.md5(padded + owner + struct.pack("<I", int(permissions) & 0xFFFFFFFF) + file_id).digest()[:5]

    padded = (password[:32] + PASSWORD_PADDING)[:32]
    for found in (key(padded), key(rc4(hashlib.md5(padded).digest()[:5], owner))):
        if rc4(found, PASSWORD_PADDING) == user:
            return found
    raise PdfError("Cannot decrypt PDF: a valid password is required.")


def object_key(key: bytes, number: float, generation: float) -> bytes:
    return hashlib.md5(key + struct.pack("<Q", int(number))[:3] + struct.pack("<Q", int(generation))[:2]).digest()[:10]


def decrypt_strings(value, key: bytes):
    if isinstance(value, Hex):
        return Hex(rc4(key, value.bytes()).hex())
    if isinstance(value, Text):
        return Text(rc4(key, value.bytes()).decode("latin-1"))
    if isinstance(value, list):
        return [decrypt_strings(v, key) for v in value]
    if isinstance(value, dict):
        return {k: decrypt_strings(v, key) for k, v in value.items()}
    return value
