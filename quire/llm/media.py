"""ISO media containers: write payloads as raw samples, read them back box by box.

`wrap` stores bytes losslessly as 8-bit gray samples of a raw video track: one
row of 64 samples is one line, a frame has up to 64 lines, every eighth frame
is marked as a keyframe, and several frames make a chunk. `walk` reads any ISO
file: it goes through nested boxes, decodes the sample tables and the runs of
fragments, and returns codec, duration and the byte ranges of keyframes without
touching payloads.

Defined results: null text is empty; empty text is stored as 64 zero bytes;
equal texts give equal bytes and features; broken containers give an error and
what was read before it, not an exception; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LINE, FRAME_LINES, KEY_EVERY, CHUNK_FRAMES, TIMESCALE, FRAME_TICKS = 64, 64, 8, 4, 1000, 40
FRAME = LINE * FRAME_LINES
#: Boxes that hold boxes, and how many bytes stand before those.
CONTAINERS = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"edts": 0, b"udta": 0, b"mvex": 0, b"moof": 0, b"traf": 0, b"meta": 4}
#: The bit of a sample's flags that says it is no keyframe.
NOT_SYNC = 0x10000
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def pad(data: bytes, to: int = LINE) -> bytes:
    """data with zero bytes up to a positive multiple of `to`."""
    return data + bytes(-len(data) % to if data else to)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 > 0xFFFFFFFF:
        return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body
    return struct.pack(">I4s", len(body) + 8, kind) + body


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def wrap(payload: bytes) -> bytes:
    """An ISO file with payload, a positive multiple of 64 bytes, as raw frames."""
    frames = -(-len(payload) // FRAME)
    sizes = [FRAME] * (frames - 1) + [len(payload) - FRAME * (frames - 1)]
    lines = min(FRAME_LINES, sizes[0] // LINE)
    ticks = frames * FRAME_TICKS
    chunks = -(-frames // CHUNK_FRAMES)
    last = frames - CHUNK_FRAMES * (chunks - 1)
    runs = [(1, CHUNK_FRAMES, 1)] if chunks > 1 or last == CHUNK_FRAMES else []
    if last != CHUNK_FRAMES:
        runs.append((chunks, last, 1))
    keys = list(range(1, frames + 1, KEY_EVERY))
    entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", LINE, lines, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 0x200), b"isomqt  ")

    def moov(first: int) -> bytes:
        offsets = [first + i * CHUNK_FRAMES * FRAME for i in range(chunks)]
        wide = first + len(payload) > 0xFFFFFFFF
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, frames, FRAME_TICKS)),
            _full(b"stss", struct.pack(f">I{len(keys)}I", len(keys), *keys)),
            _full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", *r) for r in runs)),
            _full(b"stsz", struct.pack(f">II{frames}I", 0, frames, *sizes)),
            _full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        dinf = _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1)))
        minf = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), dinf, stbl)
        mdhd = _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, TIMESCALE, ticks, 0x55C4, 0))
        hdlr = _full(b"hdlr", bytes(4), b"vide", bytes(12), b"raw\0")
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, ticks), bytes(8), struct.pack(">4H", 0, 0, 0, 0), _MATRIX, struct.pack(">II", LINE << 16, lines << 16), flags=3)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, TIMESCALE, ticks, 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, _box(b"mdia", mdhd, hdlr, minf)))

    head = len(ftyp) + len(moov(0)) + (8 if len(payload) + 8 <= 0xFFFFFFFF else 16)
    return ftyp + moov(head) + _box(b"mdat", payload)


class Broken(ValueError):
    pass


def boxes(data, low: int = 0, high: int | None = None, depth: int = 0):
    """(kind, path depth, body start, body end) of every box, containers before what they hold."""
    high = len(data) if high is None else high
    at = low
    while at + 8 <= high:
        size, kind = struct.unpack_from(">I4s", data, at)
        body = at + 8
        if size == 1:
            if at + 16 > high:
                raise Broken("a 64-bit size is cut off")
            size, body = struct.unpack_from(">Q", data, at + 8)[0], at + 16
        elif size == 0:
            size = high - at
        if size < body - at or at + size > high:
            raise Broken(f"box {kind!r} at {at} has size {size}")
        yield kind, depth, body, at + size
        if kind in CONTAINERS and depth < 16:
            yield from boxes(data, min(body + CONTAINERS[kind], at + size), at + size, depth + 1)
        at += size


def _ints(data, at: int, count: int, kind: str = ">u4") -> np.ndarray:
    width = np.dtype(kind).itemsize
    if count < 0 or at + count * width > len(data):
        raise Broken("a sample table is cut off")
    return np.frombuffer(data, kind, count, at).astype(np.int64)


def _sample_sizes(data, t: dict) -> np.ndarray:
    if b"stsz" in t:
        at, _ = t[b"stsz"]
        one, n = struct.unpack_from(">II", data, at + 4)
        if one and n > len(data):
            raise Broken("more samples than bytes")
        return np.full(n, one, np.int64) if one else _ints(data, at + 12, n)
    if b"stz2" in t:
        at, _ = t[b"stz2"]
        bits, n = struct.unpack_from(">B", data, at + 7)[0], struct.unpack_from(">I", data, at + 8)[0]
        if bits == 4:
            b = _ints(data, at + 12, (n + 1) // 2, "u1")
            return np.stack([b >> 4, b & 15], 1).reshape(-1)[:n]
        return _ints(data, at + 12, n, "u1" if bits == 8 else ">u2")
    return np.zeros(0, np.int64)


def samples(data, t: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Offsets, sizes, sync flags of a track's samples, and its duration by stts."""
    sizes = _sample_sizes(data, t)
    n = len(sizes)
    if b"stco" in t:
        at, _ = t[b"stco"]
        chunk = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0])
    elif b"co64" in t:
        at, _ = t[b"co64"]
        chunk = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0], ">u8")
    else:
        chunk = np.zeros(0, np.int64)
    per = np.zeros(len(chunk), np.int64)
    if b"stsc" in t:
        at, _ = t[b"stsc"]
        runs = _ints(data, at + 8, 3 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 3)
        for i, (first, count, _) in enumerate(runs):
            end = runs[i + 1][0] - 1 if i + 1 < len(runs) else len(chunk)
            per[max(0, first - 1) : end] = count
    if per.sum() < n:
        raise Broken("chunks hold fewer samples than the size table")
    # no chunk can hold more than what is left of the n samples
    per = np.minimum(per, np.maximum(n - (np.cumsum(per) - per), 0))
    of = np.repeat(np.arange(len(chunk)), per)
    before = np.cumsum(sizes) - sizes
    first = np.zeros(len(chunk), np.int64)
    starts = np.cumsum(per) - per
    has = (per > 0) & (starts < n)
    first[has] = before[starts[has]]
    offsets = chunk[of] + before - first[of] if n else np.zeros(0, np.int64)
    sync = np.ones(n, bool)
    if b"stss" in t:
        at, _ = t[b"stss"]
        keys = _ints(data, at + 8, struct.unpack_from(">I", data, at + 4)[0])
        sync[:] = False
        sync[keys[(keys >= 1) & (keys <= n)] - 1] = True
    ticks = 0
    if b"stts" in t:
        at, _ = t[b"stts"]
        ticks = int(_ints(data, at + 8, 2 * struct.unpack_from(">I", data, at + 4)[0]).reshape(-1, 2).prod(1).sum())
    return offsets, sizes, sync, ticks


def _after(data, at: int, flags: int, bits: dict[int, str]) -> tuple[dict[int, int], int]:
    """The optional fields that `flags` says stand at `at`, by their bit, and where they end."""
    found = {}
    for bit, kind in bits.items():
        if flags & bit:
            found[bit] = struct.unpack_from(kind, data, at)[0]
            at += struct.calcsize(kind)
    return found, at


def _run(data, at: int, base: int, follows: int, usual: tuple[int, int, int], room: int):
    """Offsets, sizes, sync flags and ticks of one run of samples; `usual` are duration, size and flags where it has none."""
    flags, n = struct.unpack_from(">II", data, at)
    given, at = _after(data, at + 8, flags, {0x1: ">i", 0x4: ">I"})
    fields = [bit for bit in (0x100, 0x200, 0x400, 0x800) if flags & bit]
    if n > room:
        raise Broken("more samples than bytes")
    table = _ints(data, at, n * len(fields)).reshape(n, len(fields))
    ticks, sizes, marks = (table[:, fields.index(bit)] if bit in fields else np.full(n, value) for bit, value in zip((0x100, 0x200, 0x400), usual, strict=True))
    sync = marks & NOT_SYNC == 0
    if 0x4 in given and n:
        sync[0] = given[0x4] & NOT_SYNC == 0
    first = base + given[0x1] if 0x1 in given else follows
    offsets = first + np.cumsum(sizes) - sizes
    if n and (int(offsets.min()) < 0 or int((offsets + sizes).max()) > len(data)):
        raise Broken("a sample lies beyond the file")
    return offsets, sizes, sync, int(ticks.sum())


def _add_fragments(data, fragments: list[dict], tracks: dict[int, dict], defaults: dict[int, tuple[int, int, int]]) -> None:
    """Append the fragments' samples to their tracks, one run after the other."""
    room, moof, follows = len(data), None, 0
    for f in fragments:
        if f["head"] is None:
            raise Broken("a track fragment has no header")
        flags, number = struct.unpack_from(">II", data, f["head"])
        given, _ = _after(data, f["head"] + 8, flags, {0x1: ">Q", 0x2: ">I", 0x8: ">I", 0x10: ">I", 0x20: ">I"})
        # without a base of its own: the moof, or the end of the data of the fragment before in the same moof
        base = given.get(0x1, f["moof"] if flags & 0x20000 or f["moof"] != moof else follows)
        moof, follows = f["moof"], base
        usual = tuple(given.get(bit, value) for bit, value in zip((0x8, 0x10, 0x20), defaults.get(number, (0, 0, 0)), strict=True))
        for at in f["runs"]:
            offsets, sizes, sync, ticks = _run(data, at, base, follows, usual, room)
            room -= len(sizes)
            if len(sizes):
                follows = int(offsets[-1] + sizes[-1])
            if (t := tracks.get(number)) is None:
                raise Broken(f"a fragment of track {number}, which is not there")
            t["ticks"] += ticks
            t["n_samples"] += len(sizes)
            t["parts"].append((offsets, sizes, np.stack([offsets[sync], offsets[sync] + sizes[sync]], 1)))


def walk(data) -> dict:
    """brand, duration, tracks and error of an ISO file; payloads are not read."""
    out = {"brand": None, "timescale": None, "duration": None, "tracks": [], "n_boxes": 0, "error": None}
    try:
        tables: dict | None = None
        found, fragments, defaults, by_number, moof = [], [], {}, {}, 0
        for kind, _, a, b in boxes(data):
            out["n_boxes"] += 1
            if kind == b"ftyp" and b - a >= 4:
                out["brand"] = bytes(data[a : a + 4]).decode("latin-1")
            elif kind == b"mvhd":
                out["timescale"], out["duration"] = struct.unpack_from(">IQ" if data[a] else ">II", data, a + (20 if data[a] else 12))
            elif kind == b"trak":
                tables = {}
                found.append(tables)
            elif kind == b"trex":
                number, _, *usual = struct.unpack_from(">5I", data, a + 4)
                defaults[number] = tuple(usual)
            elif kind == b"moof":
                # its header has 8 bytes, or 16 with a long size
                tables, moof = None, a - (8 if data[a - 4 : a] == kind else 16)
            elif kind == b"traf":
                fragments.append({"moof": moof, "head": None, "runs": []})
            elif kind in (b"tfhd", b"trun"):
                if not fragments:
                    raise Broken(f"box {kind!r} outside a fragment")
                if kind == b"tfhd":
                    fragments[-1]["head"] = a
                else:
                    fragments[-1]["runs"].append(a)
            elif tables is not None:
                tables.setdefault(kind, (a, b))
        for t in found:
            offsets, sizes, sync, ticks = samples(data, t)
            if n := len(sizes):
                if int((offsets + sizes).max()) > len(data):
                    raise Broken("a sample lies beyond the file")
            track = {"handler": None, "codec": None, "width": 0, "height": 0, "timescale": None, "ticks": ticks, "n_samples": n}
            if b"hdlr" in t:
                track["handler"] = bytes(data[t[b"hdlr"][0] + 8 : t[b"hdlr"][0] + 12]).decode("latin-1")
            if b"stsd" in t:
                at = t[b"stsd"][0] + 8
                track["codec"] = bytes(data[at + 4 : at + 8]).decode("latin-1")
                if track["handler"] == "vide":
                    track["width"], track["height"] = struct.unpack_from(">HH", data, at + 32)
            if b"mdhd" in t:
                at = t[b"mdhd"][0]
                track["timescale"] = struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]
            if b"tkhd" in t:
                at = t[b"tkhd"][0]
                by_number[struct.unpack_from(">I", data, at + (20 if data[at] else 12))[0]] = track
            track["parts"] = [(offsets, sizes, np.stack([offsets[sync], offsets[sync] + sizes[sync]], 1))]
            out["tracks"].append(track)
        _add_fragments(data, fragments, by_number, defaults)
    except (Broken, struct.error, IndexError, OverflowError, MemoryError) as e:
        out["error"] = str(e) or type(e).__name__
    for track in out["tracks"]:
        track["offsets"], track["sizes"], track["keyframes"] = map(np.concatenate, zip(*track.pop("parts"), strict=True))
    return out


def payload_of(data, track: dict) -> bytes:
    """The samples' bytes in order, whatever chunks they lie in."""
    return b"".join(data[a : a + n] for a, n in zip(track["offsets"].tolist(), track["sizes"].tolist(), strict=True))


def feature(found: dict) -> str:
    """Codec, size, duration and keyframe ranges of every track, as one line."""
    parts = []
    for t in found["tracks"]:
        keys = ",".join(f"{a}-{b}" for a, b in t["keyframes"].tolist())
        seconds = t["ticks"] / t["timescale"] if t["timescale"] else 0.0
        parts.append(f"{t['handler']}/{(t['codec'] or '').strip()} {t['width']}x{t['height']} {seconds:.3f}s {t['n_samples']} samples keys {keys}")
    return "; ".join(parts) + (f" error {found['error']}" if found["error"] else "")


#: Texts that a worker wraps or reads at a time.
SLICE = 256


def _slices(batches):
    for b in batches:
        for low in range(0, b.num_rows, SLICE):
            yield b.slice(low, SLICE)


def _store(batches):
    for b in _slices(batches):
        texts = [t or b"" for t in b.column("text").cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([wrap(pad(t)) for t in texts], pa.binary())],
            ["doc_id", "n_bytes", "media"],
        )


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each text as an ISO file. A partition is worked on batch by batch."""
    flat = docs.select("doc_id", F.col("text").cast("string"))
    return flat.mapInArrow(_store, f"doc_id {flat.schema['doc_id'].dataType.simpleString()}, n_bytes long, media binary")


TRACKS = (
    "brand string, error string, tracks array<struct<handler:string,codec:string,width:int,height:int,timescale:bigint,"
    "ticks:bigint,n_samples:bigint,keyframes:array<struct<start:bigint,end:bigint>>>>"
)


def media_columns(df: DataFrame, column: str = "media") -> DataFrame:
    """df with brand, error and tracks of the ISO files in `column`, which is dropped. Null files have an error."""
    kept = [f for f in df.schema.fields if f.name != column]
    keyframe = pa.struct([("start", pa.int64()), ("end", pa.int64())])
    track = pa.struct(
        [("handler", pa.string()), ("codec", pa.string()), ("width", pa.int32()), ("height", pa.int32()), ("timescale", pa.int64()), ("ticks", pa.int64()), ("n_samples", pa.int64()), ("keyframes", pa.list_(keyframe))]
    )

    def run(batches):
        for b in batches:
            rows = [walk(m) if m is not None else {"brand": None, "error": "null", "tracks": []} for m in b.column(column).to_pylist()]
            tracks = [
                [{k: t[k] for k in ("handler", "codec", "width", "height", "timescale", "ticks", "n_samples")} | {"keyframes": [{"start": x, "end": y} for x, y in t["keyframes"].tolist()]} for t in r["tracks"]]
                for r in rows
            ]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(f.name) for f in kept), pa.array([r["brand"] for r in rows], pa.string()), pa.array([r["error"] for r in rows], pa.string()), pa.array(tracks, pa.list_(track))],
                [*(f.name for f in kept), "brand", "error", "tracks"],
            )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return df.mapInArrow(run, f"{schema}, {TRACKS}" if schema else TRACKS)


def _read(batches):
    for b in _slices(batches):
        rows = []
        for m in b.column("media").to_pylist():
            found = walk(m)
            body = payload_of(m, found["tracks"][0]) if found["tracks"] else b""
            rows.append((len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-LINE:]), len(m), hashlib.sha256(m).hexdigest(), feature(found), len(found["tracks"][0]["keyframes"]) if found["tracks"] else 0))
        cols = list(zip(*rows, strict=True)) or [()] * 7
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays(
            [b.column("doc_id"), b.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
            ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_keyframes"],
        )


def op4(docs: DataFrame) -> DataFrame:
    stored = store(docs)
    kind = stored.schema["doc_id"].dataType.simpleString()
    return stored.mapInArrow(
        _read,
        f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_keyframes long",
    )
