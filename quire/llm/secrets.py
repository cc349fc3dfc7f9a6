r"""Secret scans with multipart credential linking.

Base spans are strong by themselves:

- assign: a keyword, `:` or `=`, and a value of 8 or more characters
- access: AKIA and capitals or digits, 16 or more characters
- hex: 32 or more of 0-9a-f

They are found leftmost and non-overlapping for each kind. Three more kinds
are weak candidates, worth nothing alone:

- ident: a user, login, account or client identifier; its name may have a prefix, as in DB_USER
- value: a token of 20 or more characters of mixed classes and high entropy
- endpoint: a URL or host:port

Candidates are joined by interval: two parts complement each other when at
most SCOPE code points lie between them within one paragraph. A weak secret is
reported only with an identifier in scope, a weak identifier only with a
secret, an endpoint only with both, and of two weak parts only with an
endpoint as well. Every part is decided by range probes in sorted lists:
whether any complement of each needed kind lies in its scope, which for three
weak parts means an identifier and an endpoint around one secret. So a text
full of parts costs n log n, and no pairs are listed.

Defined results: null text is empty and has no spans; offsets are code points,
end exclusive; repeated rows give equal results; other columns are ignored by
`scan` and kept by `redact`.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "ident", "value", "endpoint")
BASE = KINDS[:3]
SCOPE = 200

_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
# The same matches as AKIA[A-Z0-9]+ and [0-9a-f]+ with the short ones dropped: a run is taken whole either way.
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")
_IDENT = re.compile(
    r"""(?<![A-Za-z0-9])(?:user(?:name)?|login|account|client_?id|access_?key_?id)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{3,})""", re.ASCII | re.IGNORECASE
)
# A value may follow `=`, as in NAME=value; a token that is followed by more of itself never matches.
# Runs are begun once and never given back, so every pattern takes time in proportion to the text.
_VALUE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}+={0,2}+(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"https?://[^\s\"'<>]++|(?<![A-Za-z0-9_.-])[a-z0-9-]++(?:\.[a-z0-9-]++)++:[0-9]{2,5}(?![A-Za-z0-9_])")
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_IDENT_WORDS = (b"user", b"login", b"account", b"client", b"access")
_HEX_TABLE = bytes(ord("h") if chr(i) in "0123456789abcdef" else 0 for i in range(256))


def entropy(s: str) -> float:
    return -sum(c / len(s) * math.log2(c / len(s)) for c in Counter(s).values())


def _mixed(s: str) -> bool:
    classes = bool(re.search("[a-z]", s)) + bool(re.search("[A-Z]", s)) + bool(re.search("[0-9]", s))
    return classes >= 3 and entropy(s) >= 3.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Cheap searches of the bytes come first: most texts hold none of what a pattern needs."""
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    found: list[tuple[str, int, int]] = []
    if any(k in low for k in _KEYWORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    if b"AKIA" in raw:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text)]
    if b"h" * 32 in raw.translate(_HEX_TABLE):
        found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


def weak_spans(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates that overlap no strong span, nor one another."""
    found: list[tuple[str, int, int]] = []
    taken = sorted((a, b) for _, a, b in strong)
    for kind, pattern in (("ident", _IDENT), ("endpoint", _ENDPOINT), ("value", _VALUE)):
        new = []
        starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
        for m in pattern.finditer(text):
            i = bisect_left(starts, m.end())
            if i and reach[i - 1] > m.start():
                continue
            if kind != "value" or _mixed(m[0]):
                new.append((kind, *m.span()))
        found += new
        taken = sorted(taken + [(a, b) for _, a, b in new])
    return found


class _Parts:
    """Spans of one kind by paragraph and start; the longest end so far serves probes to the left."""

    def __init__(self, spans: list[tuple[str, int, int]], paragraphs: list[int]):
        self.at: dict[int, tuple[list[int], list[int], list[tuple[str, int, int]]]] = {}
        for s in sorted(spans, key=lambda s: (s[1], s[2])):
            starts, ends, parts = self.at.setdefault(bisect_right(paragraphs, s[1]), ([], [], []))
            starts.append(s[1])
            ends.append(max(s[2], ends[-1]) if ends else s[2])
            parts.append(s)

    def near(self, paragraph: int, a: int, b: int, scope: int) -> tuple[str, int, int] | None:
        """The nearest span to [a, b) in scope and paragraph, None if there is none; of two as near, the earlier."""
        if paragraph not in self.at:
            return None
        starts, ends, parts = self.at[paragraph]
        i = bisect_left(starts, a)
        best = None
        if i:
            # the first span that reaches as far right as any before a
            left = parts[bisect_left(ends, ends[i - 1])]
            best = (max(a - left[2], 0), left)
        if i < len(starts):
            gap = max(starts[i] - b, 0)
            if best is None or gap < best[0]:
                best = (gap, parts[i])
        return best[1] if best[0] <= scope else None


def _linked(text: str, strong: list[tuple[str, int, int]], scope: int) -> tuple[set[tuple[str, int, int]], list[dict]]:
    """(all parts of credentials, and each linked secret with an identifier and endpoint that link it)."""
    if not any(k == "access" for k, _, _ in strong):
        low = text.encode("utf-8", "surrogatepass").lower()
        if not any(k in low for k in _IDENT_WORDS) or not _IDENT.search(text):
            return set(), []  # no identifier, so nothing to link
    every = strong + weak_spans(text, strong)
    paragraphs = [m.start() for m in re.finditer(r"\n[\t ]*\n", text)]
    made: dict[str, _Parts] = {}

    def near(part, spans: list[tuple[str, int, int]], name: str):
        if name not in made:
            made[name] = _Parts(spans, paragraphs)
        return made[name].near(bisect_right(paragraphs, part[1]), part[1], part[2], scope)

    by_kind = {k: [s for s in every if s[0] == k] for k in KINDS}
    sure = by_kind["assign"] + by_kind["hex"]
    ends, idents, access = by_kind["endpoint"], by_kind["ident"], by_kind["access"]
    found, openly = [], []
    for s in sorted(sure + by_kind["value"], key=lambda s: (s[1], s[2])):
        end = near(s, ends, "endpoint")
        # a weak secret without endpoint needs a strong identifier
        ident = near(s, access + idents, "id") if s[0] != "value" or end else near(s, access, "access")
        if not ident:
            continue
        found.append({"secret": s, "ident": ident, "endpoint": end})
        if s[0] != "value" or end:
            openly.append(s)  # a weak identifier in scope of it has all it needs
    linked = {c["secret"] for c in found}
    linked |= {s for s in idents if near(s, openly, "openly")}
    secrets = [c["secret"] for c in found]
    linked |= {s for s in ends if near(s, secrets, "secret")}
    return linked, found


def link(text: str, strong: list[tuple[str, int, int]], scope: int = SCOPE) -> list[dict]:
    """Credentials: each linked secret with its nearest identifier and endpoint, where enough parts co-occur."""
    return _linked(text, strong, scope)[1]


def spans_of(text: str | None, scope: int = SCOPE) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by start, then kind as listed."""
    text = text or ""
    order = lambda s: (s[1], KINDS.index(s[0]), s[2])
    base = sorted(base_spans(text), key=order)
    linked = {p for p in _linked(text, base, scope)[0] if p[0] not in BASE}
    return base, sorted([*base, *linked], key=order)


def _said(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _scan(scope: int):
    def run(batches):
        for b in batches:
            rows = [spans_of(t, scope) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("doc_id"),
                    *(pa.array([sum(s[0] == k for s in base) for base, _ in rows], pa.int64()) for k in BASE),
                    pa.array([hashlib.sha256(_said(base).encode()).hexdigest() for base, _ in rows]),
                    pa.array([_said(every) for _, every in rows]),
                    pa.array([sum(k not in BASE for k, _, _ in every) for _, every in rows], pa.int64()),
                ],
                ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_linked"],
            )

    return run


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_linked. No shuffle."""
    flat = docs.select("doc_id", F.col("text").cast("string"))
    kind = flat.schema["doc_id"].dataType.simpleString()
    return flat.mapInArrow(
        _scan(scope), f"doc_id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long"
    )


def credentials(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each linked credential: doc_id and the parts' kinds and offsets."""
    part = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches):
        for b in batches:
            rows = [
                (d, c)
                for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                for c in link(t or "", sorted(base_spans(t or "")), scope)
            ]
            cols = [
                pa.array([c[k] and dict(zip(("kind", "start", "end"), c[k], strict=True)) for _, c in rows], part)
                for k in ("ident", "secret", "endpoint")
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array([d for d, _ in rows], b.schema.field("doc_id").type), *cols], ["doc_id", "ident", "secret", "endpoint"]
            )

    flat = docs.select("doc_id", F.col("text").cast("string"))
    kind = flat.schema["doc_id"].dataType.simpleString()
    one = "struct<kind:string,start:bigint,end:bigint>"
    return flat.mapInArrow(run, f"doc_id {kind}, ident {one}, secret {one}, endpoint {one}")


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """text with every span of a secret or access identifier replaced by its kind in brackets; overlaps merge."""
    out, at = [], 0
    for kind, a, b in sorted((s for s in spans if s[0] != "endpoint"), key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """docs with secrets in `text` replaced; every row and column stays."""

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            new = [t if t is None or not (s := spans_of(t, scope)[1]) else redacted(t, s) for t in texts]
            yield b.set_column(b.schema.get_field_index("text"), "text", pa.array(new, pa.string()))

    return docs.mapInArrow(run, docs.schema)


def op6(docs: DataFrame) -> DataFrame:
    return scan(docs)
