"""Caps that bound what a document may cost. Names and defaults are fixed values of the engine's contract."""

from __future__ import annotations

# Fixed values.
DEFAULTS = {
    "maxInputBytes": 134217728, "maxObjects": 200000, "maxObjectStreams": 4096, "maxObjectsPerObjectStream": 10000, "maxPages": 10000,
    "maxPageDepth": 64, "maxPageKids": 8192, "maxPageDimensionPx": 16384, "maxPagePixels": 16000000, "maxTransparencyPixels": 4000000,
    "maxActiveTransparencyPixels": 12000000, "maxCachedContentBytes": 16777216, "maxCachedImagePixels": 4000000, "maxContentStreamBytes": 67108864,
    "maxContentTokens": 1000000, "maxContentOperators": 250000, "maxOperands": 4096, "maxGraphicsStackDepth": 256, "maxFormXObjectDepth": 12,
    "maxDecodedStreamBytes": 134217728, "maxDecodedDocumentBytes": 268435456, "maxImageDimension": 8192, "maxImagePixels": 40000000,
    "maxFontBytes": 33554432, "maxCMapEntries": 65536, "maxIndexedPaletteEntries": 4096, "maxAuditNodes": 200000,
}


class PdfError(ValueError):
    """What makes a document, page or stream unusable. Stages turn it into an error column."""


def merged(overrides: dict | None = None) -> dict[str, float]:
    """The defaults with known, finite, positive overrides; anything else is left out."""
    limits = dict(DEFAULTS)
    for name, value in (overrides or {}).items():
        try:
            n = float(value)
        except (TypeError, ValueError):
            continue
        if name in limits and 0 < n < float("inf"):
            limits[name] = int(n) if n == int(n) else n
    return limits


def check(name: str, value: float, most: float) -> None:
    if value > most:
        raise PdfError(f"PDF limit exceeded: {name} {value} > {most}")
