"""How two rasters differ, pixel by pixel: NumPy over pairs of RGBA binaries in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

# A change above the first counts, above the second it is substantial; weights of luminance.
CHANGED, SUBSTANTIAL = 2, 20
LUMINANCE = np.array([0.2126, 0.7152, 0.0722])
NAMES = ("changed", "substantial", "total", "red", "green", "mean", "max")


def difference(first: bytes, second: bytes) -> tuple[int, int, int, int, int, float, int]:
    """Counts over pixels of two RGBA rasters of one size; red where the first is not darker, green where it is."""
    a, b = (np.frombuffer(x, np.uint8)[: len(x) // 4 * 4].reshape(-1, 4)[:, :3].astype(np.int64) for x in (first, second))
    n = max(len(a), len(b))
    a, b = (np.concatenate((x, np.zeros((n - len(x), 3), np.int64))) for x in (a, b))
    size = np.abs(a - b).max(axis=1) if n else np.zeros(0, np.int64)
    hit = size > CHANGED
    lighter = (a @ LUMINANCE - b @ LUMINANCE)[hit] >= 0
    changed = int(hit.sum())
    return changed, int((size > SUBSTANTIAL).sum()), n, int(lighter.sum()), int((~lighter).sum()), float(size[hit].mean()) if changed else 0.0, int(size[hit].max()) if changed else 0


def differences(pairs: DataFrame, first: str = "first", second: str = "second") -> DataFrame:
    """pairs with the metrics in place of the two rasters; null rasters are empty."""
    kept = [f for f in pairs.schema.fields if f.name not in (first, second)]

    def run(batches):
        for b in batches:
            rows = [difference(x or b"", y or b"") for x, y in zip(b.column(first).to_pylist(), b.column(second).to_pylist(), strict=True)]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64()] * 5 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], [*(f.name for f in kept), *NAMES])

    schema = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept)
    return pairs.mapInArrow(run, schema + "changed long, substantial long, total long, red long, green long, mean double, max long")
