"""Two lists of tracks aligned by the correlation of their images, and joined into one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glintloom.operators.aggregate import grid_2d, grid_3d
from glintloom.operators.master_drift import Z_STEP, xy_offset, z_offset
from glintloom.operators.shared import checkpointed

#: Times that the search in x and y goes on around a higher lag than those near the expected one.
MOVES = 12


def track_offset(first: DataFrame, second: DataFrame, width: int, height: int, scale: int = 2, expected: tuple[float, float] = (0.0, 0.0), z_range: tuple[float, float] = (-0.5, 0.5)) -> tuple[float, float, float]:
    """(dx, dy, dz): what to add to the second list so that it lies on the first; pixels and microns.

    x and y come from lags near the expected offset, or where they rise to, z then from lags of the planes. z
    outside z_range is put into the end planes. Raises where no offset can be measured.
    """
    w, h = width * scale, height * scale
    bins = int((z_range[1] - z_range[0]) / Z_STEP)
    flat = [checkpointed(grid_2d(t, w, h, float(scale))) for t in (first, second)]
    dx, dy, found = xy_offset(*flat, w, h, (expected[0] * scale, expected[1] * scale), MOVES)
    if not found:
        raise ValueError("the lists cannot be aligned in x and y")
    dx, dy = dx / scale, dy / scale
    moved = second.withColumns({"x": F.col("x") + dx, "y": F.col("y") + dy})
    deep = [checkpointed(grid_3d(t, w, h, *z_range, bins, float(scale), clamp=True)) for t in (first, moved)]
    planes, found = z_offset(*deep, bins, w * h)
    if not found:
        raise ValueError("the lists cannot be aligned in z")
    return dx, dy, -planes * (z_range[1] - z_range[0]) / bins


def aligned_union(first: DataFrame, second: DataFrame, offset: tuple[float, float, float]) -> DataFrame:
    """All rows of both lists, those of the second moved by the offset; columns that only one has are null in the other."""
    moved = second.withColumns({c: F.col(c) + d for c, d in zip(("x", "y", "z"), offset, strict=True)})
    return first.unionByName(moved, allowMissingColumns=True)
