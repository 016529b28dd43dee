"""Cramér-Rao bounds of a measured point-spread function: how well a fit can know brightness, place and background.

The Fisher matrix is fifteen sums over the pixels of each function, made by Spark for
all functions (planes, microscopes) at once; each matrix is then inverted by itself.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PARAMETERS = ("photons", "x", "y", "z", "background")
_CELLS = [(i, j) for i in range(5) for j in range(i, 5)]


def fisher_sums(psf: DataFrame, photons: float, background: float, keys: list[str], delta_xy: float = 1.0, delta_z: float = 1.0, normalization: float = 1.0) -> DataFrame:
    """(keys, f00 .. f44): the upper half of the Fisher matrix of each function.

    psf has a row for each pixel: the keys, psf, and its derivatives dx, dy and dz in
    steps of delta_xy and delta_z (nm). The function is scaled to the sum `normalization`.
    """
    totals = psf.groupBy(*keys).agg(F.sum("psf").alias("__total"))
    scale = normalization / F.col("__total")
    bright = F.col("psf") * scale
    slopes = [bright, -F.col("dx") * scale * photons / delta_xy, -F.col("dy") * scale * photons / delta_xy, F.col("dz") * scale * photons / delta_z, F.lit(1.0)]
    each = psf.join(totals, keys).select(*keys, (1 / (bright * photons + background)).alias("w"), *[s.alias(f"d{k}") for k, s in enumerate(slopes)])
    return each.groupBy(*keys).agg(*[F.sum(F.col("w") * F.col(f"d{i}") * F.col(f"d{j}")).alias(f"f{i}{j}") for i, j in _CELLS])


def variances(sums: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, photons, x, y, z, background): least variance of each parameter, in squares of nm for places; null where the matrix has no inverse."""
    schema = ", ".join([*[f"{k} {sums.schema[k].dataType.simpleString()}" for k in keys], *[f"{p} double" for p in PARAMETERS]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            m = np.zeros((len(batch), 5, 5))
            for i, j in _CELLS:
                m[:, i, j] = m[:, j, i] = batch[f"f{i}{j}"].to_numpy(float)
            out = np.full((len(batch), 5), np.nan)
            for k, f in enumerate(m):
                size = np.sqrt(np.diag(f))
                if np.all(np.isfinite(f)) and np.all(size > 0):
                    # scaled to a unit diagonal, so that the units of the parameters do not matter
                    unit = f / np.outer(size, size)
                    if np.linalg.cond(unit) < 1e14:
                        out[k] = np.diag(np.linalg.inv(unit)) / size**2
            found = batch[keys].copy()
            for k, p in enumerate(PARAMETERS):
                found[p] = pd.array(np.where(np.isnan(out[:, k]), None, out[:, k]), dtype="Float64")
            yield found

    return sums.mapInPandas(run, schema)


def cramer_rao(psf: DataFrame, photons: float, background: float, keys: list[str], delta_xy: float = 1.0, delta_z: float = 1.0, normalization: float = 1.0) -> DataFrame:
    """Bounds of each function, see fisher_sums and variances."""
    return variances(fisher_sums(psf, photons, background, keys, delta_xy, delta_z, normalization), keys)
