"""Cramér-Rao bounds against one inverted matrix for each function."""

from __future__ import annotations

import numpy as np

from glintloom.operators import bounds


def gaussian(z):
    y, x = np.mgrid[:15, :15] - 7.0
    sx, sy = 1.3 + 0.4 * z, 1.3 - 0.4 * z
    g = np.exp(-x * x / (2 * sx * sx) - y * y / (2 * sy * sy))
    return g, -x / sx**2 * g, -y / sy**2 * g, g * (0.4 * x * x / sx**3 - 0.4 * y * y / sy**3)


def test_bounds_equal_the_inverse_of_the_fisher_matrix(spark):
    planes = {0: gaussian(0.0), 1: gaussian(0.5)}
    rows = [(k, *map(float, v)) for k, p in planes.items() for v in zip(*[a.ravel() for a in p], strict=True)]
    rows += [(2, 1.0, 0.0, 0.0, 0.0)] * 4  # no slopes, no bounds
    psf = spark.createDataFrame(rows, "plane int, psf double, dx double, dy double, dz double")
    got = {r.plane: r for r in bounds.cramer_rao(psf, 800.0, 3.0, ["plane"], 160.0, 50.0, 0.9).collect()}
    for k, (g, dx, dy, dz) in planes.items():
        n = 0.9 / g.sum()
        slopes = [g * n, -dx * n * 800 / 160, -dy * n * 800 / 160, dz * n * 800 / 50, np.ones_like(g)]
        w = 1 / (g * n * 800 + 3)
        f = np.array([[(w * a * b).sum() for b in slopes] for a in slopes])
        assert np.allclose([got[k][p] for p in bounds.PARAMETERS], np.diag(np.linalg.inv(f)), rtol=1e-9)
    # at the focus an astigmatic function is round: x and y are known equally well
    assert abs(got[0].x / got[0].y - 1) < 1e-9 and got[1].x > got[0].x
    assert [got[2][p] for p in bounds.PARAMETERS] == [None] * 5
    assert bounds.cramer_rao(psf.limit(0), 800.0, 3.0, ["plane"]).count() == 0
