"""Column functions over localizations: coordinates, widths, z, colour and noise."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def to_nm(pixels: Column, pixel_size: float) -> Column:
    return pixels * pixel_size


def offset_scale(value: Column, offset: float, scale: float) -> Column:
    return (value + offset) * scale


def grid_index(value: Column, scale: float = 1.0) -> Column:
    """The cell of a coordinate: floor, also below zero."""
    return F.floor(value * scale).cast("int")


def render_index(value: Column, scale: float = 1.0) -> Column:
    """The pixel of a coordinate: rounded, halves to even."""
    return F.bround(value * scale).cast("int")


def affine(x: Column, y: Column, c: tuple[float, float, float]) -> Column:
    """c0 + cx * x + cy * y."""
    return F.lit(c[0]) + c[1] * x + c[2] * y


def margin_corrected(c: tuple[float, float, float], margin: float) -> tuple[float, float, float]:
    """A mapping for images with a margin."""
    return (c[0] + margin - (c[1] + c[2]) * margin, c[1], c[2])


def descriptor_category(frame: Column, descriptor: str) -> Column:
    """The digit of the descriptor for this frame, less one; activation frames get -1."""
    return F.substring(F.lit(descriptor), F.pmod(frame, F.lit(len(descriptor))) + 1, F.lit(1)).cast("int") - 1


def z_checked(category: Column, z: Column, z_min: float, z_max: float) -> Column:
    """Category 9 where z is out of range."""
    return F.when((z < z_min) | (z > z_max), F.lit(9)).otherwise(category)


def defocus_width(z: Column, w0: float, c: float, d: float, *terms: float) -> Column:
    """w0 * sqrt(1 + u^2 + A u^3 + B u^4 + ...), u = (z - c) / d."""
    u = (z - c) / d
    inner = F.lit(1.0) + u * u
    for k, a in enumerate(terms, 3):
        inner = inner + a * F.pow(u, F.lit(float(k)))
    return w0 * F.sqrt(inner)


def _curve(z: np.ndarray, p: list[float]) -> np.ndarray:
    u = (z - p[1]) / p[2]
    inner = 1 + u * u
    for k, a in enumerate(p[3:], 3):
        inner = inner + a * u**k
    return np.sqrt(p[0] * np.sqrt(inner))


def z_grid(wx: list[float], wy: list[float], z_min: float, z_max: float, step: float) -> Column:
    """The calibration curves as an array literal of (z, root of width x, root of width y)."""
    z = z_min + step * np.arange(int((z_max - z_min) / step + 1e-9) + 1)
    rows = zip(z.tolist(), _curve(z, wx).tolist(), _curve(z, wy).tolist(), strict=True)
    return F.array(*[F.struct(F.lit(a).alias("z"), F.lit(b).alias("x"), F.lit(c).alias("y")) for a, b, c in rows])


def best_z(width_x: Column, width_y: Column, grid: Column, cutoff: float, z_min: float, step: float = 1.0) -> Column:
    """z of the grid point nearest to the roots of both widths; z_min - step if the squared distance is over cutoff. First of equals."""
    d = F.transform(grid, lambda g: F.struct((F.pow(F.sqrt(width_x) - g["x"], 2) + F.pow(F.sqrt(width_y) - g["y"], 2)).alias("d"), g["z"].alias("z")))
    best = F.array_min(d)
    return F.when(best["d"] > cutoff, F.lit(z_min - step)).otherwise(best["z"])


def curve_distance(width_x: Column, width_y: Column, grid: Column) -> Column:
    """Least squared distance of the roots of both widths from the curves."""
    return F.array_min(F.transform(grid, lambda g: F.pow(F.sqrt(width_x) - g["x"], 2) + F.pow(F.sqrt(width_y) - g["y"], 2)))


def tilt_compensated(x: Column, y: Column, z: Column, t: tuple[float, float, float]) -> Column:
    return z + t[0] + t[1] * x + t[2] * y


def colour_moment(*heights: Column) -> tuple[Column, Column]:
    """First moment of the heights over channels, and their sum; 0 where the sum is 0."""
    total = sum(heights[1:], heights[0])
    moment = sum((k * h for k, h in enumerate(heights)), F.lit(0.0))
    return F.when(total == 0, F.lit(0.0)).otherwise(moment / total), total


def significance(fg_sum: Column, bg_sum: Column) -> Column:
    return fg_sum / F.sqrt(bg_sum)


def insight3_shape(xsigma: Column, ysigma: Column, pixel_size: float) -> tuple[Column, Column]:
    """Width in nm and aspect ratio as the binary molecule list has them."""
    wx, wy = 2 * xsigma * pixel_size, 2 * ysigma * pixel_size
    return F.sqrt(wx * wy), wy / wx


def anscombe(value: Column) -> Column:
    return 2 * F.sqrt(F.greatest(value, F.lit(0.0)) + 0.375)


def mortensen_bound(photons: Column, background: Column, pixel_size: float, psf_sigma: float, emccd: bool = False, points: int = 64) -> Column:
    """Localization error bound in nm; the integral over 0 .. 1 is a Gauss-Legendre sum."""
    sa2 = psf_sigma**2 + pixel_size**2 / 12
    nodes, weights = np.polynomial.legendre.leggauss(points)
    t, w = (nodes + 1) / 2, weights / 2
    rate = photons * pixel_size**2 / (2 * math.pi * sa2 * background)
    integral = sum((float(b) * math.log(a) / (1 + float(a) * rate) for a, b in zip(t, w, strict=True)), F.lit(0.0))
    bound = F.sqrt(sa2 / photons * (1 / (1 + integral)))
    return math.sqrt(2) * bound if emccd else bound


def z_bin(z: Column, z_min: float, z_max: float, bins: int) -> Column:
    """Bin of z between z_min and z_max, else -1."""
    index = F.floor((z - z_min) / ((z_max - z_min) / bins)).cast("int")
    return F.when((z > z_min) & (z < z_max), index).otherwise(-1)


def time_bin(frame: Column, step: int, length: int) -> Column:
    """Bin of a frame; the last bin takes in a tail of less than a step."""
    bins = max(length // step, 1)
    return F.least(F.floor(frame / step), F.lit(bins - 1)).cast("int")


def track_mean(total: Column, length: Column) -> Column:
    """The mean of a field that tracks hold as a sum; null for an empty track."""
    return F.when(length > 0, total / length)


def rounded_mean(value: Column, digits: int) -> Column:
    """The mean of a group's values, rounded half up, as an aggregate: from their exact sum, whatever order rows come in, where each has at most eight decimals and ten digits before them; else from the sum of doubles."""
    fixed = value.try_cast("decimal(18,8)")
    exact = F.bool_and(value.isNull() | F.coalesce(fixed.cast("double") == value, F.lit(False)))
    n = F.count("*")
    mean = track_mean(F.sum(fixed).cast("decimal(27,8)"), n.cast("decimal(10,0)"))
    return F.when(exact, F.round(mean, digits).cast("double")).otherwise(F.round(track_mean(F.sum(value), n), digits))


def scaled_z(z: Column, z_min: float, z_max: float, size: int) -> Column:
    """z in the units of a spline of this many intervals between z_min and z_max, all in nm."""
    return F.lit(float(size)) * (z - z_min) / (z_max - z_min)


def rescaled_z(z: Column, z_min: float, z_max: float, size: int) -> Column:
    """The way back from spline units, to micrometres."""
    return F.lit(1.0e-3) * (z * (z_max - z_min) / size + z_min)


def track_cell(x: Column, y: Column, z: Column, scale: float, z_min: float, z_max: float, z_bins: int) -> tuple[Column, Column, Column]:
    """The cell of a track in a 3-D grid: x and y rounded down, z cut towards zero, so that the first bin takes in what lies up to one bin below it."""
    return F.floor(x * scale).cast("int"), F.floor(y * scale).cast("int"), ((z - z_min) * (z_bins / (z_max - z_min))).cast("int")
