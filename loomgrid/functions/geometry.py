"""Column functions for bearings, the isometric view and map projection."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

CELL_W, CELL_H = 2.0, 1.0
STOREY_M = 3.2


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, in [0, 360)."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def rotated(bearing_deg: Column, rotation) -> Column:
    """The bearing as the rotated camera sees it."""
    return F.pmod(bearing_deg - rotation, F.lit(360.0))


def offset_from_clean(bearing_deg: Column, rotation) -> Column:
    """Distance in degrees to the nearest multiple of 45."""
    fold = F.pmod(rotated(bearing_deg, rotation), F.lit(45.0))
    return F.least(fold, 45.0 - fold)


def snapped(bearing_deg: Column, rotation) -> Column:
    """The bearing nearest to this one that the rotated camera sees as a multiple of 45; halves go to the even multiple."""
    return F.pmod(F.rint(rotated(bearing_deg, rotation) / 45.0) * 45.0 + rotation, F.lit(360.0))


def snap_direction(dx: Column, dy: Column, rotation) -> tuple[Column, Column]:
    """Unit vector, in the map's frame, of the clean direction nearest to (dx, dy)."""
    angle = F.radians(snapped(bearing(dx, dy), rotation))
    return F.sin(angle), F.cos(angle)


def segment_foot(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> tuple[Column, Column]:
    """The point of a segment nearest to (px, py)."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    t = F.when(long > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - ax) * dx + (py - ay) * dy) / long))).otherwise(0.0)
    return ax + t * dx, ay + t * dy


class Camera:
    """An isometric camera; numbers are folded into the plan as literals."""

    def __init__(self, origin=(0.0, 0.0), rotation_deg=0.0, cell_m=1.0, width_px=1000, height_px=1000, storey_px=6.4, shift=(0.0, 0.0)):
        self.ox, self.oy = origin
        self.rotation_deg, self.cell_m, self.storey_px = rotation_deg, cell_m, storey_px
        self.width_px, self.height_px, self.shift = width_px, height_px, shift
        self.cos, self.sin = math.cos(math.radians(rotation_deg)), math.sin(math.radians(rotation_deg))

    def _uv(self, x: Column, y: Column) -> tuple[Column, Column]:
        dx, dy = x - self.ox, y - self.oy
        return (dx * self.cos - dy * self.sin) / self.cell_m, (dx * self.sin + dy * self.cos) / self.cell_m

    def ground(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Canvas place of a point in metres."""
        u, v = self._uv(x, y)
        return (u + v) * CELL_W + self.width_px / 2 + self.shift[0], (u - v) * CELL_H + self.height_px / 2 + self.shift[1]

    def world(self, sx: Column, sy: Column) -> tuple[Column, Column]:
        """The point under a canvas place."""
        a = (sx - self.width_px / 2 - self.shift[0]) / CELL_W
        b = (sy - self.height_px / 2 - self.shift[1]) / CELL_H
        u, v = (a + b) / 2 * self.cell_m, (a - b) / 2 * self.cell_m
        return self.ox + u * self.cos + v * self.sin, self.oy - u * self.sin + v * self.cos

    def corners(self) -> list[tuple[float, float]]:
        """The points under the canvas' corners."""
        out = []
        for sx, sy in ((0, 0), (self.width_px, 0), (self.width_px, self.height_px), (0, self.height_px)):
            a, b = (sx - self.width_px / 2 - self.shift[0]) / CELL_W, (sy - self.height_px / 2 - self.shift[1]) / CELL_H
            u, v = (a + b) / 2 * self.cell_m, (a - b) / 2 * self.cell_m
            out.append((self.ox + u * self.cos + v * self.sin, self.oy - u * self.sin + v * self.cos))
        return out

    def depth(self, x: Column, y: Column) -> Column:
        """Larger is nearer to the viewer."""
        u, v = self._uv(x, y)
        return u - v

    def lift(self, sy: Column, levels: Column) -> Column:
        return sy - levels * self.storey_px


#: The ellipsoid of WGS84's datum as the projection has it.
_A, _F = 6378137.0, 1 / 298.257222101


def _series(a: float, f: float) -> tuple[float, float, float, tuple, tuple]:
    """Rectifying radius, e, third flattening, and the forward and backward coefficients of Krueger's series to the third order."""
    n = f / (2 - f)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    return a / (1 + n) * (1 + n**2 / 4 + n**4 / 64), 2 * math.sqrt(n) / (1 + n), n, alpha, beta


def _meridian(deg: float, e: float, alpha: tuple) -> float:
    p = math.radians(deg)
    x = math.atan(math.sinh(math.atanh(math.sin(p)) - e * math.atanh(e * math.sin(p))))
    return x + sum(c * math.sin(2 * j * x) for j, c in enumerate(alpha, start=1))


def transverse_mercator(lat: Column, lon: Column, lat0: float, lon0: float, k0: float, false_e: float, false_n: float, a: float = _A, f: float = _F) -> tuple[Column, Column]:
    """WGS84 degrees to easting and northing: Krueger's series to the third order."""
    big_a, e, _, alpha, _ = _series(a, f)
    phi, lam = F.radians(lat), F.radians(lon - lon0)
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, c in enumerate(alpha, start=1):
        east = east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return false_e + k0 * big_a * east, false_n + k0 * big_a * (north - _meridian(lat0, e, alpha))


def inverse_transverse_mercator(x: Column, y: Column, lat0: float, lon0: float, k0: float, false_e: float, false_n: float, a: float = _A, f: float = _F) -> tuple[Column, Column]:
    """Easting and northing to (latitude, longitude) in degrees; five fixed-point steps take the latitude below a nanometre."""
    big_a, e, _, alpha, beta = _series(a, f)
    xi, eta = (y - false_n) / (k0 * big_a) + _meridian(lat0, e, alpha), (x - false_e) / (k0 * big_a)
    xi1, eta1 = xi, eta
    for j, c in enumerate(beta, start=1):
        xi1 = xi1 - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta1 = eta1 - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    psi = F.atanh(F.sin(chi))
    phi = chi
    for _ in range(5):
        phi = F.asin(F.tanh(psi + e * F.atanh(e * F.sin(phi))))
    return F.degrees(phi), lon0 + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1)))
