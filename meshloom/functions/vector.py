"""Vectors as columns: structs (x, y, z), all inside code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Vec:
    """Three columns with the usual algebra."""

    def __init__(self, x: Column, y: Column, z: Column):
        self.x, self.y, self.z = x, y, z

    @staticmethod
    def of(point: Column) -> Vec:
        return Vec(point["x"], point["y"], point["z"])

    def __add__(self, o: Vec) -> Vec:
        return Vec(self.x + o.x, self.y + o.y, self.z + o.z)

    def __sub__(self, o: Vec) -> Vec:
        return Vec(self.x - o.x, self.y - o.y, self.z - o.z)

    def scale(self, k: Column | float) -> Vec:
        return Vec(self.x * k, self.y * k, self.z * k)

    def dot(self, o: Vec) -> Column:
        return self.x * o.x + self.y * o.y + self.z * o.z

    def cross(self, o: Vec) -> Vec:
        return Vec(self.y * o.z - self.z * o.y, self.z * o.x - self.x * o.z, self.x * o.y - self.y * o.x)

    def norm(self) -> Column:
        return F.sqrt(self.dot(self))

    def unit(self) -> Vec:
        n = F.nullif(self.norm(), F.lit(0.0))
        return Vec(self.x / n, self.y / n, self.z / n)

    def struct(self) -> Column:
        return F.struct(self.x.alias("x"), self.y.alias("y"), self.z.alias("z"))


def det(a: Vec, b: Vec, c: Vec) -> Column:
    return a.cross(b).dot(c)


def points(names: list[str]) -> list[Vec]:
    return [Vec.of(F.col(n)) for n in names]


def from_lon_lat(lon: Column, lat: Column, radius: float = 1.0) -> Vec:
    """Angles in radians to a point on the sphere."""
    return Vec(F.cos(lat) * F.cos(lon) * radius, F.cos(lat) * F.sin(lon) * radius, F.sin(lat) * radius)


def arc(a: Vec, b: Vec) -> Column:
    """The angle between two directions."""
    return F.atan2(a.cross(b).norm(), a.dot(b))


def spherical_triangle(a: Vec, b: Vec, c: Vec) -> Column:
    """Signed area on the unit sphere by l'Huilier's rule, from unit vectors."""
    x, y, z = arc(b, c), arc(c, a), arc(a, b)
    s = (x + y + z) / 2
    inner = F.tan(s / 2) * F.tan((s - x) / 2) * F.tan((s - y) / 2) * F.tan((s - z) / 2)
    return F.when(det(a, b, c) < 0, -1.0).otherwise(1.0) * 4 * F.atan(F.sqrt(F.greatest(inner, F.lit(0.0))))
