"""Geometry on points given as struct<x, y, z> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONTACT = 8.0


def point(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), z.cast("double").alias("z"))


def minus(a: Column, b: Column) -> Column:
    return point(a["x"] - b["x"], a["y"] - b["y"], a["z"] - b["z"])


def dot(a: Column, b: Column) -> Column:
    return a["x"] * b["x"] + a["y"] * b["y"] + a["z"] * b["z"]


def cross(a: Column, b: Column) -> Column:
    return point(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def distance(a: Column, b: Column) -> Column:
    d = minus(a, b)
    return F.sqrt(dot(d, d))


def exp_distance(d: Column) -> Column:
    return F.exp(-((d - 3.6) * (d - 3.6)) / 12)


def angle(a: Column, b: Column) -> Column:
    """Between two vectors; NaN if either is zero."""
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b) / F.when(size > 0, size)))
    return F.when(size > 0, F.acos(cosine)).otherwise(F.lit(float("nan")))


def unit(v: Column) -> Column:
    """v over its length; NaN for a zero vector."""
    size = F.sqrt(dot(v, v))
    part = lambda c: F.when(size > 0, v[c] / F.when(size > 0, size)).otherwise(F.lit(float("nan")))
    return point(part("x"), part("y"), part("z"))


def angle_of_units(a: Column, b: Column) -> Column:
    """Between two vectors of length 1."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


def angle_at(p1: Column, p2: Column, p3: Column) -> Column:
    return angle(minus(p1, p2), minus(p3, p2))


def angle_of_segments(p1: Column, p2: Column, q1: Column, q2: Column) -> Column:
    return angle(minus(p2, p1), minus(q2, q1))


def normal(p1: Column, p2: Column, p3: Column) -> Column:
    return cross(minus(p2, p1), minus(p3, p1))


def angle_of_planes(p: tuple[Column, Column, Column], q: tuple[Column, Column, Column]) -> Column:
    return angle(normal(*p), normal(*q))
