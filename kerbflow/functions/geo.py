"""Lattice and hexagon zone keys, distances, leg geometry."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from kerbflow.functions import vocabulary as V
from kerbflow.functions.basics import dbl


def lattice(value: Column, step: float) -> Column:
    return F.floor(value / dbl(step)).cast("bigint")


def cell_id(row: Column, col: Column) -> Column:
    return F.concat_ws("_", row.cast("string"), col.cast("string"))


def cell_part(cell: Column, position: int) -> Column:
    """Integer part of a packed ``row_col`` id."""
    return F.get(F.split(cell, "_"), F.lit(position)).cast("bigint")


def cell_centre(index: Column, step: float) -> Column:
    return index.cast("double") * dbl(step) + dbl(step / 2)


def zone_key(row: Column, col: Column, level: int = 9) -> Column:
    return F.concat_ws("_", F.lit(f"z{level}"), row.cast("string"), col.cast("string"))


def zone_parent(index: Column, level: int) -> Column:
    """Index at a coarser level of the index at level 9 (the levels nest)."""
    return F.floor(index.cast("double") / dbl(V.ZONE_FACTORS[level])).cast("bigint")


def zone_step(level: int) -> float:
    return V.ZONE_STEP * V.ZONE_FACTORS[level]


def hex_axial(lat: Column, lon: Column, edge_km: float, base_lat: float) -> tuple[Column, Column]:
    """Axial (q, r) of the pointy-top hexagon that holds a point on a local flat projection."""
    x = lon * dbl(111.32 * math.cos(math.radians(base_lat)))
    y = lat * dbl(110.574)
    q = (x * dbl(math.sqrt(3) / 3) - y / dbl(3.0)) / dbl(edge_km)
    r = y * dbl(2.0 / 3.0) / dbl(edge_km)
    s = -q - r
    rq, rr, rs = F.floor(q + 0.5), F.floor(r + 0.5), F.floor(s + 0.5)
    dq, dr, ds = F.abs(rq - q), F.abs(rr - r), F.abs(rs - s)
    fix_q = (dq > dr) & (dq > ds)
    fix_r = ~fix_q & (dr > ds)
    return (
        F.when(fix_q, -rr - rs).otherwise(rq).cast("bigint"),
        F.when(fix_r, -rq - rs).otherwise(rr).cast("bigint"),
    )


def hex_centre(q: Column, r: Column, edge_km: float, base_lat: float) -> tuple[Column, Column]:
    """Latitude and longitude of a hexagon's centre; inverse of :func:`hex_axial`."""
    x = dbl(edge_km) * (q.cast("double") * dbl(math.sqrt(3)) + r.cast("double") * dbl(math.sqrt(3) / 2))
    y = dbl(edge_km) * r.cast("double") * dbl(1.5)
    return y / dbl(110.574), x / dbl(111.32 * math.cos(math.radians(base_lat)))


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    up = F.sin(F.radians(lat2 - lat1) / 2)
    across = F.sin(F.radians(lon2 - lon1) / 2)
    chord = up * up + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * across * across
    return chord_m(chord)


def chord_m(chord: Column) -> Column:
    """Great-circle metres of a squared half chord."""
    return dbl(2 * V.EARTH_RADIUS_M) * F.asin(F.sqrt(chord))


def box_area_km2(lat_lo: Column, lat_hi: Column, lon_lo: Column, lon_hi: Column) -> Column:
    tall = F.radians(lat_hi - lat_lo) * dbl(V.EARTH_RADIUS_KM)
    wide = F.radians(lon_hi - lon_lo) * dbl(V.EARTH_RADIUS_KM) * F.cos(F.radians((lat_lo + lat_hi) / 2))
    return F.greatest(tall * wide, dbl(1e-6))


def flat_km(dlat: Column, dlon: Column) -> Column:
    north, east = dlat * dbl(111.0), dlon * dbl(111.0) * dbl(0.87)
    return F.sqrt(north * north + east * east)


def leg_ends(lat: Column, lon: Column) -> Column:
    """Array of the four compass end points around a centre."""
    return F.array(*[
        F.struct(F.lit(name).alias("direction"), (lat + dbl(dlat)).alias("end_lat"), (lon + dbl(dlon)).alias("end_lon"))
        for name, dlat, dlon in V.LEG_OFFSETS
    ])
