"""Planar and spherical geometry as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
M_PER_DEGREE = 111_320.0
FEET = 3.280839895


def equirectangular_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    x = (lon2 - lon1) * F.cos(F.radians(lat1)) * M_PER_DEGREE
    y = (lat2 - lat1) * M_PER_DEGREE
    return F.sqrt(x * x + y * y)


def haversine_m(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def bearing_deg(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Initial bearing, clockwise from north, in [0, 360)."""
    d = F.radians(lon2 - lon1)
    y = F.sin(d) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(d)
    return F.pmod(F.degrees(F.atan2(y, x)), F.lit(360.0))


def angle_between(a: Column, b: Column) -> Column:
    """Smallest angle between two bearings, 0 to 180."""
    d = F.pmod(F.abs(a - b), F.lit(360.0))
    return F.least(d, 360.0 - d)


FACES = (("F", 0.0), ("R", 90.0), ("B", 180.0), ("L", 270.0))


def face_for_bearing(bearing: Column, yaw: Column) -> Column:
    """Camera face whose direction is nearest; the earlier of F, R, B, L on ties."""
    options = F.array(*[F.struct(F.round(angle_between(bearing, F.pmod(yaw + off, F.lit(360.0))), 9).alias("d"), F.lit(i).alias("i"), F.lit(n).alias("face")) for i, (n, off) in enumerate(FACES)])
    return F.array_min(options)["face"]


def face_bearing(face: Column, yaw: Column | None = None) -> Column:
    """Compass bearing of a face; null for up and down; relative to yaw if given."""
    base = F.lit(None).cast("double")
    for n, off in FACES:
        base = F.when(face == n, off).otherwise(base)
    return base if yaw is None else F.pmod(base + yaw, F.lit(360.0))


def grid_cell(lat: Column, lon: Column, cell_m: float, lat0: float = 40.7) -> tuple[Column, Column]:
    """Row and column of a square grid, by floor."""
    dy, dx = cell_m / M_PER_DEGREE, cell_m / (M_PER_DEGREE * math.cos(math.radians(lat0)))
    return F.floor(lat / dy).cast("long"), F.floor(lon / dx).cast("long")


def local_xy(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin; within 0.1 % of a projected frame over a city."""
    return (lon - lon0) * M_PER_DEGREE * math.cos(math.radians(lat0)), (lat - lat0) * M_PER_DEGREE


#: GRS 80: semi-major axis in metres and flattening; US survey foot in metres.
AXIS, FLAT, SURVEY_FOOT = 6378137.0, 1 / 298.257222101, 1200 / 3937


def krueger() -> tuple[float, list[float]]:
    """Rectifying radius and the series of the transverse Mercator projection, to the fourth order of the third flattening."""
    n = FLAT / (2 - FLAT)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return radius, [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]


def utm_xy(lat: Column, lon: Column, zone: int = 18) -> tuple[Column, Column]:
    """Easting and northing in metres of a UTM zone, northern half; within millimetres inside the zone."""
    n = FLAT / (2 - FLAT)
    e = 2 * math.sqrt(n) / (1 + n)
    radius, series = krueger()
    d, s = F.radians(lon - (6 * zone - 183)), F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), F.atanh(F.sin(d) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(series)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(series)), F.lit(0.0))
    return 500_000 + 0.9996 * radius * east, 0.9996 * radius * north


def conic(parallels: tuple[float, float], origin: float) -> tuple[float, float, float, float]:
    """(eccentricity, cone constant, scale of radii, radius at the origin) of a conformal conic with two standard parallels, in degrees."""
    e = math.sqrt(2 * FLAT - FLAT**2)
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    a, b, o = (math.radians(x) for x in (*parallels, origin))
    n = (math.log(m(a)) - math.log(m(b))) / (math.log(t(a)) - math.log(t(b)))
    scale = AXIS * m(a) / (n * t(a) ** n)
    return e, n, scale, scale * t(o) ** n


#: The Long Island zone of the New York state plane: standard parallels, origin, false easting in metres: fixed values.
LONG_ISLAND = ((41 + 2 / 60, 40 + 40 / 60), 40 + 10 / 60, -74.0, 300_000.0)


def state_plane_ft(lat: Column, lon: Column) -> tuple[Column, Column]:
    """Easting and northing in US survey feet of the Long Island zone."""
    parallels, origin, centre, east = LONG_ISLAND
    e, n, scale, at_origin = conic(parallels, origin)
    s = F.sin(F.radians(lat))
    t = F.tan(math.pi / 4 - F.radians(lat) / 2) / F.pow((1 - e * s) / (1 + e * s), F.lit(e / 2))
    rho, theta = scale * F.pow(t, F.lit(n)), n * F.radians(lon - centre)
    return (east + rho * F.sin(theta)) / SURVEY_FOOT, (at_origin - rho * F.cos(theta)) / SURVEY_FOOT


def ring_area(ring: Column) -> Column:
    """Signed shoelace area of an array of struct(x, y)."""
    n = F.size(ring)
    term = lambda i: F.get(ring, i)["x"] * F.get(ring, (i + 1) % n)["y"] - F.get(ring, (i + 1) % n)["x"] * F.get(ring, i)["y"]
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda s, i: s + term(i)) / 2


def ring_centroid(ring: Column) -> Column:
    """Mean of the vertices (without a repeated last one) as struct(x, y)."""
    n = F.size(ring)
    closed = (F.get(ring, 0)["x"] == F.get(ring, n - 1)["x"]) & (F.get(ring, 0)["y"] == F.get(ring, n - 1)["y"]) & (n > 1)
    open_ = F.when(closed, F.slice(ring, 1, n - 1)).otherwise(ring)
    mean = lambda k: F.aggregate(open_, F.lit(0.0), lambda s, p: s + p[k]) / F.size(open_)
    return F.struct(mean("x").alias("x"), mean("y").alias("y"))


def point_in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd rule; points on an edge count by the half-open convention."""
    n = F.size(ring)

    def crosses(s: Column, i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        straddles = (a["y"] > y) != (b["y"] > y)
        at = (b["x"] - a["x"]) * (y - a["y"]) / (b["y"] - a["y"]) + a["x"]
        return F.when(straddles & (x < at), ~s).otherwise(s)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(False), crosses)


def segment_distance(x: Column, y: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Distance from a point to a segment; along an axis the nearest point is clamped, so no rounding of a share of the length enters."""
    dx, dy = bx - ax, by - ay
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.try_divide((x - ax) * dx + (y - ay) * dy, dx * dx + dy * dy), F.lit(0.0))))
    clamp = lambda v, a, b: F.greatest(F.least(a, b), F.least(F.greatest(a, b), v))
    nx = F.when((dy == 0) & dx.isNotNull(), clamp(x, ax, bx)).otherwise(ax + t * dx)
    ny = F.when((dx == 0) & dy.isNotNull(), clamp(y, ay, by)).otherwise(ay + t * dy)
    return F.sqrt(F.pow(x - nx, 2) + F.pow(y - ny, 2))


def ring_distance(x: Column, y: Column, ring: Column) -> Column:
    """0 inside, else the distance to the nearest edge."""
    n = F.size(ring)
    side = lambda i: segment_distance(x, y, F.get(ring, i)["x"], F.get(ring, i)["y"], F.get(ring, (i + 1) % n)["x"], F.get(ring, (i + 1) % n)["y"])
    near = F.array_min(F.transform(F.sequence(F.lit(0), n - 1), side))
    return F.when(point_in_ring(x, y, ring), 0.0).otherwise(near)


def segment_pierces_ring(x1: Column, y1: Column, x2: Column, y2: Column, ring: Column) -> Column:
    """Whether an open segment crosses an edge of the ring or lies inside it."""
    n = F.size(ring)
    side = lambda ax, ay, bx, by, px, py: (bx - ax) * (py - ay) - (by - ay) * (px - ax)

    def cut(i: Column) -> Column:
        a, b = F.get(ring, i), F.get(ring, (i + 1) % n)
        return (side(x1, y1, x2, y2, a["x"], a["y"]) * side(x1, y1, x2, y2, b["x"], b["y"]) < 0) & (side(a["x"], a["y"], b["x"], b["y"], x1, y1) * side(a["x"], a["y"], b["x"], b["y"], x2, y2) < 0)

    return F.exists(F.sequence(F.lit(0), n - 1), cut) | point_in_ring((x1 + x2) / 2, (y1 + y2) / 2, ring)


def wkb_point(lon: Column, lat: Column) -> Column:
    """Little-endian well-known binary of a point; null if a coordinate is."""

    def eight(d: Column) -> Column:
        # the bits of a double from its sign, exponent and fraction
        m = F.abs(d)
        e = F.when(m == 0, 0).otherwise(F.floor(F.log2(m)))
        e = F.when(m >= F.pow(F.lit(2.0), e + 1), e + 1).when(m < F.pow(F.lit(2.0), e), e - 1).otherwise(e)
        frac = ((m / F.pow(F.lit(2.0), e) - 1) * (1 << 52)).cast("long")
        bits = F.when(m == 0, F.lit(0).cast("long")).otherwise(F.shiftleft((e + 1023).cast("long"), 52).bitwiseOR(frac))
        hex_ = F.lpad(F.hex(bits.bitwiseOR(F.when(d < 0, F.lit(-(1 << 63))).otherwise(F.lit(0).cast("long")))), 16, "0")
        return F.concat(*[F.substring(hex_, k, 2) for k in range(15, 0, -2)])

    return F.when(lon.isNotNull() & lat.isNotNull(), F.unhex(F.concat(F.lit("0101000000"), eight(lon), eight(lat))))


def facing_confidence(hits: Column, samples: Column, distance: Column, reach: float) -> Column:
    """Share of the ray that sees the target times cubic decay with distance, in [0, 1]."""
    decay = F.pow(F.greatest(F.lit(0.0), 1 - distance / reach), 3)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), hits / samples * decay))


def depth_code(red: Column, green: Column) -> Column:
    """16-bit depth code from two bytes; null for no return."""
    code = F.shiftleft(red.cast("int"), 8).bitwiseOR(green.cast("int"))
    return F.when(code == 0, None).otherwise(code)


def depth_m(code: Column, scale: float, offset: float = 0.0) -> Column:
    return code * scale + offset


def tile_box(x: Column, y: Column, w: Column, h: Column, left: Column, top: Column, width: int, height: int) -> Column:
    """A box of a tile in image pixels, clamped to the image, as struct(x0, y0, x1, y1) of ints."""
    clamp = lambda v, most: F.greatest(F.lit(0), F.least(F.lit(most), v.cast("int")))
    return F.struct(clamp(left + x, width).alias("x0"), clamp(top + y, height).alias("y0"), clamp(left + x + w, width).alias("x1"), clamp(top + y + h, height).alias("y1"))


def cube_direction(face: Column, u: Column, v: Column) -> Column:
    """Unit view direction of a point of a cube face (u right, v down, both -1 to 1), as struct(x east, y north, z up)."""
    pick = lambda f, r, b, l, up, d: F.when(face == "F", f).when(face == "R", r).when(face == "B", b).when(face == "L", l).when(face == "U", up).otherwise(d)  # noqa: E731, E741
    one = F.lit(1.0)
    x, y, z = pick(u, one, -u, -one, u, u), pick(one, -u, -one, u, v, -v), pick(-v, -v, -v, -v, one, -one)
    n = F.sqrt(x * x + y * y + z * z)
    return F.struct((x / n).alias("x"), (y / n).alias("y"), (z / n).alias("z"))
