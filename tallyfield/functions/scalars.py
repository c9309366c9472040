"""Column functions: strings, settings, times, angles, special functions. All stay on the JVM."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- strings


def base_id(c: Column) -> Column:
    return F.split(c, ":")[0]


def sub_id(c: Column) -> Column:
    return F.coalesce(F.get(F.split(c, ":"), F.lit(1)), F.lit(""))


def with_sub(c: Column, sub: Column) -> Column:
    """id:sub, or the id where sub is empty."""
    return F.concat(c, F.when(F.length(sub) > 0, F.concat(F.lit(":"), sub)).otherwise(F.lit("")))


def union_subs(a: Column, b: Column) -> Column:
    """Sorted union of two comma lists without blanks."""
    both = F.array_union(F.split(a, ","), F.split(b, ","))
    return F.array_join(F.array_sort(F.filter(both, lambda x: x != "")), ",")


def head_of(c: Column) -> Column:
    """What stands before the first colon."""
    return F.trim(F.substring_index(c, ":", 1))


def tail_of(c: Column) -> Column:
    return F.trim(F.when(F.instr(c, ":") > 0, F.regexp_replace(c, "^[^:]*:", "")).otherwise(F.lit("")))


def is_number(c: Column) -> Column:
    return c.try_cast("double").isNotNull()


def formatted(template: Column, values: Column) -> Column:
    """Replaces each {name} by the map's entry; unknown names stay."""
    return F.aggregate(F.map_entries(values), template, lambda s, e: F.replace(s, F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"]))


def formatted_all(templates: Column, values: Column) -> Column:
    """The same for every string of a map of lists."""
    return F.transform_values(templates, lambda _, v: F.transform(v, lambda s: formatted(s, values)))


def typed(text: Column, kind: str) -> Column:
    """A setting's text as its declared kind (int, float, bool, str); null if it isn't one."""
    if kind == "bool":
        return F.when(F.lower(F.trim(text)).isin("1", "true", "yes", "on"), True).when(F.lower(F.trim(text)).isin("0", "false", "no", "off"), False)
    return F.trim(text).try_cast({"int": "bigint", "float": "double", "str": "string"}[kind])


def area(c: Column) -> Column:
    """d1:d2,r1:r2[,down] as a struct of numbers."""
    return F.struct(
        *[F.split(F.split(c, ",")[i], ":")[j].try_cast("double").alias(name) for i, j, name in ((0, 0, "dec1"), (0, 1, "dec2"), (1, 0, "ra1"), (1, 1, "ra2"))],
        F.coalesce(F.get(F.split(c, ","), F.lit(2)).try_cast("int"), F.lit(1)).alias("down"),
    )


def system(c: Column) -> Column:
    """base:ref[:refsys]/to[:tosys] as a struct of names; missing parts are null."""
    left, right = F.split(c, "/")[0], F.get(F.split(c, "/"), F.lit(1))
    part = lambda s, k: F.get(F.split(s, ":"), F.lit(k))
    return F.struct(part(left, 0).alias("base"), part(left, 1).alias("ref"), part(left, 2).alias("refsys"), part(right, 0).alias("to"), part(right, 1).alias("tosys"))


# ---- times (seconds since 1970 as doubles, days as MJD)

MJD_1970, DJD_OF_MJD, DAY = 40587.0, 15019.5, 86400.0


def ctime_to_mjd(t: Column) -> Column:
    return t / DAY + MJD_1970


def mjd_to_ctime(m: Column) -> Column:
    return (m - MJD_1970) * DAY


def mjd_to_djd(m: Column) -> Column:
    return m - DJD_OF_MJD


def djd_to_mjd(d: Column) -> Column:
    return d + DJD_OF_MJD


def tai_to_tt(t: Column) -> Column:
    return t + 32.184


def tdb_offset(t: Column) -> Column:
    """Yearly term of barycentric time in seconds."""
    g = F.radians(357.53 + 0.98560028 * (ctime_to_mjd(t) - 51544.5))
    return 0.001658 * F.sin(g) + 0.000014 * F.sin(2 * g)


def tt_to_tdb(t: Column) -> Column:
    return t + tdb_offset(t)


def turns(t: Column, period: Column, dperiod: Column) -> Column:
    """Phase of a period that grows linearly: log1p(dP / P t) / dP, t / P for dP = 0."""
    return F.when(dperiod == 0, t / period).otherwise(F.log1p(dperiod / period * t) / dperiod)


def turn_time(x: Column, period: Column, dperiod: Column) -> Column:
    return F.when(dperiod == 0, x * period).otherwise(F.expm1(x * dperiod) / dperiod * period)


def next_arrival(target: Column, t: Column, nu: Column, dnu: Column) -> Column:
    """Seconds of the day of the first whole turn at or after target."""
    dt = target - t
    f = nu + dnu * dt
    at = nu * dt + dnu * dt * dt / 2
    return F.pmod(target + (F.ceil(at) - at) / f, F.lit(DAY))


# ---- angles and vectors


def unit(lon: Column, lat: Column) -> Column:
    return F.array(F.cos(lon) * F.cos(lat), F.sin(lon) * F.cos(lat), F.sin(lat))


def angles(v: Column) -> Column:
    """(lon, lat) of a vector."""
    return F.struct(F.atan2(v[1], v[0]).alias("lon"), F.atan2(v[2], F.sqrt(v[0] * v[0] + v[1] * v[1])).alias("lat"))


def euler_matrix(a: float, b: float, c: float, kind: str = "zyz") -> list[list[float]]:
    """Rotation by three angles about the named axes, last angle first."""

    def about(axis: str, t: float) -> list[list[float]]:
        s, k = math.sin(t), math.cos(t)
        return {"x": [[1, 0, 0], [0, k, -s], [0, s, k]], "y": [[k, 0, s], [0, 1, 0], [-s, 0, k]], "z": [[k, -s, 0], [s, k, 0], [0, 0, 1]]}[axis]

    def times(p: list, q: list) -> list[list[float]]:
        return [[sum(p[i][m] * q[m][j] for m in range(3)) for j in range(3)] for i in range(3)]

    return times(times(about(kind[0], a), about(kind[1], b)), about(kind[2], c))


def rotated(v: Column, matrix: list[list[float]]) -> Column:
    return F.array(*[sum((v[j] * matrix[i][j] for j in range(1, 3)), v[0] * matrix[i][0]) for i in range(3)])


def rotate_angles(lon: Column, lat: Column, a: float, b: float, c: float, kind: str = "zyz") -> Column:
    return angles(rotated(unit(lon, lat), euler_matrix(a, b, c, kind)))


def recentred(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    """Angles in the system whose pole is (lon0, lat0)."""
    return rotate_angles(lon, lat, 0.0, lat0 - math.pi / 2, -lon0)


def decentred(lon: Column, lat: Column, lon0: float, lat0: float) -> Column:
    return rotate_angles(lon, lat, lon0, math.pi / 2 - lat0, 0.0)


def separation(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Angle between two directions (stable for small ones)."""
    a = F.sin((lat2 - lat1) / 2) ** 2 + F.cos(lat1) * F.cos(lat2) * F.sin((lon2 - lon1) / 2) ** 2
    return 2 * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


#: Rows of the rotation from equatorial (J2000) to galactic axes (fixed values).
GALACTIC = [
    [-0.0548755604162154, -0.8734370902348850, -0.4838350155487132],
    [0.4941094278755837, -0.4448296299600112, 0.7469822444972189],
    [-0.8676661490190047, -0.1980763734312015, 0.4559837761750669],
]
OBLIQUITY = math.radians(23.4392911)


def to_galactic(lon: Column, lat: Column) -> Column:
    return angles(rotated(unit(lon, lat), GALACTIC))


def from_galactic(lon: Column, lat: Column) -> Column:
    return angles(rotated(unit(lon, lat), [list(r) for r in zip(*GALACTIC, strict=True)]))


def to_ecliptic(lon: Column, lat: Column) -> Column:
    s, k = math.sin(OBLIQUITY), math.cos(OBLIQUITY)
    return angles(rotated(unit(lon, lat), [[1, 0, 0], [0, k, s], [0, -s, k]]))


def from_sun_to_earth(position: Column, distance: Column, sun: Column) -> Column:
    """Direction as seen from Earth of what stands at a distance in a direction from the Sun; sun: Earth-to-Sun vector."""
    moved = F.zip_with(F.transform(position, lambda x: x * distance), sun, lambda a, b: a + b)
    return normed(moved)


def from_earth_to_sun(position: Column, distance: Column, sun: Column) -> Column:
    return normed(F.zip_with(F.transform(position, lambda x: x * distance), sun, lambda a, b: a - b))


def normed(v: Column) -> Column:
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.transform(v, lambda x: x / size)


# ---- functions of numbers


def butterworth(f: Column, knee: float, alpha: float) -> Column:
    return F.lit(1.0) if knee <= 0 else 1 / (1 + F.pow(f / knee, F.lit(alpha)))


def safe_divide(a: Column, b: Column, fill: float = 0.0) -> Column:
    q = F.try_divide(a, b)
    return F.when(q.isNull() | F.isnan(q) | (F.abs(q) == float("inf")), F.lit(fill)).otherwise(q)


def fix_bad(c: Column, fill: float = 0.0) -> Column:
    return F.when(c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")), F.lit(fill)).otherwise(c)


def normal_cdf(x: Column) -> Column:
    """Normal distribution by the rational approximation of error 7.5e-8 (fixed coefficients)."""
    t = 1 / (1 + 0.2316419 * F.abs(x))
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    tail = F.exp(-x * x / 2) * poly / math.sqrt(2 * math.pi)
    return F.when(x >= 0, 1 - tail).otherwise(tail)


def max_of_normals_cdf(x: Column, n: Column) -> Column:
    return F.pow(normal_cdf(x), n)


def min_of_normals_sf(x: Column, n: Column) -> Column:
    return F.pow(1 - normal_cdf(x), n)


def sz_spectrum(ghz: Column, temperature: float = 2.725) -> Column:
    """Thermal distortion x coth(x / 2) - 4 with x = h f / k T."""
    x = ghz * (0.0479924307 / temperature)
    return x * (F.exp(x) + 1) / (F.exp(x) - 1) - 4


def hubble(z: Column, h0: float = 67.4, om: float = 0.315) -> Column:
    return h0 * F.sqrt(om * F.pow(1 + z, F.lit(3.0)) + (1 - om))


def critical_density(z: Column, h0: float = 67.4, om: float = 0.315) -> Column:
    """Solar masses per cubic megaparsec: 3 H^2 / 8 pi G."""
    return 3 * F.pow(hubble(z, h0, om), F.lit(2.0)) / (8 * math.pi * 4.30091e-9)


def radius_of(mass: Column, z: Column, delta: float = 200.0) -> Column:
    return F.cbrt(3 * mass / (4 * math.pi * delta * critical_density(z)))


def profile_parameter(mass: Column, z: Column, a0: float, am: float, az: float) -> Column:
    """a0 (m / 1e14)^am (1 + z)^az."""
    return a0 * F.pow(mass / 1e14, F.lit(am)) * F.pow(1 + z, F.lit(az))


def scaling(kind: Column, p: Column, f: Column, f0: float) -> Column:
    """Spectral scaling by template: power law, thermal distortion, or flat."""
    return F.when(kind == "power", F.pow(f / f0, p)).when(kind == "sz", sz_spectrum(f) / sz_spectrum(F.lit(f0))).otherwise(1.0)


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """[max of starts, min of ends) as a struct; null if empty."""
    lo, hi = F.greatest(a0, b0), F.least(a1, b1)
    return F.when(lo < hi, F.struct(lo.alias("lo"), hi.alias("hi")))


def boxes_meet(a: tuple[Column, Column], b: tuple[Column, Column], period: float | None = None) -> Column:
    """Do two ranges meet, also across the wrap?"""
    hit = (a[0] < b[1]) & (b[0] < a[1])
    if period is None:
        return hit
    for k in (-period, period):
        hit = hit | ((a[0] + k < b[1]) & (b[0] < a[1] + k))
    return hit


def diagonal(div: Column, n: int, pol: float = 0.5) -> Column:
    """A scalar weight as the diagonal of an n x n matrix; all but the first are scaled by pol."""
    return F.array(*[(div * (1.0 if i == 0 else pol)) if i == j else F.lit(0.0) for i in range(n) for j in range(n)])


def padded(v: Column, n: int, fill: float = 0.0) -> Column:
    return F.slice(F.concat(v, F.array_repeat(F.lit(fill), n)), 1, n)


def az_slope(az: Column, el: Column, az0: float, per_az: float, per_el: float) -> Column:
    """Pointing that drifts in proportion to the azimuth's distance from az0 (degrees; slopes in arc minutes a degree)."""
    d = F.pmod(az - az0 + 180.0, F.lit(360.0)) - 180.0
    return F.struct((az + per_az / 60 * d).alias("az"), (el + per_el / 60 * d).alias("el"))


def to_sun_by_sun_distance(position: Column, distance: Column, sun: Column) -> Column:
    """(direction from the Sun, distance from Earth) of what is seen in a direction from Earth and stands at a distance from the
    Sun; sun: Earth-to-Sun vector. Of two such places the farther one."""
    along = F.aggregate(F.zip_with(position, sun, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
    size2 = F.aggregate(sun, F.lit(0.0), lambda a, b: a + b * b)
    far = along + F.sqrt(along * along - size2 + distance * distance)
    return F.struct(normed(F.zip_with(F.transform(position, lambda p: p * far), sun, lambda a, b: a - b)).alias("position"), far.alias("distance"))


def bisected(f: Callable[[Column], Column], a: Column, b: Column, steps: int = 60) -> Column:
    """A root of f between a and b by halving; the end where f is nearer 0 if f has one sign at both."""
    start = F.struct(a.cast("double").alias("a"), b.cast("double").alias("b"))

    def half(s: Column, _: Column) -> Column:
        m = (s["a"] + s["b"]) / 2
        left = f(s["a"]) * f(m) <= 0
        return F.struct(F.when(left, s["a"]).otherwise(m).alias("a"), F.when(left, m).otherwise(s["b"]).alias("b"))

    root = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, half)
    fa, fb = f(start["a"]), f(start["b"])
    return F.when(fa * fb < 0, (root["a"] + root["b"]) / 2).when(F.abs(fa) <= F.abs(fb), start["a"]).otherwise(start["b"])


def log_all_positive(means: Column, sigmas: Column) -> Column:
    """Log probability that independent normal variables are all positive; far in the tail by its expansion."""

    def one(z: Column) -> Column:
        tail = -0.5 * math.log(2 * math.pi) - F.ln(-z) - z * z / 2 + F.ln(1 - 1 / (z * z) + 3 / F.pow(z, F.lit(4.0)))
        return F.when(z > -5, F.ln(normal_cdf(z))).otherwise(tail)

    return F.aggregate(F.zip_with(means, sigmas, lambda m, s: one(m / s)), F.lit(0.0), lambda a, b: a + b)


def shared_mode(det: Column, per: int, n: int, mode: Column) -> Column:
    """A detector's part in a correlated noise mode: a cosine over the groups of `per` detectors."""
    return F.cos(2 * math.pi * mode * F.floor(det / per) / (n // per + 1))


def shared_power(f: Column, mode: Column, sigma: float, knee: float = 0.2, alpha: float = 1.0) -> Column:
    return F.pow(f / knee * (mode + 1), F.lit(-alpha)) * sigma * sigma
