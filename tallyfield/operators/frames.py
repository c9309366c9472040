"""Chains of coordinate systems over rows of directions.

Systems are the nodes of a graph: boresight-relative (`bore`), telescope (`tele`), horizon (`hor`), equatorial of J2000 (`cel`),
galactic (`gal`), ecliptic (`ecl`), and any that edges are added for. When a plan is made, the shortest way from one system
to another is searched, each edge is a list of steps on unit vectors, and steps that are the same for all rows are multiplied to
one matrix; what is left are Columns: a rotation per row where time or boresight enter. `name:lon_lat` is the system
`name` with its pole turned to a direction given in degrees.

The horizon's rotation takes the Earth's angle at universal time, with the offset of universal time from the last row at or before
each time of an orientation table, and precession to one epoch for the whole plan. Refraction, aberration, nutation and polar
motion are not in it (up to about half an arc minute, refraction near the horizon aside). Longitudes and latitudes are in radians,
azimuth runs from north through east, times are days (MJD, UTC).
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import GALACTIC, OBLIQUITY, euler_matrix
from .sequences import asof

Matrix = list[list[float]]
#: A matrix; or a rotation about an axis by a Column; or a function of (lon, lat).
Step = tuple[str, object]
#: Seen from inside the sphere, longitude runs to the right in these systems, to the left in others (fixed values).
RIGHT_HANDED = frozenset({"hor", "tele", "bore"})
#: How far to either side the two evaluations are that the turn is taken from.
OFFSET = 5e-7


@dataclass(frozen=True)
class Site:
    """Degrees; the tilt is that of the azimuth axis, in the direction base_az; slopes are arc minutes a degree of azimuth (default
    values are fixed: those of the site that the data model was made for)."""

    lat: float = -22.9585
    lon: float = -67.7876
    base_tilt: float = 0.0107693
    base_az: float = -114.9733961
    slope_az0: float = 0.0
    slope_az: float = 0.0
    slope_el: float = 0.0


def times(p: Matrix, q: Matrix) -> Matrix:
    return [[sum(p[i][m] * q[m][j] for m in range(3)) for j in range(3)] for i in range(3)]


def transposed(m: Matrix) -> Matrix:
    return [list(r) for r in zip(*m, strict=True)]


def precession(mjd: float) -> Matrix:
    """From the mean equator of J2000 to that of a date, by the polynomials of 1976 (fixed values, arc seconds a century)."""
    t = (mjd - 51544.5) / 36525
    zeta, z, theta = (math.radians((a * t + b * t**2 + c * t**3) / 3600) for a, b, c in ((2306.2181, 0.30188, 0.017998), (2306.2181, 1.09468, 0.018203), (2004.3109, -0.42665, -0.041833)))
    return euler_matrix(z, -theta, zeta, "zyz")


def sidereal(ut1: Column, lon: float) -> Column:
    """Local mean sidereal angle at universal time ut1 (days), in radians (fixed values, degrees)."""
    d = ut1 - 51544.5
    t = d / 36525
    whole, part = F.floor(d), d - F.floor(d)  # a whole day turns 360 degrees more than this
    angle = 280.46061837 + 0.98564736629 * whole + 360.98564736629 * part + 0.000387933 * t * t - t * t * t / 38710000
    return F.radians(F.pmod(angle + lon, F.lit(360.0)))


@dataclass
class Frames:
    """The graph of systems. lst: local sidereal angle; bore: direction of the boresight; both are Columns of the rows."""

    site: Site = field(default_factory=Site)
    epoch: float = 55500.0
    lst: Column | None = None
    bore: tuple[Column, Column] | None = None
    edges: dict[tuple[str, str], list[Step]] = field(default_factory=dict)

    def __post_init__(self) -> None:
        s, half = self.site, math.pi / 2
        tilt, az = math.radians(s.base_tilt), math.radians(s.base_az)
        self.edge("tele", "hor", [("matrix", euler_matrix(az, tilt, -az)), ("angles", self._slope)], [("angles", self._level), ("matrix", euler_matrix(az, -tilt, -az))])
        sin, cos = math.sin(math.radians(s.lat)), math.cos(math.radians(s.lat))
        level = [[-sin, 0.0, cos], [0.0, 1.0, 0.0], [cos, 0.0, sin]]  # its own inverse; turns the sense of longitudes round
        if self.lst is not None:
            p = precession(self.epoch)
            self.edge("hor", "cel", [("matrix", level), ("z", self.lst), ("matrix", transposed(p))], [("matrix", p), ("z", -self.lst), ("matrix", level)])
        if self.bore is not None:
            lon, lat = self.bore
            self.edge("bore", "tele", [("y", half - lat), ("z", lon)], [("z", -lon), ("y", lat - half)])
        e = OBLIQUITY
        ecliptic = [[1.0, 0.0, 0.0], [0.0, math.cos(e), math.sin(e)], [0.0, -math.sin(e), math.cos(e)]]
        for name, m in (("gal", GALACTIC), ("ecl", ecliptic)):
            self.edge("cel", name, [("matrix", m)], [("matrix", transposed(m))])

    def edge(self, a: str, b: str, there: list[Step], back: list[Step]) -> None:
        self.edges[a, b], self.edges[b, a] = there, back

    def _slope(self, az: Column, el: Column) -> tuple[Column, Column]:
        s = self.site
        d = self._from_zero(az)
        return az + s.slope_az / 60 * d, el + s.slope_el / 60 * d

    def _level(self, az: Column, el: Column) -> tuple[Column, Column]:
        s = self.site
        d = self._from_zero(az) / (1 + s.slope_az / 60)
        return math.radians(s.slope_az0) + d, el - s.slope_el / 60 * d

    def _from_zero(self, az: Column) -> Column:
        return F.pmod(az - math.radians(self.site.slope_az0) + math.pi, F.lit(2 * math.pi)) - math.pi

    def path(self, source: str, target: str) -> list[str]:
        """Systems from source to target, by the fewest edges."""
        before: dict[str, str] = {source: source}
        todo = deque([source])
        while todo:
            a = todo.popleft()
            for p, q in self.edges:
                if p == a and q not in before:
                    before[q] = a
                    todo.append(q)
        if target not in before:
            raise ValueError(f"no way from {source} to {target}: systems are {sorted({a for a, _ in self.edges})}, hor needs times, bore a boresight")
        out = [target]
        while out[-1] != source:
            out.append(before[out[-1]])
        return out[::-1]

    def steps(self, source: str, target: str) -> list[Step]:
        """What is done to a direction, with neighbouring matrices multiplied."""
        (a, turn), (b, to) = _parsed(source), _parsed(target)
        way = self.path(a, b)
        found: list[Step] = [("matrix", transposed(turn))] if turn else []
        flat = not (self.site.slope_az or self.site.slope_el)
        for p, q in zip(way, way[1:], strict=False):
            found += [s for s in self.edges[p, q] if not (flat and s[0] == "angles" and {p, q} == {"tele", "hor"})]
        found += [("matrix", to)] if to else []
        out: list[Step] = []
        for kind, what in found:
            if kind == "matrix" and out and out[-1][0] == "matrix":
                out[-1] = "matrix", times(what, out[-1][1])
            else:
                out.append((kind, what))
        return out


def _parsed(name: str) -> tuple[str, Matrix | None]:
    base, _, at = name.partition(":")
    if not at:
        return base, None
    lon, lat = (math.radians(float(v)) for v in at.split("_"))
    return base, euler_matrix(0.0, lat - math.pi / 2, -lon)


def _moved(df: DataFrame, steps: list[Step], v: list[str]) -> DataFrame:
    """df with the vectors in columns v moved by the steps, one projection each."""
    for kind, what in steps:
        x, y, z = map(F.col, v)
        if kind == "matrix":
            new = [sum((c * k for c, k in zip((y, z), row[1:], strict=True)), x * row[0]) for row in what]
        elif kind == "z":
            new = [x * F.cos(what) - y * F.sin(what), x * F.sin(what) + y * F.cos(what), z]
        elif kind == "y":
            new = [x * F.cos(what) + z * F.sin(what), y, z * F.cos(what) - x * F.sin(what)]
        else:
            lon, lat = what(F.atan2(y, x), F.atan2(z, F.sqrt(x * x + y * y)))
            new = [F.cos(lat) * F.cos(lon), F.cos(lat) * F.sin(lon), F.sin(lat)]
        df = df.withColumns(dict(zip(v, new, strict=True)))
    return df


def transformed(df: DataFrame, source: str, target: str, lon: str, lat: str, time: str | None = None, orientation: DataFrame | None = None, site: Site | None = None, epoch: float = 55500.0, bore: tuple[str, str] | None = None, turn: str | None = None, size: str | None = None, nearest: bool = False) -> DataFrame:
    """df with the direction (lon, lat) given in another system.

    time: days of the rows, needed for ways through the horizon; orientation: (mjd, dut seconds) rows in force from mjd on
    (without it universal time is that of the clock). A time before the table is an error when it is met, or with `nearest` takes the
    first row. turn: column for the angle by which the direction of growing longitude is turned, in the sense of the systems' own
    handedness; size: column for the apparent magnification, cos(lat before) / cos(lat after). Nulls give nulls.
    """
    columns = df.columns
    lst = None
    if time is not None:
        df = df.withColumn("_mjd", F.col(time).cast("double"))
        if orientation is not None:
            df = asof(df, orientation.select(F.col("mjd").cast("double").alias("mjd"), F.col("dut").cast("double").alias("_dut")), "_mjd", "mjd", ["_dut"], clamp=nearest, bucket="floor(_t / 30)")
            known = F.when(F.col("_mjd").isNull() | F.col("_dut").isNotNull(), F.col("_dut")).otherwise(F.raise_error(F.concat(F.lit("no orientation of the Earth for day "), F.col("_mjd").cast("string"))).cast("double"))
            df = df.withColumn("_dut", known)
        ut1 = F.col("_mjd") + (F.col("_dut") / 86400 if orientation is not None else F.lit(0.0))
        df = df.withColumn("_lst", sidereal(ut1, (site or Site()).lon))
        lst = F.col("_lst")
    frames = Frames(site or Site(), epoch, lst, (F.col(bore[0]), F.col(bore[1])) if bore else None)
    return through(df, frames, source, target, lon, lat, turn, size).select(*columns, *[c for c in (turn, size) if c])


def through(df: DataFrame, frames: Frames, source: str, target: str, lon: str, lat: str, turn: str | None = None, size: str | None = None) -> DataFrame:
    """transformed() with a graph of one's own; helper columns stay."""
    steps = frames.steps(source, target)
    first, second, third = ([f"_{c}{k}" for c in "xyz"] for k in range(3))

    def vectors(names: list[str], offset: float) -> dict[str, Column]:
        a, b = F.col(lon) + offset, F.col(lat)
        return dict(zip(names, (F.cos(b) * F.cos(a), F.cos(b) * F.sin(a), F.sin(b)), strict=True))

    wanted = [(first, 0.0), (second, OFFSET), (third, -OFFSET)][: 3 if turn else 1]
    out = df.withColumns({k: c for names, offset in wanted for k, c in vectors(names, offset).items()} | {"_lat": F.col(lat)})
    for names, _ in wanted:
        out = _moved(out, steps, names)
    at = lambda v: (F.atan2(F.col(v[1]), F.col(v[0])), F.atan2(F.col(v[2]), F.sqrt(F.col(v[0]) * F.col(v[0]) + F.col(v[1]) * F.col(v[1]))))
    new_lon, new_lat = at(first)
    more: dict[str, Column] = {lon: new_lon, lat: new_lat}
    if size:
        more[size] = F.cos("_lat") / F.cos(new_lat)
    if turn:
        a, b = (_parsed(s)[0] in RIGHT_HANDED for s in (source, target))
        (lon2, lat2), (lon1, lat1) = at(second), at(third)
        east = F.pmod(lon2 - lon1 + math.pi, F.lit(2 * math.pi)) - math.pi
        angle = F.atan2(lat2 - lat1, east * F.cos(new_lat)) - (math.pi if a != b else 0.0)
        more[turn] = -angle if b else angle
    return out.withColumns(more)
