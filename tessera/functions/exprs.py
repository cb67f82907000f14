"""Column expressions of the panel; all of them stay inside Catalyst."""

from __future__ import annotations

from math import pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.config import SLOTS

BASE32 = "0123456789bcdefghjkmnpqrstuvwxyz"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_case(c) -> Column:
    """Upper case after any character that is not a letter, lower case after one."""
    words = F.split(_col(c), r"(?<!\p{L})(?=\p{L})")
    return F.array_join(F.transform(words, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substr(p, F.lit(2))))), "")


def clean_category(c, fill: str | None = "Unknown") -> Column:
    """Trimmed and title-cased; the spellings of nothing become null, then ``fill``."""
    title = title_case(F.trim(_col(c)))
    value = F.when(~title.isin("Nan", "None", ""), title)
    return value if fill is None else F.coalesce(value, F.lit(fill))


def hour_minute(ts) -> tuple[Column, Column]:
    parts = F.split(F.coalesce(_col(ts), F.lit("0:0")), ":")
    return F.get(parts, F.lit(0)).cast("int"), F.get(parts, F.lit(1)).cast("int")


def slot(hour, minute) -> Column:
    return (_col(hour) * 4 + F.floor(_col(minute) / 15)).cast("int")


def cyclic(s="time_slot") -> tuple[Column, Column]:
    angle = F.lit(2 * pi) * _col(s) / SLOTS
    return F.sin(angle), F.cos(angle)


def day_of_week(day="day") -> Column:
    return F.pmod(_col(day), F.lit(7)).cast("int")


def is_weekend(day="day") -> Column:
    return day_of_week(day).isin(5, 6).cast("int")


def month(day="day") -> Column:
    return (F.pmod(F.floor(_col(day) / 30), F.lit(12)) + 1).cast("int")


def _bits(gh: Column) -> Column:
    """0/1 array of a geohash, five bits a character; null if a character is none of the alphabet."""
    code = F.transform(F.filter(F.split(gh, ""), lambda c: c != ""), lambda c: F.instr(F.lit(BASE32), c) - 1)
    bits = F.flatten(F.transform(code, lambda v: F.array(*[F.shiftright(v, k).bitwiseAND(F.lit(1)) for k in (4, 3, 2, 1, 0)])))
    return F.when(~F.exists(code, lambda v: v < 0) & (F.length(gh) > 0), bits)


def _center(bits: Column, odd: int, low: float, high: float) -> Column:
    mine = F.filter(bits, lambda b, i: i % 2 == odd)
    start = F.struct(F.lit(low).alias("a"), F.lit(high).alias("b"))
    halve = lambda s, bit: F.struct(F.when(bit == 1, (s["a"] + s["b"]) / 2).otherwise(s["a"]).alias("a"), F.when(bit == 1, s["b"]).otherwise((s["a"] + s["b"]) / 2).alias("b"))
    return F.aggregate(mine, start, halve, lambda s: (s["a"] + s["b"]) / 2)


def geohash_lat(gh) -> Column:
    """Latitude of the cell's centre; invalid geohashes give null."""
    return _center(_bits(_col(gh)), 1, -90.0, 90.0)


def geohash_lon(gh) -> Column:
    return _center(_bits(_col(gh)), 0, -180.0, 180.0)


def prefix(gh, drop: int) -> Column:
    return F.substr(_col(gh), F.lit(1), F.length(_col(gh)) - drop)


def clip(c, low=0.0, high=1.0) -> Column:
    """Nulls stay null, unlike with least and greatest alone."""
    c = _col(c)
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def ratio(a, b) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(_col(a), _col(b))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in radians."""
    a, b, c, d = (F.radians(_col(x)) for x in (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin((c - a) / 2), 2) + F.cos(a) * F.cos(c) * F.pow(F.sin((d - b) / 2), 2)
    return 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def is_highway(road="road_type", lanes="lanes") -> Column:
    return F.coalesce(_col(road) == "Highway", F.lit(False)) | F.coalesce(_col(lanes) >= 4, F.lit(False))


def between(c, bounds: tuple[int, int]) -> Column:
    return _col(c).between(*bounds)


def array_mean_std(columns: list[Column]) -> tuple[Column, Column]:
    """Row-wise mean and sample deviation over the columns that are not null."""
    have = F.filter(F.array(*columns), lambda x: x.isNotNull())
    n = F.size(have)
    mean = F.when(n > 0, F.aggregate(have, F.lit(0.0), lambda a, x: a + x) / n)
    squares = F.aggregate(F.transform(have, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    return mean, F.sqrt(F.when(n > 1, squares / (n - 1)))


def sample_weight(lag="demand_lag_96") -> Column:
    return 1 + F.pow(_col(lag), 2)
