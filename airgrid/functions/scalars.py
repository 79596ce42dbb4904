"""Column expressions of the scalar library.  Division by zero gives null unless stated."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088


def ndvi(nir: Column, red: Column) -> Column:
    """Zero where the sum is zero."""
    return F.coalesce(F.try_divide(nir - red, nir + red), F.lit(0.0))


def ndwi(green: Column, nir: Column) -> Column:
    return F.try_divide(green - nir, green + nir)


def colour_differences(red: Column, green: Column, blue: Column) -> tuple[Column, Column]:
    return red - blue, 4 * green - red - 3 * blue


def angstrom(a440: Column, a675: Column) -> Column:
    """Exponent from two wavelengths; null unless both are positive."""
    ok = (a440 > 0) & (a675 > 0)
    return F.when(ok, -F.log(a440 / a675) / math.log(440 / 675))


def aod550(a440: Column, exponent: Column) -> Column:
    return a440 * F.pow(F.lit(550 / 440), -exponent)


def tasselled_cap(blue: Column, green: Column, red: Column, nir: Column) -> tuple[Column, Column]:
    """The two linear combinations of a tasselled cap (fixed values: weights of blue, green, red, near infrared)."""
    weights = (0.326, 0.509, 0.56, 0.567), (-0.311, -0.356, -0.325, 0.819)
    first, second = (a * blue + b * green + c * red + d * nir for a, b, c, d in weights)
    return first, second


def wind_speed(u: Column, v: Column) -> Column:
    return F.sqrt(u * u + v * v)


def wind_direction(u: Column, v: Column) -> Column:
    return F.pmod(180 + F.degrees(F.atan2(v, u)), F.lit(360.0))


def surface_pm25(dust: Column, oc: Column, bc: Column, ss: Column, so4: Column) -> Column:
    return dust + oc + bc + ss + 1.375 * so4


def model_units(pm25: Column, aod: Column) -> tuple[Column, Column]:
    """Modelled PM2.5 times 100 and optical depth times 1000, as feature tables hold them."""
    return pm25 * 100, aod * 1000


def decode(x: Column, scale: float, offset: float, fill: float) -> Column:
    """scale * (x - offset), with the fill value as 0 before."""
    return F.lit(scale) * (F.when(x == fill, 0.0).otherwise(x) - offset)


def scattering_angle(sza: Column, vza: Column, saa: Column, vaa: Column, legacy: bool = False) -> Column:
    """Degrees; the relative azimuth is folded into 0..180 in degrees first.  Null where an angle is null.  ``legacy`` folds with
    180 and 360 what is in radians by then."""
    raa = F.radians(F.abs(vaa - saa)) if legacy else F.abs(vaa - saa)
    raa = 180 - F.when(raa > 180, 360 - raa).otherwise(raa)
    s, v, raa = F.radians(sza), F.radians(vza), raa if legacy else F.radians(raa)
    cos = -F.cos(v) * F.cos(s) + F.sin(v) * F.sin(s) * F.cos(raa)
    return F.when(cos.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))))


def station_aod550(a440: Column, exponent: Column) -> Column:
    """With the exponent that a station reports; 0 where it reports none."""
    return F.when(exponent.isNotNull(), aod550(a440, exponent)).otherwise(0.0)


def polarised_reflectance(i: Column, q: Column, u: Column, sza: Column) -> Column:
    return F.try_divide(math.pi * F.sqrt(q * q + u * u), i * F.cos(F.radians(sza)))


def pixel_to_geo(t: tuple[float, ...], row: Column, col: Column) -> tuple[Column, Column]:
    return t[0] + col * t[1] + row * t[2], t[3] + col * t[4] + row * t[5]


def geo_to_index(t: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """(row, col) with fractions, counted from the outer corner; ``t`` may hold numbers or columns."""
    det = t[1] * t[5] - t[2] * t[4]
    dx, dy = x - t[0], y - t[3]
    return (dy * t[1] - dx * t[4]) / det, (dx * t[5] - dy * t[2]) / det


def geo_to_pixel(t: tuple[float, ...], x: Column, y: Column) -> tuple[Column, Column]:
    """(row, col), truncated to whole numbers."""
    row, col = geo_to_index(t, x, y)
    return row.cast("int"), col.cast("int")


def wrap_longitude(lon: Column, west: Column | float) -> Column:
    """``lon`` moved by whole turns into [west, west + 360)."""
    return west + F.pmod(lon - west, F.lit(360.0))


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Kilometres; null where a coordinate is null."""
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.when(a.isNotNull(), 2 * EARTH_KM * F.asin(F.least(F.lit(1.0), F.sqrt(a))))


def declination(day: Column) -> Column:
    """Solar declination in radians by day of year (Fourier series)."""
    b = 2 * math.pi * (day - 1) / 365
    return 0.006918 - 0.399912 * F.cos(b) + 0.070257 * F.sin(b) - 0.006758 * F.cos(2 * b) + 0.000907 * F.sin(2 * b) - 0.002697 * F.cos(3 * b) + 0.00148 * F.sin(3 * b)


def solar_altitude(lat: Column, dec: Column, second_of_day: Column) -> Column:
    """Degrees, from latitude in degrees, declination in radians and seconds of solar time."""
    hour = F.radians((second_of_day / 3600 - 12) * 15)
    return F.degrees(F.asin(F.sin(F.radians(lat)) * F.sin(dec) + F.cos(F.radians(lat)) * F.cos(dec) * F.cos(hour)))


def solar_position(lat: Column, dec: Column, hour: Column, legacy: bool = False) -> tuple[Column, Column]:
    """Altitude and the cosine of the azimuth, all angles in radians.  ``legacy`` gives the altitude's sine instead, and puts
    it in its angle's place in the azimuth."""
    sine = F.sin(lat) * F.sin(dec) + F.cos(lat) * F.cos(dec) * F.cos(hour)
    h = sine if legacy else F.asin(sine)
    return h, F.try_divide(F.sin(h) * F.sin(lat) - F.sin(dec), F.cos(h) * F.cos(lat))


def hour_angle(second_of_day: Column, eot_seconds: Column, sign: Column, legacy: bool = False) -> Column:
    """Degrees from noon of solar time: the equation of time is added for sign ``+``, taken off for ``-``, else null.
    ``legacy`` divides by 36000 seconds an hour."""
    t = F.when(sign == "+", second_of_day + eot_seconds).when(sign == "-", second_of_day - eot_seconds)
    return (t / (36000 if legacy else 3600) - 12) * 15


def season_code(date: Column) -> Column:
    return F.cos(2 * math.pi * F.month(date) / 12)


def year_code(date: Column, first: int = 2016, last: int = 2020) -> Column:
    """Year in population standard deviations from the mean of the years ``first`` to ``last``."""
    n = last - first + 1
    return (F.year(date) - (first + last) / 2) / math.sqrt((n * n - 1) / 12)


def everyday(year: Column, begin: Column, end: Column) -> Column:
    """Days from ``begin`` to ``end`` (``yyyymmdd`` strings) as an array of such strings; an error if they leave ``year``."""
    a, b = F.to_date(begin, "yyyyMMdd"), F.to_date(end, "yyyyMMdd")
    days = F.transform(F.sequence(a, b), lambda d: F.date_format(d, "yyyyMMdd"))
    return F.when((F.year(a) == year) & (F.year(b) == year) & (a <= b), days).otherwise(F.raise_error(F.lit("days outside the year")))


def sinusoidal(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Spherical sinusoidal projection, metres."""
    r = EARTH_KM * 1000
    return r * F.radians(lon) * F.cos(F.radians(lat)), r * F.radians(lat)


def level(v: Column, lo: Column, hi: Column, n: int) -> Column:
    """Equal-width level 0..n-1 over [lo, hi + 1)."""
    return F.floor((v - lo) / ((hi + 1 - lo) / n)).cast("int")


# names and places in texts
def base_name(path: Column) -> Column:
    """What follows the last slash, without its last extension; a leading dot begins no extension."""
    name = F.regexp_replace(path, r"^.*[/\\]", "")
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """The last extension with its dot, or empty."""
    return F.regexp_extract(path, r"[^/\\](\.[^./\\]*)$", 1)


def name_has(path: Column, prefix: str = "", part: str = "", suffix: str = "") -> Column:
    """Whether the name without folders begins, goes on and ends in this way."""
    name = F.regexp_replace(path, r"^.*[/\\]", "")
    return name.startswith(prefix) & name.contains(part) & name.endswith(suffix)


def date_in(text: Column) -> Column:
    """The first eight digits that are a date; null without any."""
    return F.try_to_timestamp(F.nullif(F.regexp_extract(text, r"(\d{8})", 1), F.lit("")), F.lit("yyyyMMdd")).cast("date")


def point_of(wkt: Column) -> tuple[Column, Column]:
    """x and y of ``POINT (x y)``; nulls for other texts."""
    number = r"\s*([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)\s*"
    shape = rf"(?i)^\s*POINT\s*\({number}\s{number}\)\s*$"
    x, y = (F.nullif(F.regexp_extract(wkt, shape, i), F.lit("")).try_cast("double") for i in (1, 2))
    return x, y
