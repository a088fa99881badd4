"""Distances and places."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.text import place_key

EARTH_KM = 6371.0088
#: Words that mark a posting as remote.
REMOTE_WORDS = ("remote", "remoto", "remota", "home office", "work from home", "anywhere")
#: Codes of states.
BR_STATES = "AC AL AP AM BA CE DF ES GO MA MT MS MG PA PB PR PE PI RJ RN RS RO RR SC SP SE TO".split()
US_STATES = "AL AK AZ AR CA CO CT DE FL GA HI ID IL IN IA KS KY LA ME MD MA MI MN MS MO MT NE NV NH NJ NM NY NC ND OH OK OR PA RI SC SD TN TX UT VT VA WA WV WI WY DC".split()
#: Names of countries, as parts of a text.
COUNTRY_NAMES = (("BR", ("brazil", "brasil")), ("US", ("united states", "united states of america", "usa")))


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.atan2(F.sqrt(a), F.sqrt(1 - F.least(a, F.lit(1.0))))


def in_box(lat: Column, lon: Column, at_lat: float, at_lon: float, km: float) -> Column:
    """A box around the circle, as plain comparisons that reach the scan."""
    d_lat = math.degrees(km / EARTH_KM)
    cos = math.cos(math.radians(min(89.9, abs(at_lat) + d_lat)))
    d_lon = min(180.0, d_lat / max(cos, 1e-6))
    box = lat.between(at_lat - d_lat, at_lat + d_lat)
    if at_lon - d_lon < -180 or at_lon + d_lon > 180:  # the circle crosses the date line
        return box
    return box & lon.between(at_lon - d_lon, at_lon + d_lon)


def distance_bonus(distance: Column, radius: Column | float) -> Column:
    """Up to 10 points, none at the border; halves round to even."""
    r = radius if isinstance(radius, Column) else F.lit(float(radius))
    return F.when(r <= 0, 0).otherwise(F.bround(10 * F.greatest(F.lit(0.0), 1 - distance / r)).cast("int"))


def tells_remote(key: Column) -> Column:
    """Whether a place key holds a word for remote work."""
    return key.rlike("|".join(REMOTE_WORDS))


def is_remote(text: Column) -> Column:
    return tells_remote(place_key(text))


def _tidied(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))


def infer_country(text: Column) -> Column:
    """BR or US by name, by a state code that only one of them has, or by "city - state"; else null."""
    raw, key = _tidied(text), place_key(text)
    result = F.lit(None).cast("string")
    dashed = F.filter(F.transform(F.split(raw, r"\s[-–—]\s"), lambda p: F.trim(p)), lambda p: p != "")
    result = F.when(F.upper(F.try_element_at(dashed, F.lit(2))).isin(*BR_STATES), "BR").otherwise(result)
    codes = F.regexp_extract_all(raw, F.lit(r"(?U)\b([A-Z]{2})\b"), F.lit(1))
    for country, only in (("US", sorted(set(US_STATES) - set(BR_STATES))), ("BR", sorted(set(BR_STATES) - set(US_STATES)))):
        result = F.when(F.arrays_overlap(codes, F.array(*map(F.lit, only))), country).otherwise(result)
    for country, names in reversed(COUNTRY_NAMES):
        named = F.lit(False)
        for n in names:
            named = named | F.contains(key, F.lit(n))
        result = F.when(named, country).otherwise(result)
    return result


def location_hints(text: Column) -> Column:
    """Struct (city, country) of a location text's first alternative: what stands before its first dash or comma."""
    first = F.trim(F.split(_tidied(text), r"[/|;]")[0])
    parts = F.filter(F.transform(F.split(first, r"\s[-–—]\s|,"), lambda p: F.trim(p)), lambda p: p != "")
    city = F.trim(F.regexp_replace(F.coalesce(F.try_element_at(parts, F.lit(1)), F.lit("")), r"(?i)^(location|localizacao|localização)\s*:\s*", ""))
    return F.struct(city.alias("city"), F.when(F.size(parts) > 0, infer_country(first)).alias("country"))
