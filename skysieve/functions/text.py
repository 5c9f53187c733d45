"""Identifiers, epochs, flags and magnitudes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from skysieve.functions.sky import ARCSEC, col, finite

#: Text that means true, lower case.
TRUE_WORDS = ("true", "t", "1", "yes", "y")


def truthy(x: Column | str) -> Column:
    """Boolean of a flag kept as boolean, number or text; null and anything else is false."""
    return F.coalesce(F.lower(F.trim(col(x).cast("string"))).isin(*TRUE_WORDS), F.lit(False))


def number(x: Column | str) -> Column:
    """DOUBLE of a text; null where it doesn't parse."""
    return F.trim(col(x)).try_cast("double")


def object_number(x: Column | str) -> Column:
    """Integer of an object id that may carry a decimal part."""
    return number(x).try_cast("bigint")


def source_id(tile: Column | str, object_id: Column | str) -> Column:
    return F.concat(col(tile), F.lit(":"), col(object_id).cast("string"))


def tile_of(row_id: Column | str) -> Column:
    """Text before the first colon."""
    return F.split_part(col(row_id), F.lit(":"), F.lit(1))


def tile_name(ra: Column | str, dec: Column | str) -> Column:
    return F.format_string("tile-RA%.3f-DEC%+.3f", col(ra), col(dec))


def tile_centre(name: Column | str) -> tuple[Column, Column]:
    """(RA, Dec) of a tile name; null where it doesn't match."""
    pattern = r"RA_?([0-9]+(?:\.[0-9]+)?)[-_]DEC_?([+-]?[0-9]+(?:\.[0-9]+)?)"
    return tuple(F.regexp_extract(col(name), pattern, k).try_cast("double") for k in (1, 2))


def stable_row_id(tile: Column | str, index: Column | str) -> Column:
    """First eight bytes of SHA-1 of tile:index as an unsigned number in text."""
    return F.conv(F.substring(F.sha1(F.concat(col(tile), F.lit(":"), col(index).cast("string"))), 1, 16), 16, 10)


def canonical_id(x: Column | str) -> Column:
    """Digits of an id that a tool wrote in scientific notation; plain digits stay, anything else is null."""
    t = F.trim(col(x).cast("string"))
    return F.when(t.rlike(r"^[0-9]+$"), t).when(t.rlike(r"^[0-9.]+[eE][+]?[0-9]+$|^[0-9]+\.0*$"), t.try_cast("decimal(38,0)").cast("string"))


def moon_code(x: Column | str) -> Column:
    """Digits only, two of them at least."""
    return F.lpad(F.regexp_replace(col(x).cast("string"), "[^0-9]", ""), 2, "0")


def valid_magnitude(m: Column | str, brightest: float = 0.0, faintest: float = 50.0) -> Column:
    """Finite and neither a sentinel nor out of range."""
    return finite(m) & (col(m) > -900.0) & (col(m) >= brightest) & (col(m) <= faintest)


def in_arcsec(separation: Column | str, unit: str = "arcsec") -> Column:
    """A separation in arcseconds; unit `guess` takes values up to 0.1 for degrees."""
    s = col(separation)
    return s if unit == "arcsec" else s * ARCSEC if unit == "deg" else F.when(s > 0.1, s).otherwise(s * ARCSEC)


def epoch_iso(text: Column | str, carry_day: bool = False) -> Column:
    """UTC ISO text of an observation date: Z or an offset or none, blank or T, and minutes or seconds beyond 59 carried
    over; hours wrap within the day unless `carry_day`."""
    stamp = epoch_timestamp(text, carry_day)
    fraction = F.date_format(stamp, "SSSSSS")
    return F.concat(F.date_format(stamp, "yyyy-MM-dd'T'HH:mm:ss"), F.when(fraction == "000000", "").otherwise(F.concat(F.lit("."), fraction)), F.lit("+00:00"))


def epoch_timestamp(text: Column | str, carry_day: bool = False) -> Column:
    pattern = r"^(\d{4}-\d{2}-\d{2})[T ](\d{2}):(\d{2})(?::(\d{2})(?:\.(\d{1,9}))?)?(Z|[+-]\d{2}:\d{2})?$"
    t = F.trim(col(text).cast("string"))
    part = lambda k: F.regexp_extract(t, pattern, k)
    # a date alone is its midnight
    day = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}$"), t).otherwise(part(1)).try_cast("date")
    seconds = F.coalesce(part(2).try_cast("long"), F.lit(0)) * 3600 + F.coalesce(part(3).try_cast("long"), F.lit(0)) * 60 + F.coalesce(part(4).try_cast("long"), F.lit(0))
    seconds = seconds if carry_day else F.pmod(seconds, F.lit(86_400))
    offset = part(6)
    shift = F.when(offset.rlike(r"^[+-]"), F.when(F.substring(offset, 1, 1) == "-", -1).otherwise(1) * (F.substring(offset, 2, 2).try_cast("int") * 3600 + F.substring(offset, 5, 2).try_cast("int") * 60)).otherwise(F.lit(0))
    micros = F.coalesce(F.rpad(part(5), 6, "0").try_cast("long"), F.lit(0))
    return F.timestamp_micros((F.unix_seconds(day.cast("timestamp")) + seconds - shift) * 1_000_000 + micros)


def mjd(stamp: Column | str) -> Column:
    """Days since 1858-11-17 of a timestamp."""
    return F.unix_micros(col(stamp)) / 86_400_000_000.0 + 40_587.0


def jd(stamp: Column | str) -> Column:
    return mjd(stamp) + 2_400_000.5


def sexagesimal(text: Column | str, hours: bool) -> Column:
    """Degrees of a blank- or colon-separated value; the sign of -00 is kept."""
    parts = F.split(F.trim(F.regexp_replace(col(text), "[hmsd:°'\"]+", " ")), r"\s+")
    sign = F.when(F.trim(col(text)).startswith("-"), -1.0).otherwise(1.0)
    piece = lambda k: F.coalesce(F.abs(F.try_element_at(parts, F.lit(k)).try_cast("double")), F.lit(0.0))
    whole = F.try_element_at(parts, F.lit(1)).try_cast("double")
    return F.when(whole.isNotNull(), sign * (piece(1) + piece(2) / 60.0 + piece(3) / 3600.0) * (15.0 if hours else 1.0))


def survey_class(survey: Column | str) -> Column:
    """Coverage class of a survey name."""
    s = F.upper(F.coalesce(col(survey), F.lit("")))
    return F.when(s.contains("SERC") | s.contains("AAO"), "SERC_AAO").when(s.contains("SUPP"), "SUPPLEMENTAL").when(s.contains("POSS"), "POSS").otherwise("UNKNOWN")
