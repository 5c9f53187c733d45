"""Coordinate profiles: which column pair holds the position, by the kind of file."""

from __future__ import annotations

from collections.abc import Sequence

# Candidate pairs in order, by profile. Names are case-sensitive.
PROFILES: dict[str, tuple[tuple[str, str], ...]] = {
    "veto": (("RA_corr", "Dec_corr"), ("RA_corr", "DEC_corr"), ("ALPHA_J2000", "DELTA_J2000"), ("ALPHAWIN_J2000", "DELTAWIN_J2000"), ("X_WORLD", "Y_WORLD"), ("RAJ2000", "DEJ2000"), ("RA_ICRS", "DE_ICRS"), ("ra", "dec"), ("RA", "DEC")),
    "sextractor": (("RA_corr", "Dec_corr"), ("ALPHAWIN_J2000", "DELTAWIN_J2000"), ("ALPHA_J2000", "DELTA_J2000"), ("X_WORLD", "Y_WORLD"), ("ra", "dec"), ("RA", "DEC"), ("RAJ2000", "DEJ2000")),
    "external": (("RA_ICRS", "DE_ICRS"), ("RAJ2000", "DEJ2000"), ("RA", "DEC"), ("lon", "lat"), ("ra", "dec"), ("raMean", "decMean"), ("RAMean", "DecMean")),
    "within5-sex": (("RA_corr", "Dec_corr"), ("ALPHAWIN_J2000", "DELTAWIN_J2000"), ("ALPHA_J2000", "DELTA_J2000"), ("X_WORLD", "Y_WORLD")),
    "within5-cat": (("ra", "dec"), ("raMean", "decMean"), ("RAMean", "DecMean"), ("RA_ICRS", "DE_ICRS"), ("RAJ2000", "DEJ2000"), ("RA", "DEC")),
    "post16": (("ALPHAWIN_J2000", "DELTAWIN_J2000"), ("ALPHA_J2000", "DELTA_J2000"), ("X_WORLD", "Y_WORLD")),
    "neowise-opt": (("opt_ra_deg", "opt_dec_deg"), ("ra_deg", "dec_deg"), ("ALPHA_J2000", "DELTA_J2000"), ("ALPHAWIN_J2000", "DELTAWIN_J2000"), ("X_WORLD", "Y_WORLD")),
    "wcsfix": (("ALPHAWIN_J2000", "DELTAWIN_J2000"), ("ALPHA_J2000", "DELTA_J2000"), ("X_WORLD", "Y_WORLD")),
    "plate-det": (("ALPHAWIN_J2000", "DELTAWIN_J2000"), ("ALPHA_J2000", "DELTA_J2000")),
    "plate-gaia": (("RA_ICRS", "DE_ICRS"), ("RAJ2000", "DEJ2000"), ("RA", "DEC"), ("ra", "dec")),
    "remainder": (("RA_row", "Dec_row"), ("RA", "Dec"), ("RA", "DEC"), ("ra", "dec")),
    "epoch": (("ALPHAWIN_J2000", "DELTAWIN_J2000"), ("ALPHA_J2000", "DELTA_J2000"), ("X_WORLD", "Y_WORLD"), ("RA_corr", "Dec_corr"), ("RA", "DEC")),
}
# Profiles that look for each coordinate by itself.
SEPARATE: dict[str, tuple[tuple[str, ...], tuple[str, ...]]] = {
    "master": (("RA_corr", "ALPHAWIN_J2000", "ALPHA_J2000", "RA", "X_WORLD", "RAJ2000"), ("Dec_corr", "DELTAWIN_J2000", "DELTA_J2000", "DEC", "Y_WORLD", "DEJ2000")),
    "s1": (("RA_corr", "RA_CORR", "ALPHAWIN_J2000", "ALPHA_J2000", "RA", "X_WORLD", "RAJ2000", "ra", "RA_ICRS"), ("Dec_corr", "DEC_CORR", "DELTAWIN_J2000", "DELTA_J2000", "DEC", "Y_WORLD", "DEJ2000", "dec", "DE_ICRS")),
    "stage": (("ra", "RA", "RA_corr", "ALPHAWIN_J2000", "ALPHA_J2000", "RA_ICRS", "RAJ2000"), ("dec", "DEC", "Dec_corr", "DELTAWIN_J2000", "DELTA_J2000", "DE_ICRS", "DEJ2000")),
    "usno": (("ra", "RA", "RA_corr", "ALPHAWIN_J2000", "ALPHA_J2000"), ("dec", "DEC", "Dec_corr", "DELTAWIN_J2000", "DELTA_J2000")),
}
#: Names of an object's number in order, and of a row's key.
OBJECT_IDS = ("NUMBER", "number", "object_id", "objectnumber", "objID")
KEYS = ("src_id", "row_id")


class MissingColumns(ValueError):
    """No pair of a profile is among the columns."""


def resolve(columns: Sequence[str], profile: str, prefer: tuple[str, str] | None = None) -> tuple[str, str]:
    """The position's column pair; names match letter by letter. A preferred pair goes first."""
    if prefer and set(prefer) <= set(columns):
        return prefer
    if profile in SEPARATE:
        found = tuple(next((c for c in names if c in columns), None) for names in SEPARATE[profile])
        if all(found):
            return found
    else:
        for pair in PROFILES[profile]:
            if set(pair) <= set(columns):
                return pair
    raise MissingColumns(f"no position of profile {profile} among {', '.join(columns)}")


def object_id(columns: Sequence[str]) -> str | None:
    return next((c for c in OBJECT_IDS if c in columns), None)


def row_key(columns: Sequence[str]) -> str | None:
    return next((c for c in KEYS if c in columns), None)
