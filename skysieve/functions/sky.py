"""Spherical geometry as Column expressions. Angles are degrees, separations arcseconds unless a name says otherwise."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ARCSEC = 3600.0
#: Fixed value: arcseconds of a radian as the compatible separations round it.
RADIAN_ARCSEC = 206264.806


def col(x: Column | str | float) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(float(x))


def finite(*xs: Column | str) -> Column:
    """True where every value is a number other than NaN and the infinities (null: false)."""
    out = F.lit(True)
    for x in map(col, xs):
        out = out & x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(out, F.lit(False))


def wrap360(ra: Column | str) -> Column:
    return F.pmod(col(ra), F.lit(360.0))


def wrap180(angle: Column | str) -> Column:
    """[-180, 180) by two remainders, rounded step by step as the SQL of the queries states it, so that near ties fall alike."""
    return ((col(angle) + 180.0) % 360.0 + 360.0) % 360.0 - 180.0


def sanitize(ra: Column | str, dec: Column | str) -> tuple[Column, Column]:
    """RA wrapped to [0, 360), Dec clipped to the poles."""
    return wrap360(ra), F.greatest(F.lit(-90.0), F.least(F.lit(90.0), col(dec)))


def haversine(ra1, dec1, ra2, dec2) -> Column:
    ra1, dec1, ra2, dec2 = (F.radians(col(x)) for x in (ra1, dec1, ra2, dec2))
    u, v = F.sin((dec2 - dec1) / 2.0), F.sin((ra2 - ra1) / 2.0)
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), u * u + F.cos(dec1) * F.cos(dec2) * (v * v)))


def sep_arcsec(ra1, dec1, ra2, dec2) -> Column:
    """The canonical separation: clamped haversine."""
    return F.degrees(2.0 * F.asin(F.sqrt(haversine(ra1, dec1, ra2, dec2)))) * ARCSEC


def sep_rounded_constant(ra1, dec1, ra2, dec2) -> Column:
    """Haversine times the six-figure constant, kept for comparison with older tables."""
    return 2.0 * F.asin(F.sqrt(haversine(ra1, dec1, ra2, dec2))) * RADIAN_ARCSEC


def sep_cosines(ra1, dec1, ra2, dec2) -> Column:
    """Law of cosines, clamped; inaccurate below an arcsecond."""
    ra1, dec1, ra2, dec2 = (F.radians(col(x)) for x in (ra1, dec1, ra2, dec2))
    c = F.sin(dec1) * F.sin(dec2) + F.cos(dec1) * F.cos(dec2) * F.cos(ra1 - ra2)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), c)))) * ARCSEC


def sep_degrees(ra1, dec1, ra2, dec2) -> Column:
    """Degrees by the atan2 form."""
    a = haversine(ra1, dec1, ra2, dec2)
    return F.degrees(2.0 * F.atan2(F.sqrt(a), F.sqrt(1.0 - a)))


def sep_planar(ra1, dec1, ra2, dec2, median_dec2) -> Column:
    """Flat separation with the cosine of the mean of dec1 and the object list's median declination."""
    scale = F.cos(F.radians((col(dec1) + col(median_dec2)) / 2.0))
    return F.hypot(F.radians(wrap180(col(ra2) - col(ra1)) * scale), F.radians(col(dec2) - col(dec1))) * F.lit(180.0 / math.pi * ARCSEC)


def residual_arcsec(ra1, dec1, ra2, dec2) -> Column:
    """hypot(dRA cos Dec, dDec) without a wrap."""
    return F.hypot((col(ra2) - col(ra1)) * F.cos(F.radians(col(dec1))), col(dec2) - col(dec1)) * ARCSEC


def unit_xyz(ra, dec) -> tuple[Column, Column, Column]:
    ra, dec = F.radians(col(ra)), F.radians(col(dec))
    return F.cos(dec) * F.cos(ra), F.cos(dec) * F.sin(ra), F.sin(dec)


def chord(arcsec: float) -> float:
    """Chord length on the unit sphere."""
    return 2.0 * math.sin(math.radians(arcsec / ARCSEC) / 2.0)


def sky_bins_index(ra, dec, step: float = 5.0) -> tuple[Column, Column]:
    """Bin numbers from 0: floor(RA / step), floor((Dec + 90) / step)."""
    return F.floor(wrap360(ra) / step).cast("int"), F.floor((col(dec) + 90.0) / step).cast("int")


def sky_bins_degree(ra, dec, step: int = 5) -> tuple[Column, Column]:
    """Bin edges in degrees as text, %03d and a signed two-digit declination."""
    r, d = (F.floor(wrap360(ra) / float(step)) * step).cast("int"), (F.floor(col(dec) / float(step)) * step).cast("int")
    return F.format_string("%03d", r), F.format_string("%+03d", d)


def grid_cell(x: Column | str, tol: float, half: str = "even") -> Column:
    """Cell number round(x / tol): `even` rounds halves to even, `away` away from zero."""
    return (F.rint(col(x) / tol) if half == "even" else F.round(col(x) / tol)).cast("long")


def field_bucket(ra, dec, plate, step_arcmin: float = 60.0) -> Column:
    """Field id: declination band, RA step widened by 1 / cos(Dec), and the plate."""
    step = step_arcmin / 60.0
    cosine = F.greatest(F.lit(1e-4), F.least(F.lit(1.0), F.cos(F.radians(col(dec)))))
    d, r = F.floor((col(dec) + 90.0) / step), F.floor(wrap360(ra) / (F.lit(step) / cosine))
    return F.concat(d.cast("string"), F.lit("_"), r.cast("string"), F.lit("__"), F.coalesce(col(plate).cast("string"), F.lit("None")))


def gnomonic(ra, dec, ra0, dec0) -> tuple[Column, Column]:
    """Standard coordinates (xi, eta) in arcseconds; null on the horizon."""
    dra = F.radians(wrap180(col(ra) - col(ra0)))
    d, d0 = F.radians(col(dec)), F.radians(col(dec0))
    depth = F.sin(d0) * F.sin(d) + F.cos(d0) * F.cos(d) * F.cos(dra)
    depth = F.when(F.abs(depth) >= 1e-12, depth)
    scale = F.lit(180.0 / math.pi * ARCSEC)
    return F.cos(d) * F.sin(dra) / depth * scale, (F.cos(d0) * F.sin(d) - F.sin(d0) * F.cos(d) * F.cos(dra)) / depth * scale


def gnomonic_inverse(xi, eta, ra0, dec0) -> tuple[Column, Column]:
    """(RA, Dec) of standard coordinates in degrees: pixel to world of a tangent-plane image."""
    x, y, d0 = F.radians(col(xi)), F.radians(col(eta)), F.radians(col(dec0))
    rho = F.hypot(x, y)
    c = F.atan(rho)
    dec = F.when(rho > 0, F.asin(F.cos(c) * F.sin(d0) + y * F.sin(c) * F.cos(d0) / rho)).otherwise(d0)
    ra = F.when(rho > 0, F.degrees(F.atan2(x * F.sin(c), rho * F.cos(d0) * F.cos(c) - y * F.sin(d0) * F.sin(c)))).otherwise(F.lit(0.0))
    return wrap360(col(ra0) + ra), F.degrees(dec)


def tan_pixel_to_world(x, y, crpix1, crpix2, crval1, crval2, cd11, cd12, cd21, cd22) -> tuple[Column, Column]:
    """Pixel to sky by a CD matrix."""
    dx, dy = col(x) - col(crpix1), col(y) - col(crpix2)
    return gnomonic_inverse(col(cd11) * dx + col(cd12) * dy, col(cd21) * dx + col(cd22) * dy, crval1, crval2)


def cd_from_cdelt(cdelt1, cdelt2, crota2) -> tuple[Column, Column, Column, Column]:
    t = F.radians(col(crota2))
    return col(cdelt1) * F.cos(t), -col(cdelt2) * F.sin(t), col(cdelt1) * F.sin(t), col(cdelt2) * F.cos(t)


def footprint_half_sizes(nx, ny, cd11, cd12, cd21, cd22) -> tuple[Column, Column, Column]:
    """Half width, half height in degrees and mean pixel scale in arcseconds from a CD matrix."""
    sx, sy = F.hypot(col(cd11), col(cd21)), F.hypot(col(cd12), col(cd22))
    return sx * col(nx) / 2.0, sy * col(ny) / 2.0, (sx + sy) / 2.0 * ARCSEC


def plate_pixels(ra, dec, ra0, dec0, nx, ny, arcsec_x, arcsec_y, flip_x: bool = True, flip_y: bool = False) -> tuple[Column, Column]:
    """Plate pixel of a position; East grows to larger x unless `flip_x` mirrors it about the centre."""
    xi, eta = gnomonic(ra, dec, ra0, dec0)
    dx, dy = xi / col(arcsec_x), eta / col(arcsec_y)
    return col(nx) / 2.0 + (-dx if flip_x else dx), col(ny) / 2.0 + (-dy if flip_y else dy)


def orientation(ra0, dec0, nx, ny, arcsec_x, arcsec_y) -> tuple[Column, Column]:
    """(flip_x, flip_y): whether East would lie right of the centre, and North below it."""
    eps = 5.0 / ARCSEC
    east = plate_pixels(col(ra0) + eps, dec0, ra0, dec0, nx, ny, arcsec_x, arcsec_y, False, False)[0]
    north = plate_pixels(ra0, col(dec0) + eps, ra0, dec0, nx, ny, arcsec_x, arcsec_y, False, False)[1]
    return east > col(nx) / 2.0, north < col(ny) / 2.0


def arcsec_per_pixel(plate_scale, pixel_um) -> Column:
    return col(plate_scale) * (col(pixel_um) / 1000.0)


def signed_edge_distance(x, y, nx, ny) -> Column:
    """Distance of a pixel to the nearest plate edge, negative outside."""
    x, y, nx, ny = map(col, (x, y, nx, ny))
    inside = F.least(x - 1.0, nx - x, y - 1.0, ny - y)
    beyond = -F.least(F.abs(x - 1.0), F.abs(nx - x), F.abs(y - 1.0), F.abs(ny - y))
    known = x.isNotNull() & y.isNotNull()  # least() would pass over a null
    return F.when(known, F.when((x < 1.0) | (x > nx) | (y < 1.0) | (y > ny), beyond).otherwise(inside))


def edge_class_px(distance, nx, ny, least_px: float = 200.0, least_share: float = 0.02) -> Column:
    d = col(distance)
    core = F.greatest(F.lit(least_px), F.lit(least_share) * F.least(col(nx), col(ny)))
    return F.when(d.isNull() | F.isnan(d), "off_plate").when(d < 0, "edge_touch").when(d >= core, "core").otherwise("near_edge")


def edge_class_arcsec(distance, least: float = 60.0) -> Column:
    d = col(distance)
    return F.when(d.isNull() | F.isnan(d), "off_plate").when(d < 0, "edge_touch").when(d >= least, "core").otherwise("near_edge")


def is_core(class_px, class_arcsec) -> Column:
    return (F.lower(F.coalesce(col(class_px), F.lit(""))) == "core") | (F.lower(F.coalesce(col(class_arcsec), F.lit(""))) == "core")


def overlap_fraction(ra1, dec1, ra2, dec2, size_deg: float) -> Column:
    """Shared area of two equal square tiles over one tile's area."""
    w = F.greatest(F.lit(0.0), F.lit(size_deg) - F.abs(wrap180(col(ra1) - col(ra2))) * F.cos(F.radians((col(dec1) + col(dec2)) / 2.0)))
    h = F.greatest(F.lit(0.0), F.lit(size_deg) - F.abs(col(dec1) - col(dec2)))
    return w * h / (size_deg * size_deg)


def in_box(ra, dec, ra_min: float, ra_max: float, dec_min: float, dec_max: float) -> Column:
    """Bounding box; ra_min > ra_max means a box across RA 0."""
    r = wrap360(ra)
    inside = r.between(ra_min, ra_max) if ra_min <= ra_max else (r >= ra_min) | (r <= ra_max)
    return inside & col(dec).between(dec_min, dec_max)


def in_footprint(ra, dec, ra0, dec0, half_w, half_h) -> Column:
    cosine = F.greatest(F.lit(1e-6), F.cos(F.radians(col(dec0))))
    return (F.abs(wrap180(col(ra) - col(ra0))) * cosine <= col(half_w)) & (F.abs(col(dec) - col(dec0)) <= col(half_h))


def backpropagate(ra, dec, pm_ra_mas, pm_dec_mas, epoch: float = 1950.0, reference: float = 2016.0) -> tuple[Column, Column]:
    """Position at another epoch: tangent-plane motion with pm_ra including cos(Dec); null motions count as 0."""
    years = epoch - reference
    xi, eta = (F.coalesce(col(p), F.lit(0.0)) * years / 1000.0 / ARCSEC for p in (pm_ra_mas, pm_dec_mas))
    return gnomonic_inverse(xi, eta, ra, dec)


def maps_ra(seconds_x1000) -> Column:
    return col(seconds_x1000).cast("double") / 1000.0 / 240.0


def maps_dec(arcsec_x1000) -> Column:
    return col(arcsec_x1000).cast("double") / 1000.0 / 3600.0


def poly_features(x, y, degree: int) -> list[Column]:
    x, y = col(x), col(y)
    return [F.lit(1.0), x, y] + ([x * x, x * y, y * y] if degree > 1 else [])


def poly_value(x, y, coefficients: Column, degree: int) -> Column:
    """Polynomial of an array column of coefficients."""
    out = F.lit(0.0)
    for k, f in enumerate(poly_features(x, y, degree)):
        out = out + coefficients[k] * f
    return out


# Rotation from B1950 to J2000, row by row, and the E-terms of aberration (radians x 1e-6).
ROTATION = (
    (0.9999256782, -0.0111820611, -0.0048579477),
    (0.0111820610, 0.9999374784, -0.0000271765),
    (0.0048579479, -0.0000271474, 0.9999881997),
)
E_TERMS = (-1.62557e-6, -0.31919e-6, -0.13843e-6)


def b1950_to_icrs(ra, dec) -> tuple[Column, Column]:
    """FK4 B1950 to J2000/ICRS by removal of the E-terms and rotation."""
    r = unit_xyz(ra, dec)
    dot = sum((r[k] * E_TERMS[k] for k in range(1, 3)), r[0] * E_TERMS[0])
    q = [r[k] - E_TERMS[k] + dot * r[k] for k in range(3)]
    x, y, z = (q[0] * m[0] + q[1] * m[1] + q[2] * m[2] for m in ROTATION)
    return wrap360(F.degrees(F.atan2(y, x))), F.degrees(F.atan2(z, F.hypot(x, y)))


def interleave(x: Column, y: Column) -> Column:
    """Bits of x at even places and of y at odd ones: binary digits read in base four. Each side is named once, so plans stay small."""
    spread = lambda v: F.conv(F.bin(v.cast("long")), 4, 10).cast("long")
    return spread(x) + 2 * spread(y)


def every_second_bit(bits: Column) -> Column:
    """The bits at even places, side by side."""
    even = bits.cast("long").bitwiseAND(0x5555555555555555)
    return F.conv(F.conv(even.cast("string"), 10, 4), 2, 10).cast("long")


def healpix_face(ra, dec, order: int) -> tuple[Column, Column, Column]:
    """(face, x, y): base face and real coordinates within it, 0 to 2^order each, x to the north-east and y to the north-west."""
    n = 1 << order
    z, tt = F.sin(F.radians(col(dec))), wrap360(ra) / 90.0
    za = F.abs(z)
    rise, fall = n * (0.5 + tt) - n * z * 0.75, n * (0.5 + tt) + n * z * 0.75
    ifp, ifm = F.floor(F.floor(rise) / n), F.floor(F.floor(fall) / n)
    face_eq = F.when(ifp == ifm, F.pmod(ifp, F.lit(4)) + 4).when(ifp < ifm, F.pmod(ifp, F.lit(4))).otherwise(F.pmod(ifm, F.lit(4)) + 8)
    ntt = F.least(F.lit(3), F.floor(tt))
    tp, tmp = tt - ntt, n * F.sqrt(F.greatest(F.lit(0.0), 3.0 * (1.0 - za)))
    polar, north = za > 2.0 / 3.0, z >= 0
    face = F.when(~polar, face_eq).when(north, ntt).otherwise(ntt + 8).cast("long")
    x = F.when(~polar, F.pmod(fall, F.lit(float(n)))).when(north, n - (1.0 - tp) * tmp).otherwise(tp * tmp)
    y = F.when(~polar, n - F.pmod(rise, F.lit(float(n)))).when(north, n - tp * tmp).otherwise((1.0 - tp) * tmp)
    inside = lambda v: F.greatest(F.lit(0.0), F.least(F.lit(float(n)), v))
    return face, inside(x), inside(y)


def healpix_centre(pixel: Column, order: int) -> tuple[Column, Column]:
    """(RA, Dec) of a nested pixel's centre."""
    n = 1 << order
    face, inner = F.shiftright(pixel, 2 * order), pixel.bitwiseAND((1 << (2 * order)) - 1)
    x, y = every_second_bit(inner), every_second_bit(F.shiftright(inner, 1))
    ring, lane = F.floor(face / 4), F.pmod(face, F.lit(4))
    down = (ring + 2) * n - x - y - 1  # rows of centres from the north pole, 1 to 4 n - 1
    across = 2 * lane + F.when(ring == 1, 0).otherwise(1)
    wide = F.when(down < n, down).when(down > 3 * n, 4 * n - down).otherwise(F.lit(n))
    z = F.when(down < n, 1.0 - down * down / (3.0 * n * n)).when(down > 3 * n, (4 * n - down) * (4 * n - down) / (3.0 * n * n) - 1.0).otherwise((2 * n - down) * 2.0 / (3.0 * n))
    # by the pole distance, which the arc sine of z would lose near the poles
    colatitude = F.degrees(2.0 * F.asin(wide / (math.sqrt(6.0) * n)))
    dec = F.when(down < n, 90.0 - colatitude).when(down > 3 * n, colatitude - 90.0).otherwise(F.degrees(F.asin(z)))
    return wrap360((across * wide + x - y) * 45.0 / wide), dec


def healpix_reach(order: int) -> float:
    """Degrees from a pixel's centre to its farthest point, at most: that of the pixels at the edge of the polar caps."""
    n = 1 << order
    z, top = 2.0 / 3.0, 1.0 - (1.0 - 1.0 / n) ** 2 / 3.0
    step = math.pi / (4.0 * n)
    a, b = (math.sqrt(1 - z * z) * math.cos(step), math.sqrt(1 - z * z) * math.sin(step), z), (math.sqrt(1 - top * top), 0.0, top)
    return math.degrees(2.0 * math.asin(min(1.0, math.dist(a, b) / 2.0))) * (1 + 1e-9) + 1e-9


def healpix_nested(ra, dec, order: int = 5) -> Column:
    """Nested HEALPix pixel: face and in-face (x, y) by the cylindrical equal-area formulas, bits interleaved."""
    n = 1 << order
    z, tt = F.sin(F.radians(col(dec))), wrap360(ra) / 90.0
    za = F.abs(z)
    jp, jm = F.floor(n * (0.5 + tt) - n * z * 0.75), F.floor(n * (0.5 + tt) + n * z * 0.75)
    ifp, ifm = F.floor(jp / n), F.floor(jm / n)
    face_eq = F.when(ifp == ifm, F.pmod(ifp, F.lit(4)) + 4).when(ifp < ifm, F.pmod(ifp, F.lit(4))).otherwise(F.pmod(ifm, F.lit(4)) + 8)
    x_eq, y_eq = F.pmod(jm, F.lit(n)), F.lit(n - 1) - F.pmod(jp, F.lit(n))
    ntt = F.least(F.lit(3), F.floor(tt))
    tp, tmp = tt - ntt, n * F.sqrt(3.0 * (1.0 - za))
    a, b = F.least(F.lit(n - 1), F.floor(tp * tmp)), F.least(F.lit(n - 1), F.floor((1.0 - tp) * tmp))
    polar = za > 2.0 / 3.0
    north = z >= 0
    face = F.when(~polar, face_eq).when(north, ntt).otherwise(ntt + 8).cast("long")
    x = F.when(~polar, x_eq).when(north, F.lit(n - 1) - b).otherwise(a).cast("long")
    y = F.when(~polar, y_eq).when(north, F.lit(n - 1) - a).otherwise(b).cast("long")
    return face * (n * n) + interleave(x, y)
