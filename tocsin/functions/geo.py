"""Distances, bearings and grid cells as column expressions."""
from pyspark.sql import Column, functions as F

EARTH_KM = 6371.0
EARTH_NM = 3440.065
KM_PER_DEGREE = 111.0


def haversine(lat1, lon1, lat2, lon2, radius=EARTH_KM) -> Column:
    a = (F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2)
         + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2))
    return 2 * radius * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def flat_km(lat1, lon1, lat2, lon2) -> Column:
    """Flat-earth distance, good to a few percent within a grid cell; the shorter way round."""
    dx = turn(lon2, lon1) * F.cos(F.radians((lat1 + lat2) / 2))
    return KM_PER_DEGREE * F.sqrt(F.pow(lat2 - lat1, 2) + F.pow(dx, 2))


def bearing(lat1, lon1, lat2, lon2) -> Column:
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = (F.cos(F.radians(lat1)) * F.sin(F.radians(lat2))
         - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon))
    return F.pmod(F.degrees(F.atan2(y, x)) + 360, F.lit(360.0))


def turn(track, previous) -> Column:
    """Signed heading change wrapped to -180..180."""
    return F.pmod(track - previous + 540, F.lit(360.0)) - 180


def fine_cell(x, size=0.01) -> Column:
    """Nearest-centre cell id (half to even, as the archive grids use)."""
    return F.bround(x / size, 0).cast("int")


def cell(x, size) -> Column:
    return F.floor(x / size).cast("int")


def ring_cell(lon, size, step=0) -> Column:
    """Cell of a longitude on the closed ring of cells, or the one `step` cells on."""
    return F.pmod(cell(lon, size) + step, F.lit(round(360 / size)))


def in_box(lat, lon, lat_min, lat_max, lon_min, lon_max) -> Column:
    return lat.between(lat_min, lat_max) & lon.between(lon_min, lon_max)


def month_bit(day) -> Column:
    return F.expr(f"shiftleft(1, month({day}) - 1)") if isinstance(day, str) else F.pow(F.lit(2), F.month(day) - 1).cast("int")


def side(lat1, lon1, lat2, lon2, lat, lon) -> Column:
    """Positive on one side of the line through two places, negative on the other."""
    return (lon2 - lon1) * (lat - lat1) - (lat2 - lat1) * (lon - lon1)
