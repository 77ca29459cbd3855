"""A copy of the readings along a space-filling curve, for lookups in a box.

Latitude and longitude are cut into 65,536 cells each and their bits interleaved: readings near each other on the map
are near each other in ``place``, so a file or row group spans a small range of both coordinates. (In plain order by
latitude it spans all longitudes, and only the latitude of a box skips anything.) A lookup turns its box into a few ranges
of ``place``, which reach the Parquet reader as comparisons of integers, and tests the coordinates exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aneroid.operators.filters import in_box

PLACE = "place"
BITS = 16
LAST_CELL = 2**BITS - 1
RANGES = 32  # of place in one lookup; fewer ones take in more of the surroundings

# The limits of the coordinates. What lies beyond is in the first or last cell.
LATITUDES, LONGITUDES = (-90.0, 90.0), (-180.0, 180.0)


def _cell(value: Column, limits: tuple[float, float]) -> Column:
    """The number of the value's cell. A larger value never has a smaller one, whatever the rounding."""
    low, high = limits
    cell = F.floor((value - low) / (high - low) * (LAST_CELL + 1)).cast("bigint")
    return F.least(F.greatest(cell, F.lit(0)), F.lit(LAST_CELL)).cast("bigint")


def _spread(cell: Column) -> Column:
    """The 16 bits of a cell, moved apart to every second bit."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        cell = cell.bitwiseOR(F.shiftleft(cell, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return cell


def place_of(lat: Column, lon: Column) -> Column:
    """Where a point lies on the curve, as BIGINT; NULL without both coordinates."""
    of_lat, of_lon = _spread(_cell(lat, LATITUDES)), _spread(_cell(lon, LONGITUDES))
    return F.when(lat.isNotNull() & lon.isNotNull(), F.shiftleft(of_lat, 1).bitwiseOR(of_lon))


def ranges(box: tuple[int, int, int, int], most: int = RANGES) -> list[tuple[int, int]]:
    """Ranges of the curve, ``most`` or fewer, that hold all cells of the box, whose edges are cells and included.

    Squares that the box cuts are quartered, the largest first, until further ones would be too many. A square that
    is still cut counts as a whole.
    """
    first_lat, last_lat, first_lon, last_lon = box
    if first_lat > last_lat or first_lon > last_lon:
        return []
    inside: list[tuple[int, int]] = []
    cut = [(0, 0, 0, BITS)]  # first cells, place of the first cell, bits of the side
    while cut:
        quarters = []
        for lat, lon, start, bits in cut:
            half = 1 << bits >> 1
            for up, right in ((0, 0), (0, 1), (1, 0), (1, 1)):
                at = lat + up * half, lon + right * half
                if at[0] > last_lat or at[0] + half <= first_lat or at[1] > last_lon or at[1] + half <= first_lon:
                    continue
                quarters.append((*at, start + (2 * up + right) * half * half, bits - 1))
        whole = [
            q for q in quarters
            if q[3] == 0 or (first_lat <= q[0] and q[0] + (1 << q[3]) - 1 <= last_lat
                             and first_lon <= q[1] and q[1] + (1 << q[3]) - 1 <= last_lon)
        ]
        found = _merged([*inside, *[(q[2], q[2] + (1 << 2 * q[3]) - 1) for q in quarters]])
        if len(found) > most:
            return _merged([*inside, *[(c[2], c[2] + (1 << 2 * c[3]) - 1) for c in cut]])
        inside = _merged([*inside, *[(q[2], q[2] + (1 << 2 * q[3]) - 1) for q in whole]])
        cut = [q for q in quarters if q not in whole]
    return inside


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    merged: list[tuple[int, int]] = []
    for first, last in sorted(spans):
        if merged and first <= merged[-1][1] + 1:
            merged[-1] = merged[-1][0], max(last, merged[-1][1])
        else:
            merged.append((first, last))
    return merged


def build_box_index(df: DataFrame, path: str, partitions: int | None = None) -> None:
    """Write the readings along the curve to a new ``path``, with ``place`` as a further column.

    The range partitioning goes on over time and id, so a place with a third of all readings is spread over many files.
    ``partitions`` sets their number (default: the session's shuffle partitions).
    """
    order = [PLACE, "timestamp", "id"]
    placed = df.withColumn(PLACE, place_of(F.col("lat"), F.col("lon")))
    ranged = placed.repartitionByRange(*order) if partitions is None else placed.repartitionByRange(partitions, *order)
    ranged.sortWithinPartitions(*order).write.mode("errorifexists").parquet(path)


def _cell_of(spark: SparkSession, corners: list[tuple[float, tuple[float, float]]]) -> list[int]:
    """Cells by the very expression that the readings were placed with: a bound and a reading round alike."""
    return list(spark.range(1).select(*[_cell(F.lit(v), limits).alias(f"c{i}") for i, (v, limits) in enumerate(corners)]).first())


def lookup_box(
    spark: SparkSession, path: str, min_lat: float | str, max_lat: float | str, min_lon: float | str, max_lon: float | str
) -> DataFrame:
    """The readings in a box, edges included, as ``in_box`` finds them. Bounds may arrive as text."""
    south, north, west, east = map(float, (min_lat, max_lat, min_lon, max_lon))
    cells = _cell_of(spark, [(south, LATITUDES), (north, LATITUDES), (west, LONGITUDES), (east, LONGITUDES)])
    near = F.lit(False)
    for first, last in ranges(tuple(cells)):
        near = near | F.col(PLACE).between(first, last)
    return in_box(spark.read.parquet(path).where(near), south, north, west, east).drop(PLACE)
