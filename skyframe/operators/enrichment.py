"""Country, registration, operator and airport of positions; joins against small reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..functions.geo import haversine_expr
from ..functions.refdata import CARGO, MILITARY_CALLSIGNS, MILITARY_FIRST, MILITARY_LAST

LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"  # Fixed values: letters of registration suffixes, without I and O.


def icao_number(icao: Column) -> Column:
    """The 24-bit number of a 6-digit hexadecimal address; null for anything else."""
    return F.when(icao.rlike("^[0-9A-Fa-f]{6}$"), F.conv(icao, 16, 10).cast("long"))


def icao_text(number: Column) -> Column:
    return F.lpad(F.hex(number), 6, "0")


def lookup_country(df: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds ``country`` from the address block.

    Blocks don't overlap and there are a few hundred at most: each is cut into pieces of equal high bits, so that the
    join is an equality on the high bits with the range as a rest, not a loop over all blocks.
    """
    shift = 12
    cut = blocks.withColumn("hi", F.explode(F.sequence(F.shiftright("first", shift), F.shiftright("last", shift))))
    number = icao_number(F.col("icao"))
    rows = df.withColumns({"__n": number, "__hi": F.shiftright(number, shift)})
    joined = rows.join(F.broadcast(cut), (F.col("__hi") == F.col("hi")) & F.col("__n").between(F.col("first"), F.col("last")), "left")
    return joined.drop("__n", "__hi", "first", "last", "hi")


def military_block(icao: Column) -> Column:
    return F.coalesce(F.upper(icao).between(MILITARY_FIRST, MILITARY_LAST), F.lit(False))


def is_military(icao: Column, callsign: Column) -> Column:
    """The address is in the military block, or the callsign begins with a military prefix."""
    pattern = "^(" + "|".join(MILITARY_CALLSIGNS) + ")"
    return military_block(icao) | F.coalesce(F.upper(F.trim(callsign)).rlike(pattern), F.lit(False))


def _letter(k: Column) -> Column:
    return F.substring(F.lit(LETTERS), k.cast("int") + 1, F.lit(1))


def _suffix(rest: Column) -> Column:
    """One or two letters: each first letter stands alone, then with each second letter."""
    first, second = F.floor(rest / 25), rest % 25
    pair = F.when(second == 0, _letter(first)).otherwise(F.concat(_letter(first), _letter(second - 1)))
    return F.when(first < len(LETTERS), pair)


def n_number(icao: Column) -> Column:
    """US registration of a civil address: digits of falling weight, then letters; null outside the block."""
    number = icao_number(icao)
    offset = number - 0xA00001
    digit = lambda v: v.cast("int").cast("string")
    d1, r1 = F.floor(offset / 101711), offset % 101711
    a = r1 - 1
    d2, r2 = F.floor(a / 10111), a % 10111
    b = r2 - 1
    d3, r3 = F.floor(b / 951), b % 951
    c = r3 - 1
    d4, r4 = F.floor(c / 35), c % 35
    e = r4 - 1
    last = F.when(e < 10, digit(e)).otherwise(_letter(e - 10))
    four = F.when(r4 == 0, F.lit("")).otherwise(last)
    three = F.when(r3 == 0, F.lit("")).when(c < 350, F.concat(digit(d4), four)).otherwise(_suffix(c - 350))
    two = F.when(r2 == 0, F.lit("")).when(b < 9510, F.concat(digit(d3), three)).otherwise(_suffix(b - 9510))
    one = F.when(r1 == 0, F.lit("")).when(a < 101110, F.concat(digit(d2), two)).otherwise(_suffix(a - 101110))
    return F.when((number >= 0xA00001) & (number <= 0xADF7C7) & (d1 <= 8), F.concat(F.lit("N"), digit(d1 + 1), one))


def lookup_operator(df: DataFrame, airlines: DataFrame) -> DataFrame:
    """Adds ``operator`` by the first three letters of the callsign."""
    prefix = F.when(F.length("callsign") >= 3, F.upper(F.substring("callsign", 1, 3)))
    return df.withColumn("__prefix", prefix).join(F.broadcast(airlines), F.col("__prefix") == F.col("prefix"), "left").drop("__prefix", "prefix")


def classify_from_profile(speed: Column, altitude: Column, military: Column, callsign: Column) -> Column:
    """Category from what is seen of a flight: military, cargo, then speed bands, then altitude."""
    cargo = F.coalesce(F.upper(F.substring(callsign, 1, 3)).isin(CARGO) & (F.length(callsign) >= 3), F.lit(False))
    return (
        F.when(F.coalesce(military, F.lit(False)), "military")
        .when(cargo, "cargo")
        .when(speed > 250, "jet")
        .when((speed < 80) & (altitude < 3000), "helicopter")
        .when(speed.between(80, 180) & (altitude > 15000), "turboprop")
        .when(speed.between(80, 180), "prop")
        .when((speed > 180) & (speed <= 250), "turboprop")
        .when(altitude > 30000, "jet")
        .when(altitude < 5000, "prop")
        .otherwise("unknown")
    )


def with_airport(df: DataFrame, airports: DataFrame, max_nm: float) -> DataFrame:
    """Adds ``airport``, ``airport_name`` and ``airport_nm`` of the nearest airport strictly within max_nm; null without one.

    Airports are listed by the cells that a circle of the radius around them can reach, one row a cell; a point looks into
    its own cell only, so the join is an equality that keeps each point one row. The lists are as long as airports
    are dense. Spark broadcasts the cells while they are small and else shuffles. Of equal distances the first code wins.
    """
    height = max(max_nm / cells.DEGREE_NM, 1e-3)
    spread = airports.selectExpr("named_struct('airport', code, 'airport_name', name, 'lat', lat, 'lon', lon) AS a", f"explode({cells.around('lat', 'lon', height)}) AS c")
    listed = spread.groupBy("c.row", "c.col").agg(F.collect_list("a").alias("__near")).withColumnsRenamed({"row": "__row", "col": "__col"})
    points = df.selectExpr("*", f"{cells.row('lat', height)} AS __row").selectExpr("*", f"{cells.column('lon', '__row', height)} AS __col")
    each = f"transform(__near, a -> named_struct('airport_nm', {haversine_expr('lat', 'lon', 'a.lat', 'a.lon')}, 'airport', a.airport, 'airport_name', a.airport_name))"
    best = f"array_min(filter({each}, a -> a.airport_nm < {max_nm}D)) AS __best"
    rows = points.join(listed, ["__row", "__col"], "left").selectExpr(*(f"`{c}`" for c in df.columns), best)
    return rows.selectExpr(*(f"`{c}`" for c in df.columns), "__best.airport", "__best.airport_name", "__best.airport_nm")


def near_airports(df: DataFrame, airports: DataFrame, max_nm: float, key: str = "id") -> DataFrame:
    """(key, airport, airport_name, airport_nm): the nearest airport strictly within max_nm of each row that has one."""
    return with_airport(df.select(key, "lat", "lon"), airports, max_nm).filter("airport IS NOT NULL").select(key, "airport", "airport_name", "airport_nm")


def flight_phase(df: DataFrame, airports: DataFrame, max_nm: float = 30.0) -> DataFrame:
    """Adds airport columns and ``phase``; null where no airport is near."""
    rows = with_airport(df, airports, max_nm)
    low = (F.col("airport_nm") < 15) & (F.col("altitude_ft") < 10000)
    text = lambda form: F.format_string(form, F.col("airport"), F.col("airport_nm"))
    phase = (
        F.when(low & (F.col("vertical_rate_fpm") < -200), text("Approaching %s (%.0fnm)"))
        .when(low & (F.col("vertical_rate_fpm") > 200), text("Departing %s (%.0fnm)"))
        .when(F.col("airport_nm") < 5, text("Near %s (%.1fnm)"))
        .otherwise(text("Overflying %s (%.0fnm)"))
    )
    return rows.withColumn("phase", F.when(F.col("airport").isNotNull(), phase))


#: Degrees of latitude in a cell of the fences' grid.
FENCE_CELL = 0.5


def with_fences(df: DataFrame, fences: DataFrame) -> DataFrame:
    """Adds ``fences``, an array of (fence, fence_nm) of the fences that hold each row, nearest first, empty where none does.

    Fences are listed by the cells that their circles can reach; a point looks into its own cell.
    """
    spread = fences.selectExpr("named_struct('fence', name, 'lat', lat, 'lon', lon, 'radius_nm', radius_nm) AS f", f"explode({cells.covering('lat', 'lon', 'radius_nm', FENCE_CELL)}) AS c")
    listed = spread.groupBy("c.row", "c.col").agg(F.collect_list("f").alias("__near")).withColumnsRenamed({"row": "__row", "col": "__col"})
    points = df.selectExpr("*", f"{cells.row('lat', FENCE_CELL)} AS __row").selectExpr("*", f"{cells.column('lon', '__row', FENCE_CELL)} AS __col")
    each = f"transform(__near, f -> named_struct('fence_nm', {haversine_expr('f.lat', 'f.lon', 'lat', 'lon')}, 'fence', f.fence, 'radius_nm', f.radius_nm))"
    inside = f"transform(array_sort(filter({each}, f -> f.fence_nm <= f.radius_nm)), f -> named_struct('fence', f.fence, 'fence_nm', f.fence_nm))"
    none = "CAST(array() AS ARRAY<STRUCT<fence: STRING, fence_nm: DOUBLE>>)"
    return points.join(listed, ["__row", "__col"], "left").selectExpr(*(f"`{c}`" for c in df.columns), f"coalesce({inside}, {none}) AS fences")


def inside_fences(df: DataFrame, fences: DataFrame) -> DataFrame:
    """Rows with each fence that holds them: (columns, fence, fence_nm)."""
    return with_fences(df, fences).select(*df.columns, F.inline("fences"))
