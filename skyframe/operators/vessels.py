"""Ships: AIS documents to positions and static data, and reading them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import positions as P

POSITION_TYPES = ("PositionReport", "StandardClassBPositionReport", "ExtendedClassBPositionReport")
STATIC_TYPE = "ShipStaticData"
_INNER = "STRUCT<Latitude: DOUBLE, Longitude: DOUBLE, Sog: DOUBLE, Cog: DOUBLE, TrueHeading: DOUBLE, Name: STRING, Type: INT, ShipType: INT>"
#: A number that names the ship; text isn't taken for one.
_META = "STRUCT<MMSI: BIGINT, ShipName: STRING, latitude: DOUBLE, longitude: DOUBLE>"
SCHEMA = f"MessageType STRING, Message STRUCT<{', '.join(f'{t}: {_INNER}' for t in (*POSITION_TYPES, STATIC_TYPE))}>"


def _clean(name: Column) -> Column:
    """Without blanks around it, then without the fill characters behind it, then without blanks again."""
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), "@+$", ""), r"^\s+|\s+$", "")
    return F.when(text != "", text)


def _below(value: Column, sentinel: float) -> Column:
    return F.when(value < sentinel, value)


def parse_ais(documents: DataFrame, column: str = "value") -> DataFrame:
    """JSON documents with their fields under ``d``, ``meta``, and ``inner``, the message of the document's own type, where it has one that is read."""
    spark_case = documents.select("*", F.from_json(column, SCHEMA, {"mode": "PERMISSIVE"}).alias("d"))
    kinds = (*POSITION_TYPES, STATIC_TYPE)
    inner = F.coalesce(*(F.when(F.col("d.MessageType") == t, F.col(f"d.Message.{t}")) for t in kinds))
    meta = F.coalesce(F.col("meta1"), F.col("meta2"))
    both = spark_case.withColumns({"meta1": F.from_json(F.get_json_object(column, "$.MetaData"), _fields(_META)), "meta2": F.from_json(F.get_json_object(column, "$.Metadata"), _fields(_META))})
    rows = both.withColumns({"inner": inner, "meta": meta}).drop("meta1", "meta2")
    # filters on what is parsed can't move below the parsing and repeat it
    return rows.withColumn("__p", F.explode(F.array(F.struct("d", "inner", "meta")))).select(*documents.columns, "__p.*")


def _fields(struct: str) -> str:
    return struct[len("STRUCT<") : -1].replace(": ", " ")


def _mmsi() -> Column:
    return F.when(F.col("meta.MMSI") >= 0, F.col("meta.MMSI").cast("string"))


def _place() -> tuple[Column, Column]:
    return F.coalesce("inner.Latitude", "meta.latitude"), F.coalesce("inner.Longitude", "meta.longitude")


def _kind() -> Column:
    """What a document gives: a position, static data, or nothing (null)."""
    lat, lon = _place()
    read = F.col("inner").isNotNull() & _mmsi().isNotNull()
    placed = read & F.col("d.MessageType").isin(*POSITION_TYPES) & lat.between(-90, 90) & lon.between(-180, 180)
    return F.when(placed, "position").when(read & (F.col("d.MessageType") == STATIC_TYPE), "static")


def parse_positions(parsed: DataFrame, *keep: str) -> DataFrame:
    """(mmsi, name, lat, lon, sog, cog, heading) of position messages with a place in range; sentinels become null."""
    lat, lon = _place()
    return parsed.filter(_kind() == "position").select(
        *keep, _mmsi().alias("mmsi"), _clean(F.col("meta.ShipName")).alias("name"), lat.alias("lat"), lon.alias("lon"),
        _below(F.col("inner.Sog"), 102.3).alias("sog"), _below(F.col("inner.Cog"), 360).alias("cog"), _below(F.col("inner.TrueHeading"), 511).alias("heading"),
    )


def parse_static(parsed: DataFrame, ship_types: DataFrame, *keep: str) -> DataFrame:
    """(mmsi, name, vessel_type, flag) of static messages."""
    rows = parsed.filter(_kind() == "static")
    rows = rows.select(*keep, _mmsi().alias("mmsi"), _clean(F.col("inner.Name")).alias("name"), F.coalesce("inner.Type", "inner.ShipType").alias("code"))
    labelled = with_ship_type(rows, ship_types).withColumnRenamed("label", "vessel_type").drop("code")
    return labelled.withColumn("flag", F.lit(None).cast("string"))


def parse_updates(parsed: DataFrame, ship_types: DataFrame, *keep: str) -> DataFrame:
    """Vessel updates from static messages and from names seen on positions, in one pass."""
    static = F.col("__kind") == "static"
    name = _clean(F.when(static, F.col("inner.Name")).otherwise(F.col("meta.ShipName")))
    code = F.when(static, F.coalesce("inner.Type", "inner.ShipType"))
    rows = parsed.withColumn("__kind", _kind()).filter("__kind IS NOT NULL").select(*keep, _mmsi().alias("mmsi"), name.alias("name"), code.alias("code"), static.alias("static"))
    labelled = with_ship_type(rows.filter("static OR name IS NOT NULL").drop("static"), ship_types)
    return labelled.withColumnRenamed("label", "vessel_type").drop("code").withColumn("flag", F.lit(None).cast("string"))


def with_ship_type(rows: DataFrame, ship_types: DataFrame, code: str = "code") -> DataFrame:
    """Adds ``label`` by code: the ranges are spread to their codes (a hundred), so the join is an equality."""
    spread = ship_types.select(F.explode(F.sequence("first", "last")).alias("__code"), "label")
    joined = rows.join(F.broadcast(spread), F.col(code) == F.col("__code"), "left").drop("__code")
    return joined.withColumn("label", F.when(F.col(code).isNotNull(), F.coalesce("label", F.lit("Unknown"))))


def backfill_names(positions: DataFrame) -> DataFrame:
    """Vessel updates from names seen on positions."""
    named = positions.filter("name IS NOT NULL")
    return named.select("mmsi", "name", F.lit(None).cast("string").alias("vessel_type"), F.lit(None).cast("string").alias("flag"), "timestamp", "seq")


def in_boxes(rows: DataFrame, boxes: list[tuple[float, float, float, float]]) -> DataFrame:
    """Rows inside any of the boxes (south, west, north, east)."""
    test = F.lit(False)
    for s, w, n, e in boxes:
        test = test | (F.col("lat").between(s, n) & F.col("lon").between(w, e))
    return rows.filter(test)


def ingest_stats(parsed: DataFrame, seconds: int, time: str = "timestamp") -> DataFrame:
    """Positions, statics and dropped documents per interval, by what parsing makes of them."""
    kind = _kind()
    bucket = (F.floor(F.col(time) / seconds) * seconds).cast("double").alias("bucket")
    return parsed.groupBy(bucket).agg(F.count_if(kind == "position").alias("positions"), F.count_if(kind == "static").alias("statics"), F.count_if(kind.isNull()).alias("dropped"))


def get_vessels(vessels: DataFrame, limit: int) -> DataFrame:
    """The vessels heard from last, newest first."""
    return vessels.orderBy(F.col("last_seen").desc(), "mmsi").limit(limit)


def latest_vessel_positions(positions: DataFrame, limit: int, ties: bool = True) -> DataFrame:
    rows = P.latest_with_ties(positions, "mmsi") if ties else P.latest_per_key(positions, ["mmsi"], ("timestamp", "seq"))
    return rows.orderBy(F.col("timestamp").desc(), "mmsi").limit(limit) if ties else rows.orderBy("mmsi").limit(limit)
