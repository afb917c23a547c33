"""Exports as rows of text or typed columns, and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .numbering import placed

FT_M = 0.3048
CSV = ("icao", "lat", "lon", "altitude_ft", "speed_kts", "heading_deg", "vertical_rate_fpm", "timestamp")


def csv_rows(positions: DataFrame) -> DataFrame:
    one = lambda c: F.when(F.col(c).isNotNull(), F.format_string("%.1f", F.col(c))).alias(c)
    return positions.select(*(one(c) if c in ("speed_kts", "heading_deg") else F.col(c) for c in CSV))


def export_csv(positions: DataFrame, path: str) -> None:
    csv_rows(positions).sort("timestamp").write.mode("overwrite").csv(path, header=True, nullValue="")


def export_json(positions: DataFrame, path: str) -> None:
    positions.write.mode("overwrite").json(path)


#: Positions in one part of an export.
PART_ROWS = 1024
#: What a document tells of an aircraft, and of a position.
CRAFT = ("icao", "registration", "country", "is_military", "first_seen", "last_seen")
POINT = ("lat", "lon", "altitude_ft", "speed_kts", "heading_deg", "vertical_rate_fpm", "timestamp")
#: The frame of a KML document.
KML_HEAD = (
    '<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><name>ADS-B Flight Tracks</name>'
    '<description>Exported flight tracks</description><Style id="flightTrack"><LineStyle><color>ff0088ff</color><width>2</width></LineStyle></Style>'
)
KML_TAIL = "</Document></kml>"


def _json(value: Column) -> Column:
    return F.to_json(value, {"ignoreNullFields": "false"})


def _bare(value: Column) -> Column:
    """An array or object as JSON, without its brackets."""
    text = _json(value)
    return F.substring(text, F.lit(2), F.length(text) - 2)


def _full(aircraft: DataFrame) -> DataFrame:
    """Aircraft with all columns of ``CRAFT``, null where the table has none."""
    kinds = {"is_military": "boolean", "first_seen": "double", "last_seen": "double"}
    return aircraft.select(*(F.col(c) if c in aircraft.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in CRAFT))


def _parts(positions: DataFrame, item: Column, newest: int | None, rows: int, chronological: bool) -> DataFrame:
    """(icao, part, parts, chain, n): the items of each aircraft's newest positions, in parts of so many.

    Places are exact, so a part is full but the last one, and which is first and last is known without a look at others.
    """
    at = placed(positions.select("icao", "timestamp", "id", item.alias("p")), ["icao"], [F.col("timestamp").desc(), F.col("id").desc()])
    n = F.least("total", F.lit(newest)) if newest is not None else F.col("total")
    at = at.withColumn("n", n).filter("place < n")
    if chronological:
        at = at.withColumn("place", F.col("n") - 1 - F.col("place"))
    part = F.floor(F.col("place") / rows).cast("long").alias("part")
    packed = at.groupBy("icao", "n", part).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "p"))), lambda x: x["p"]).alias("chain"))
    return packed.withColumn("parts", F.ceil(F.col("n") / rows).cast("long"))


def _framed(head: Column, body: Column, tail: Column, gap: str) -> Column:
    """One part's text: the head before the first part, a gap before each other one, the tail after the last."""
    first, last = F.col("part") == 0, F.col("part") == F.col("parts") - 1
    return F.concat(F.when(first, head).otherwise(gap), body, F.when(last, tail).otherwise(""))


def nested_json(aircraft: DataFrame, positions: DataFrame, newest: int | None = 1000, rows: int = PART_ROWS) -> DataFrame:
    """(icao, last_seen, part, json): each aircraft with its newest positions, or all, newest first.

    The texts of an aircraft's parts, joined in order, are one object; an aircraft without positions has one part.
    """
    parts = _parts(positions, F.struct(*POINT), newest, rows, chronological=False)
    joined = _full(aircraft).join(parts, "icao", "left").withColumns({"part": F.coalesce("part", F.lit(0)), "parts": F.coalesce("parts", F.lit(1))})
    body = F.when(F.col("chain").isNotNull(), _bare(F.col("chain"))).otherwise("")
    head = F.concat(F.lit("{"), _bare(F.struct(*CRAFT)), F.lit(',"positions":['))
    return joined.select("icao", "last_seen", "part", _framed(head, body, F.lit("]}"), ",").alias("json"))


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def kml_fragments(positions: DataFrame, aircraft: DataFrame, newest: int | None = 1000, rows: int = PART_ROWS) -> DataFrame:
    """(icao, last_seen, part, fragment): placemarks in time order, heights in metres; aircraft without positions have none.

    The fragments of an aircraft's parts, joined in order, are its placemark.
    """
    metres = F.format_string("%.0f", F.bround(F.coalesce(F.col("altitude_ft"), F.lit(0)) * FT_M))
    point = F.concat_ws(",", F.col("lon").cast("string"), F.col("lat").cast("string"), metres)
    joined = _parts(positions, point, newest, rows, chronological=True).join(_full(aircraft), "icao", "left")
    label = F.concat(F.coalesce("registration", "icao"), F.when(F.col("country").isNotNull(), F.concat(F.lit(" ("), "country", F.lit(")"))).otherwise(""))
    style = "</name><styleUrl>#flightTrack</styleUrl><LineString><altitudeMode>absolute</altitudeMode><tessellate>1</tessellate><coordinates>"
    head = F.concat(F.lit("<Placemark><name>"), _escaped(label), F.lit(style))
    text = _framed(head, F.array_join("chain", " "), F.lit("</coordinates></LineString></Placemark>"), " ")
    return joined.select("icao", "last_seen", "part", text.alias("fragment"))


def geojson_fragments(positions: DataFrame, aircraft: DataFrame, newest: int | None = 1000, rows: int = PART_ROWS) -> DataFrame:
    """(icao, last_seen, kind, part, feature): a Point for the latest position and, for more than one, a LineString in time order.

    A Point has one part; the texts of a LineString's parts, joined in order, are its feature.
    """
    craft = ("icao", "registration", "country", "is_military")
    last = F.max_by(F.struct(*POINT), F.struct("timestamp", "id"))
    points = positions.groupBy("icao").agg(last.alias("at")).join(_full(aircraft), "icao", "left")
    about = F.struct(*craft, "at.altitude_ft", "at.speed_kts", "at.heading_deg", F.lit("position").alias("feature_type"))
    shape = F.struct(F.lit("Point").alias("type"), F.array("at.lon", "at.lat").alias("coordinates"))
    feature = _json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), about.alias("properties")))
    points = points.select("icao", "last_seen", F.lit("Point").alias("kind"), F.lit(0).cast("long").alias("part"), feature.alias("feature"))
    lines = _parts(positions, F.array("lon", "lat"), newest, rows, chronological=True).filter("n > 1").join(_full(aircraft), "icao", "left")
    head = F.lit('{"type":"Feature","geometry":{"type":"LineString","coordinates":[')
    about = F.struct(*craft, F.lit("track").alias("feature_type"), F.col("n").alias("position_count"))
    tail = F.concat(F.lit(']},"properties":'), _json(about), F.lit("}"))
    lines = lines.select("icao", "last_seen", F.lit("LineString").alias("kind"), "part", _framed(head, _bare(F.col("chain")), tail, ",").alias("feature"))
    return points.unionByName(lines)


def _whole(fragments: DataFrame, text: str, kind: Column, head: Column, gap: str, tail: Column) -> DataFrame:
    """(at, value): all lines of a document in the order of ``at``: aircraft last seen first, gaps between the fragments' own
    units, head and tail around everything. ``kind`` orders the units of one aircraft."""
    units = fragments.select("icao", "last_seen", kind.alias("kind")).distinct()
    numbers = placed(units, [], [F.col("last_seen").desc_nulls_last(), F.col("icao"), F.col("kind")], "unit", "units").drop("last_seen")
    rows = fragments.withColumn("kind", kind).join(numbers, ["icao", "kind"])
    line = F.concat(F.when((F.col("part") == 0) & (F.col("unit") > 0), gap).otherwise(""), F.col(text))
    spark = fragments.sparkSession
    at = lambda unit, part: F.struct(unit.cast("long").alias("unit"), part.cast("long").alias("part")).alias("at")
    ends = [spark.range(1).select(at(F.lit(u), F.lit(0)), e.alias("value")) for u, e in ((-1, head), (1 << 62, tail))]
    return rows.select(at(F.col("unit"), F.col("part")), line.alias("value")).unionByName(ends[0]).unionByName(ends[1])


def json_document(aircraft: DataFrame, positions: DataFrame, stats: DataFrame | None = None, newest: int | None = 1000, rows: int = PART_ROWS) -> DataFrame:
    """All lines (at, value) of one JSON document: aircraft, last seen first, with positions; and ``stats``, a table of one row."""
    said = F.lit("{}") if stats is None else stats.select(_json(F.struct("*"))).scalar()
    parts = nested_json(aircraft, positions, newest, rows)
    return _whole(parts, "json", F.lit(0), F.lit('{"aircraft":['), ",", F.concat(F.lit('],"stats":'), said, F.lit("}")))


def kml_document(positions: DataFrame, aircraft: DataFrame, newest: int | None = 1000, rows: int = PART_ROWS) -> DataFrame:
    """All lines (at, value) of one KML document."""
    return _whole(kml_fragments(positions, aircraft, newest, rows), "fragment", F.lit(0), F.lit(KML_HEAD), "", F.lit(KML_TAIL))


def geojson_document(positions: DataFrame, aircraft: DataFrame, newest: int | None = 1000, rows: int = PART_ROWS) -> DataFrame:
    """All lines (at, value) of one GeoJSON document: of each aircraft the Point, then the LineString."""
    fragments = geojson_fragments(positions, aircraft, newest, rows)
    kind = F.when(F.col("kind") == "Point", 0).otherwise(1)
    return _whole(fragments, "feature", kind, F.lit('{"type":"FeatureCollection","features":['), ",", F.lit("]}"))


def write_document(lines: DataFrame, path: str) -> None:
    """Writes a document's lines as files whose names are in order: joined in that order, with the line ends, they are the document."""
    lines.repartitionByRange("at").sortWithinPartitions("at").select("value").write.mode("overwrite").text(path)


def civil_date(epoch: Column) -> Column:
    """UTC date of epoch seconds, before 1970 too."""
    return F.date_add(F.lit("1970-01-01").cast("date"), F.floor(epoch / 86400).cast("int"))


def raw_envelopes(positions: DataFrame, layer: str, source: str) -> DataFrame:
    """(layer, dt, value): versioned envelopes with nulls written out."""
    geom = F.struct("lat", "lon", (F.col("altitude_ft") * FT_M).alias("elev_m"))
    doc = F.struct(
        F.lit(layer).alias("layer"), F.lit("1.0").alias("schema_version"), F.col("timestamp").alias("observed_at"), geom.alias("geom"),
        F.struct(*positions.columns).alias("payload"), F.struct(F.lit(source).alias("source"), F.col("timestamp").alias("as_of")).alias("provenance"),
    )
    return positions.select(F.lit(layer).alias("layer"), civil_date(F.col("timestamp")).alias("dt"), F.to_json(doc, {"ignoreNullFields": "false"}).alias("value"))


def write_raw_ndjson(envelopes: DataFrame, path: str) -> None:
    envelopes.write.mode("append").partitionBy("layer", "dt").text(path)
