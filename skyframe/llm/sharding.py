"""Sharding by sampled splitters.

Records are ordered by a key, the 64-bit hash of their text, so that equal texts come together. A sample in which a
record's chance follows its size gives the quantiles of the key at which ``RANGES`` ranges of about equal size meet.
The ranges are then measured. A key that alone holds more than a range's share of bytes or of rows overfills its
range and is subdivided by a hash of the id; other keys are never split. Any other range above its share, or of more
than ``CELL_ROWS`` rows, is subdivided into equal intervals of the key. The parts in key order are dealt to the shards
by running size, so a shard differs from its share by less than two of them.

The only rows that the driver sees are the ``RANGES`` - 1 splitters. Row numbers are taken inside the parts, whose
rows don't grow with the table, so nothing meets in one task.

Defined results: a null text counts as empty (size 1, crc32 of no bytes); null ids sort first; repeated rows get slots
of their own; an empty table gives an empty table; extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import discard, documents, stage_table

RANGES = 1024
#: Keys drawn for the splitters, on average.
SAMPLE = 200_000
#: Rows of a range from which it is subdivided, whatever its share.
CELL_ROWS = 100_000


def _splitters(records: DataFrame, total: int) -> list[int]:
    """Quantiles of the key in a sample weighted by size; draws follow a hash of the record, so reruns agree."""
    expected = F.col("size") * F.lit(SAMPLE / max(total, 1))
    uniform = F.pmod(F.xxhash64("key", "doc_id", F.lit(3)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = records.select("key", F.floor(expected + uniform).cast("int").alias("times")).filter("times > 0")
    sample = drawn.select("key", F.explode(F.sequence(F.lit(1), "times")))
    steps = F.array(*(F.lit(k / RANGES) for k in range(1, RANGES)))
    found = sample.agg(F.percentile_approx("key", steps, 20 * RANGES).alias("cuts")).first()["cuts"]
    return sorted(set(found or []))


def _range_of(key: Column, cuts: list[int]) -> Column:
    """How many splitters lie below a key, found in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    width = max(1, round(len(cuts) ** 0.5))
    groups = [cuts[k : k + width] for k in range(0, len(cuts), width)]
    heads = F.array(*(F.lit(g[0]) for g in groups))
    inner = F.array(*(F.array(*(F.lit(c) for c in g)) for g in groups))
    group = F.size(F.filter(heads, lambda c: c < key))
    within = F.size(F.filter(F.get(inner, group - 1), lambda c: c < key))
    return F.when(group == 0, 0).otherwise((group - 1) * width + within)


def shard(docs: DataFrame, shards: int = 8, text: str = "text") -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard): shards of near equal size in bytes."""
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    records = docs.select("doc_id", (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("key"))
    records = stage_table(records, "records")
    sums = records.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.count("*").alias("rows")).first()
    cuts = _splitters(records, sums["bytes"])

    share_bytes, share_rows = max(1, sums["bytes"] // RANGES), max(1, sums["rows"] // RANGES)
    by_key = records.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    parts = F.greatest(F.ceil(F.col("bytes") / share_bytes), F.ceil(F.col("rows") / share_rows)).cast("int")
    # at most RANGES keys hold more than a share of the bytes and as many more than a share of the rows
    heavy = by_key.filter((F.col("bytes") > share_bytes) | (F.col("rows") > share_rows)).filter("rows > 1").select("key", parts.alias("parts"))
    ranged = records.withColumn("range", _range_of(F.col("key"), cuts)).join(F.broadcast(heavy), "key", "left")
    light = ranged.filter("parts IS NULL").groupBy("range").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
    most_rows = min(share_rows, CELL_ROWS)
    many = F.greatest(F.ceil(F.col("bytes") / share_bytes), F.ceil(F.col("rows") / most_rows))
    light = light.filter((F.col("bytes") > share_bytes) | (F.col("rows") > most_rows)).select("range", "lo", "hi", many.cast("int").alias("intervals"))
    ranged = ranged.join(F.broadcast(light), "range", "left")  # RANGES rows at most
    place = (F.col("key").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double") + 1)
    interval = F.coalesce(F.least(F.floor(place * F.col("intervals")), F.col("intervals") - 1), F.lit(0))
    sub = F.when(F.col("parts").isNotNull(), 1 + F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("parts"))).otherwise(interval).cast("int")
    ranged = ranged.withColumn("heavy", F.when(F.col("parts").isNotNull(), F.col("key"))).withColumn("sub", sub)
    ranged = stage_table(ranged.drop("parts", "lo", "hi", "intervals"), "ranged")
    discard(records)

    cell = ["range", "heavy", "sub"]
    cells = ranged.groupBy(*cell).agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    before = Window.orderBy(F.col("range"), F.col("heavy").asc_nulls_first(), F.col("sub"))
    middle = F.sum("bytes").over(before) - F.col("bytes") / 2
    placed = cells.withColumn("shard", F.least(F.floor(middle * shards / max(1, sums["bytes"])), F.lit(shards - 1)).cast("int"))
    within = Window.partitionBy("shard").orderBy(F.col("range"), F.col("heavy").asc_nulls_first(), F.col("sub"))
    placed = placed.withColumn("first", F.sum("rows").over(within) - F.col("rows")).select(*cell, "shard", "first")

    same = [ranged[c].eqNullSafe(placed[c]) for c in cell]
    rank = F.row_number().over(Window.partitionBy(*(ranged[c] for c in cell)).orderBy("key", "doc_id"))
    joined = ranged.join(F.broadcast(placed), same)  # a few times RANGES, or a row for each CELL_ROWS
    return joined.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("first") + rank - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(documents(spark, sf_dir), 8)


QUERIES = {"op3_sharding": op3_sharding}
ORACLE: dict[str, str] = {}
