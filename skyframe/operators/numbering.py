"""Exact places of rows by distributed prefix sums, and the stored tables that they need."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, as ``spark.checkpoint.dir`` names it; where it is unset, one of this
    process's own if all tasks run in it."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what is numbered once is never numbered again by another plan or a retry."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def placed(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], place: str = "place", total: str = "total") -> DataFrame:
    """Adds ``place``, a row's number among those of its key in the given order, without gaps from 0, and ``total``, how many
    there are. No keys: places in the whole table.

    Rows are dealt to range partitions by key and order, sorted there and stored with their partition and their place in it;
    so a key with many rows is spread over many tasks. Each (key, partition) is counted, and a running sum over a key's partitions, few
    rows whatever the key, says how many rows come before. Rows that the order doesn't tell apart come in any order.
    """
    by = [F.col(k) for k in keys]
    sort = [*by, *order]
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    # the identifier is the partition's number and, in its low 33 bits, the row's number there
    at = stored(dealt.withColumn("__at", F.monotonically_increasing_id()), "placed").withColumn("__part", F.shiftright("__at", 33))
    counts = at.groupBy(*keys, "__part").agg(F.count("*").alias("__n"), F.min("__at").alias("__first"))
    parts = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    before = F.sum("__n").over(parts.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))
    sums = counts.select(
        *(F.col(k).alias(f"__key{n}") for n, k in enumerate(keys)), F.col("__part").alias("__of"), "__first",
        F.coalesce(before, F.lit(0)).alias("__before"), F.sum("__n").over(parts).alias(total),
    )
    same = F.col("__part") == F.col("__of")
    for n, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"__key{n}"))
    joined = at.join(sums, same)
    return joined.select(*rows.columns, (F.col("__at") - F.col("__first") + F.col("__before")).alias(place), total)
