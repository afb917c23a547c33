"""Plans do costly steps once a row."""

from pyspark.sql import functions as F

from skyframe.functions import modes
from skyframe.plans import registry


def plan(df):
    text = df._jdf.queryExecution().toString()
    return text[text.index("== Physical Plan") :]


def test_documents_are_parsed_once_a_row(spark):
    # three parses for each of the two halves
    assert plan(registry.queries()["v5_get_vessels"](spark, "/root/testdata/sf0.001")).count("from_json") <= 6


def test_parity_by_shares_of_digits(spark):
    def remainder(data):
        value = int(data, 16) << 24
        for k in range(value.bit_length() - 1, 23, -1):
            if value >> k & 1:
                value ^= modes.GENERATOR << (k - 24)
        return value

    data = ["8D4840D6202CC371C32CE0", "0" * 22, "F" * 22, "2000171B", "5D4840D6", "8D48"]
    rows = modes.with_data_crc(spark.createDataFrame([(x,) for x in data], "data string"), "data", "crc")
    assert {r.data: r.crc for r in rows.collect()} == {x: remainder(x) if len(x) in (8, 22) else None for x in data}
    assert "aggregate(" not in plan(modes.repair_frames(spark.createDataFrame([("8D4840D6202CC371C32CE0576098",)], "hex string").withColumn("seq", F.lit(1))))
