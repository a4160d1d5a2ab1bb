"""Small tables for tests: whole numbers may stand where the schema says decimal."""

import re


def frame(spark, rows, schema):
    plain = re.sub(r"decimal\(38,0\)", "long", schema)
    decimals = re.findall(r"(\w+) decimal\(38,0\)", schema)
    df = spark.createDataFrame(rows, plain)
    return df.withColumns({c: df[c].cast("decimal(38,0)") for c in decimals}) if decimals else df
