"""Formats at their edges."""

import pytest
from pyspark.sql import functions as F

from tallyflow.functions import text as X


@pytest.mark.parametrize("kind", ["long", "decimal(38,0)"])
def test_formats(spark, kind):
    one = lambda f, *values: [r[0] for r in spark.createDataFrame([(v,) for v in values], "v long").select(f(F.col("v").cast(kind))).collect()]
    assert one(X.short_tokens, 0, 999, 1000, 1249, 1250, 9949, 9950, 999_499, 999_500, 1_250_000, 9_950_000, 999_499_999, 999_500_000, 12_000_000_000) == ["0", "999", "1k", "1.2k", "1.3k", "9.9k", "10k", "999k", "1M", "1.3M", "10M", "999M", "1B", "12B"]
    assert one(X.duration, 0, 499, 500, 59_500, 62_000, 3_723_000, None, -1) == ["0s", "0s", "1s", "1m 00s", "1m 02s", "1h 02m 03s", None, None]
    share = lambda v: X.share(v, F.lit(1000).cast(kind))
    assert one(share, 0, 1, 4, 5, 7, 500, 993, 994, 995, 999, 1000) == ["0%", "<1%", "<1%", "1%", "1%", "50%", "99%", "99%", ">99%", ">99%", "100%"]
