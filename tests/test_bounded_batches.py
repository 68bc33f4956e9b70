"""Arrow batches are bounded by bytes, and a page at a time is scanned."""

import pyarrow as pa
from pyspark.sql import functions as F

from quarry.operators import context as ctx


def test_arrow_batches_are_bounded_by_bytes(spark):
    import __spark_entry__ as entry
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.set(name, str(2**31 - 1))
        entry._prepare(spark)

        @F.arrow_udf("long")
        def batch_bytes(x: pa.Array) -> pa.Array:
            return pa.array([x.nbytes] * len(x), pa.int64())

        pages = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("html"))
        assert pages.select(F.max(batch_bytes("html"))).first()[0] < 8 << 20
        spark.conf.set(name, "1000000")
        entry._prepare(spark)
        assert spark.conf.get(name) == "1000000"
    finally:
        spark.conf.set(name, before)


def test_file_texts_are_kept(spark):
    """Pages keep null as null and empty as empty."""
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>a</p>")], "id long, html string")
    assert [r.t for r in rows.select("id", ctx.html_main_text("html").alias("t")).orderBy("id").collect()] == [None, "", "a"]
