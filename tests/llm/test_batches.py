from pyspark.sql import functions as F

from bramble.llm.common import BATCH_BYTES, BATCH_ROWS, small_batches


def sizes(df):
    def run(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([sum(len(x.as_py()) for x in b.column(0))])], ["n", "size"])

    return [(r.n, r.size) for r in df.mapInArrow(run, "n long, size long").collect()]


def test_batches_are_bounded_by_rows_and_bytes(spark):
    small_batches(spark)
    long = 3 << 20
    found = sizes(spark.range(0, 20, 1, 1).select(F.repeat(F.lit("x"), long)))
    assert sum(n for n, _ in found) == 20 and max(size for _, size in found) < BATCH_BYTES + 2 * long
    found = sizes(spark.range(0, 1300, 1, 1).select(F.lit("x")))
    assert sum(n for n, _ in found) == 1300 and max(n for n, _ in found) == BATCH_ROWS


def test_smaller_settings_stay(spark):
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": "7", "spark.sql.execution.arrow.maxBytesPerBatch": "1m"}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        small_batches(spark)
        assert {k: spark.conf.get(k) for k in keys} == keys
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
