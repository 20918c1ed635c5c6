import pyarrow as pa
import pytest

from wattspark.llm.common import BATCH_ROWS, small_batches, tidy

KEY = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("before, after", [("10000", BATCH_ROWS), ("0", BATCH_ROWS), ("-1", BATCH_ROWS), ("100", 100)])
def test_small_batches_bounds_and_never_raises(spark, before, after):
    old = spark.conf.get(KEY)
    try:
        spark.conf.set(KEY, before)
        small_batches(spark)
        assert int(spark.conf.get(KEY)) == after
    finally:
        spark.conf.set(KEY, old)


def test_tidy_tasks_return_all_rows(spark):
    def twice(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([2 * x for x in batch.column(0).to_pylist()], pa.int64())], ["id"])

    rows = spark.range(0, 1000, 1, 3)
    assert sorted(r.id for r in rows.mapInArrow(tidy(twice), "id long").collect()) == [2 * x for x in range(1000)]
    assert rows.limit(0).mapInArrow(tidy(twice), "id long").collect() == []


def test_tidy_passes_errors_on():
    def fails(batches):
        yield from batches
        raise ValueError("x")

    with pytest.raises(ValueError):
        list(tidy(fails)(iter([1])))
