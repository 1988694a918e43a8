"""Series stepped side by side, against one series at a time."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.streaming import reservoir


@pytest.mark.parametrize("beta, chaos, inputs, high", [(0.0, 0.0, 1, 1.0), (0.3, 0.1, 3, 1.0), (0.2, 0.0, 2, 1e40)])
def test_lanes(beta, chaos, inputs, high):
    own = reservoir.Reservoir(inputs, reservoir.BITS, 7, beta, chaos)
    counts = np.array([900 if high > 1 else 200, 120, 120, 33, 1])
    values = np.random.default_rng(1).uniform(-1, 1, (counts.sum(), inputs)) * high
    first = np.concatenate([[0], np.cumsum(counts)[:-1]])
    lanes = reservoir.Lanes(own, len(counts))
    lanes.run(values, first, counts)
    for k, (a, n) in enumerate(zip(first, counts, strict=True)):
        own.reset()
        settled = [t for t, v in enumerate(values[a : a + n]) if own.step(v) < reservoir.SETTLED]
        assert (own.state == lanes.state[:, k]).all() and own.shift == lanes.shift[k] and settled == lanes.settled[k]
        assert (own.words() == lanes.words(k)).all()


def test_series_over_several_buffers(spark):
    rows = spark.range(6000).select(F.when(F.col("id") < 4000, 1).when(F.col("id") < 4300, None).otherwise(F.col("id") % 9).alias("k"), "id", F.array((F.col("id") % 13).cast("double"), F.lit(0.5)).alias("f"))
    whole = sorted(map(str, reservoir.encode_series(rows, "k", "id", "f", 2, longest=None).collect()))
    assert len(whole) == 10 and sum("steps=4" in r for r in whole) >= 1
    # one series is many times what is held, others end with it or are alone in it
    for held in (700, 50):
        batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "60")
        try:
            assert sorted(map(str, reservoir.encode_series(rows, "k", "id", "f", 2, longest=None, held=held).collect())) == whole
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)


def test_series_are_stepped_in_all_tasks(spark):
    rows = spark.range(400).select((F.col("id") % 40).alias("k"), "id", F.array(F.lit(1.0)).alias("f"))
    made = reservoir.encode_series(rows, "k", "id", "f", 1).select(F.spark_partition_id().alias("task")).collect()
    assert len(made) == 40 and len({r.task for r in made}) > 1
