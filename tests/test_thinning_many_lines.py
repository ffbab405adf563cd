"""Lines that fit a task are thinned many at once, without numbering the whole table."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from zonalis.operators import thinning as T


def test_many_lines_at_once_keep_what_each_keeps_alone():
    rng = np.random.default_rng(3)
    lines = [rng.integers(0, 9, (n, 2)).astype(float) for n in (1, 2, 3, 40, 5, 300, 1)]
    x, y = np.concatenate(lines).T
    starts = np.cumsum([0] + [len(p) for p in lines[:-1]])
    alone = np.concatenate([T.keep_mask(p[:, 0], p[:, 1], 1.5) for p in lines])
    assert (T.keep_masks(starts, x, y, 1.5) == alone).all()


@pytest.mark.parametrize("batch", [7, 10_000])
def test_short_lines_need_no_numbers(spark, monkeypatch, batch):
    monkeypatch.setattr(T, "distributed_row_number", lambda *a: pytest.fail("the whole table is numbered"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        points = spark.range(500).select((F.col("id") % 9).alias("line"), F.struct("id").alias("pos"), F.col("id").cast("double").alias("x"), (F.xxhash64("id") % 20).cast("double").alias("y"))
        got = {(r["line"], r["pos"]["id"]) for r in T.thinned(points, 5.0).collect()}
        want = set()
        for line, group in points.toPandas().groupby("line"):
            keep = T.keep_mask(group["x"].to_numpy(), group["y"].to_numpy(), 5.0)
            want |= {(line, int(i)) for i in group["x"][keep]}
        assert got == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
