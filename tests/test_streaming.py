"""The streaming features equal the batch features."""

from __future__ import annotations

import numpy as np

from scoreloom.operators.basis import basis_matrix
from scoreloom.streaming.causal import causal_features


def test_stream_equals_batch(spark, tmp_path):
    x = np.random.default_rng(0).normal(size=60)
    source = str(tmp_path / "in")
    rows = [(1, t, float(v)) for t, v in enumerate(x)]
    for part in (rows[:25], rows[25:]):
        spark.createDataFrame(part, "series_id long, t long, x double").coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema("series_id long, t long, x double").parquet(source)
    q = causal_features(stream, 8).writeStream.format("memory").queryName("causal").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["t"]: r["last"] for r in spark.sql("select * from causal").collect()}
    want = basis_matrix(x, ("Last-8",))[:, 0]
    np.testing.assert_allclose([got[t] for t in range(8, 60)], want[8:])
    assert all(got[t] is None for t in range(8))
