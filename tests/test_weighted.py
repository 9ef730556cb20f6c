"""Distances with parameters against golden values and numpy."""

import numpy as np
import pytest

from simplexa.functions.distances import weighted_distance


def test_weighted(spark):
    x, y = [1.0, 2.0, 0.0, 4.0], [0.0, 2.0, 3.0, 1.0]
    df = spark.createDataFrame([(x, y)], "a array<double>, b array<double>")
    m = np.random.default_rng(1).random((4, 4))
    m = m @ m.T
    d = np.subtract(x, y)
    got = df.select(
        weighted_distance("seuclidean", "a", "b", [1, 2, 3, 4]),
        weighted_distance("wminkowski", "a", "b", [1, 2, 3, 4]),
        weighted_distance("mahalanobis", "a", "b", m.tolist()),
        weighted_distance("mahalanobis", "a", "a", m.tolist()),
    ).first()
    assert list(got) == pytest.approx([2.5, 8.0, float(np.sqrt(d @ m @ d)), 0.0], abs=1e-9)
    with pytest.raises(ValueError, match="unknown"):
        weighted_distance("nonsense", "a", "b", [])
