"""Linear algebra must not block in a process that has started a JVM."""

import numpy as np

from tidewell.threads import one_thread


def test_inverse_after_the_engine_started(spark):
    assert spark.range(3).count() == 3
    assert one_thread() >= 0
    a = np.random.default_rng(0).random((300, 300))
    assert np.allclose(np.linalg.inv(a) @ a, np.eye(300))
