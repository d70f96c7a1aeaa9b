"""Robust lines of whole batches are those of one track at a time, and a track costs far less."""

import time

import numpy as np
import pytest

from tidemark.operators import kernels as K


@pytest.mark.parametrize("how", [{}, {"degree": 2, "trials": 30}, {"share": 0.2, "seed": 7}])
def test_batches_equal_single_tracks(how):
    random = np.random.RandomState(3)
    tracks = []
    for k in range(300):
        n = int(random.choice([1, 2, 3, 9, 40, 64]))
        x = np.arange(n, dtype=float) + (5 if k % 3 == 0 else 0)
        x = np.sort(random.rand(n) * 100) if k % 7 == 0 else np.zeros(n) if k % 31 == 0 else x
        y = random.randn(n) * (k % 5) + 0.3 * x + (random.rand(n) < 0.2) * 50
        tracks.append((x, np.full(n, 4.0) if k % 11 == 0 else y))
    got = K.robust_baselines(np.concatenate([x for x, _ in tracks]), np.concatenate([y for _, y in tracks]), np.array([len(x) for x, _ in tracks]), **how)
    assert got == pytest.approx(np.concatenate([K.robust_line(x, y, **how) for x, y in tracks]), abs=1e-7)


def test_cost_of_a_track():
    random = np.random.RandomState(4)
    y = random.randn(2000, 64) * 100
    began = time.process_time()
    K.robust_baselines(np.tile(np.arange(64.0), 2000), y.ravel(), np.full(2000, 64))
    assert time.process_time() - began < 2
