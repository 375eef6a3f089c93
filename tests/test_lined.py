"""Sequences side by side: the same scores and bounds, with a step for an antidiagonal of all of them."""

import numpy as np
import pytest

from foldline.operators import search


@pytest.mark.parametrize("times", [1, 60, 4000])
def test_scores_and_bounds_of_many(times):
    rng = np.random.default_rng(times)
    for turn in range(18):
        matrix = (rng.integers(-4, 8, (5, 5)) if turn % 3 else np.eye(5, dtype=int) * 4) * times
        most = 30 if turn % 2 else 90  # longer ones are brought back into 8 bits on the way
        many = [rng.integers(0, 5, rng.integers(0, most)) for _ in range(rng.integers(1, 9))]
        a, some = rng.integers(0, 5, rng.integers(0, most)), np.flatnonzero(rng.integers(0, 2, len(many)))
        lined = search.Lined(many, matrix, most)
        want = np.array([search.smith_waterman(a, b, matrix) for b in many])
        assert lined.scores(a).tolist() == want.tolist() and lined.scores(a, some).tolist() == want[some].tolist()
        bounds = search.diagonal_bounds(a, many, matrix)
        for least in (-3, 0, 1, 8, 9, 20, 40 * times, int(bounds.max()), int(bounds.max()) + 1):
            assert lined.reach(a, least).tolist() == (bounds >= least).tolist()


def test_small_cells_for_small_scores():
    """Letters of user sequences fit 8 bits, which twice as many lie side by side in."""
    many = [np.arange(90) % 5]
    assert search.Lined(many, np.eye(5, dtype=int) * 4, 90).form is np.int8
    assert search.Lined(many, np.eye(5, dtype=int) * 40, 90).form is np.int16
