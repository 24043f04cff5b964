import numpy as np
import pytest

from tests.helpers import dense
from voxelloom.operators import resample as R


def smooth_line(line, size):
    """Gaussian means of a mirrored line, read at the centres of ``size`` places."""
    n = len(line)
    sigma = max(0.0, (n / size - 1) / 2)
    r = int(4 * sigma + 0.5)
    if r:
        bell = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma**2))
        padded = np.pad(line, r, mode="reflect") if n > 1 else np.pad(line, r, mode="edge")
        line = np.array([padded[i:i + 2 * r + 1] @ bell / bell.sum() for i in range(n)])
    at = np.clip((np.arange(size) + 0.5) * n / size - 0.5, 0, n - 1)
    return np.interp(at, np.arange(n), line)


@pytest.mark.parametrize("shape", [(2, 3, 2), (4, 9, 1), (6, 9, 11), (1, 1, 1)])
def test_antialiased_matches_the_formula(frame, shapes, shape):
    a = np.random.default_rng(4).integers(0, 9, (4, 9, 11)).astype(float)
    want = a
    for axis, size in enumerate(shape):
        want = np.apply_along_axis(smooth_line, axis, want, size)
    got = dense(R.antialiased(frame(a, kind="double", name="v"), shapes(a), shape, "v"), shape, "v", dtype=np.float64)
    assert np.allclose(got, want)


def test_even_volumes_stay_even(frame, shapes):
    a = np.full((3, 8, 1), 5.0)
    got = dense(R.antialiased(frame(a, kind="double", name="v"), shapes(a), (1, 3, 1), "v"), (1, 3, 1), "v", dtype=np.float64)
    assert np.allclose(got, 5.0)
