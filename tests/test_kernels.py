import numpy as np
import pytest

from tessella.functions import kernels as K


def test_permutations():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 9):
        order = rng.permutation(n).tolist()
        assert K.lehmer_apply(list(range(n)), K.lehmer_of(order)) == order
    assert K.lehmer_of([0, 1, 2]) == []
    values = rng.integers(0, 20, 50).tolist()
    assert K.undo_move_to_front(K.move_to_front(values)) == values and K.move_to_front([3, 3, 0]) == [3, 0, 1]


def test_palette():
    explicit = np.array([[10, 20], [30, 40], [50, 60]])
    got = K.palette_colours(np.array([0, 1, 2, 3, 65, 66, 190]), explicit, 8)
    assert got[:, 0].tolist() == [10, 30, 50] and got[:, 1].tolist() == [20, 40, 60]
    assert got[:, 2].tolist() == [32, 32, 32] and got[:, 3].tolist() == [95, 32, 32]
    assert got[:, 4].tolist() == [223, 223, 223] and got[:, 5].tolist() == [0, 0, 0] and got[:, 6].tolist() == [255, 255, 255]


@pytest.mark.parametrize("k,n", [(2, 15), (4, 55), (8, 210)])
def test_upsampling(k, n):
    w = np.zeros(n)
    w[:] = 0.04  # a box over the 25 taps
    out = K.upsample(np.full((4, 5), 7.0), k, w)
    assert out.shape == (4 * k, 5 * k) and np.allclose(out, 7)
    ramp = np.arange(36.0).reshape(6, 6)
    out = K.upsample(ramp, k, w * 3)
    assert out.max() <= 35 and out.min() >= 0


def test_noise():
    f = K.noise_field(5, 40, 24)
    assert f.shape == (3, 24, 40) and abs(f.mean()) < 0.05 and f.std() > 0.1
    assert (K.noise_field(5, 40, 24) == f).all() and (K.noise_field(6, 40, 24) != f).any() and (K.noise_field(5, 40, 24, 256) != f).any()
    flat = [np.zeros((24, 40)), np.full((24, 40), 0.5), np.zeros((24, 40))]
    assert all(np.array_equal(a, b) for a, b in zip(K.add_noise(flat, f, np.zeros(8)), flat, strict=True))
    assert K.add_noise(flat, f, np.full(8, 0.5))[1].std() > 0


def test_filters():
    flat = [np.full((6, 7), 3.0)] * 3
    assert all(np.allclose(p, 3) for p in K.smooth_low_frequency(flat, [1.0] * 3))
    sharp = np.random.default_rng(0).random((20, 20))
    assert np.abs(K.sharpen_inverse(K.gaborish(sharp), K.gaborish, 40) - sharp).max() < 0.05
    assert K.half_float(np.array([1.0002]))[0] == np.float32(np.float16(1.0002))


def test_histogram_clusters():
    a, b = np.array([100, 0, 5]), np.array([0, 90, 1])
    assert K.cluster_histograms(np.array([a, b, a * 2, b])) == [0, 1, 0, 1]
    assert max(K.cluster_histograms(np.eye(9) * 1000, most=3)) == 2


def test_compositing():
    one = np.ones((2, 2))
    shown = K.composite([{"plane": one, "duration": 0, "save": 1}, {"plane": one * 3, "x0": 1, "y0": 1, "mode": "add", "source": 1, "duration": 5, "save": 2}, {"plane": one, "alpha": one / 2, "mode": "blend", "source": 2, "last": True}], 3, 3)
    assert shown[0].tolist() == [[1, 1, 0], [1, 4, 3], [0, 3, 3]] and shown[1].tolist() == [[1, 1, 0], [1, 2.5, 3], [0, 3, 3]]


@pytest.mark.parametrize("pattern", ["RGGB", "BGGR", "GRBG", "GBRG"])
def test_demosaic(pattern):
    out = K.demosaic(np.full((5, 6), 9.0), pattern)
    assert np.allclose(out, 9)
