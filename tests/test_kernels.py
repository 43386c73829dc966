import numpy as np
import pytest

from voltloom.functions import filters, fits
from voltloom.operators import clustering
from voltloom.operators.spikes import BlockSearch, Settings


def test_sharpness_hand_worked():
    assert filters.sharpness([[-500, 500, -500, 100, 500, -100]]).tolist() == [[0, 250000, -250000, 0, 125000, 0]]
    assert filters.sharpness([[-500, 500, -500, 100, 500, 100]]).tolist() == [[0, 250000, -250000, 0, 0, 0]]


def test_lower_median():
    assert filters.lower_median(np.array([[4, 1, 3, 2]])).tolist() == [2]


@pytest.mark.parametrize("kind,pass_hz,stop_hz", [("highpass", 3000, 30), ("lowpass", 30, 3000)])
def test_butterworth_bands(kind, pass_hz, stop_hz):
    rate, cut = 30000.0, 300.0
    b, a = filters.butterworth(4, cut, rate, kind)
    gain = lambda f: abs(np.polyval(b, z := np.exp(2j * np.pi * f / rate)) / np.polyval(a, z))
    assert gain(pass_hz) == pytest.approx(1, abs=0.01)
    assert gain(stop_hz) < 1e-3
    assert gain(cut) == pytest.approx(2**-0.5, rel=1e-6)
    assert (np.abs(np.roots(a)) < 1).all()


def test_lfilter_is_the_recursion():
    rng = np.random.default_rng(0)
    b, a = filters.butterworth(4, 300, 30000)
    x = rng.normal(size=(2, 700))
    y = np.zeros_like(x)
    for t in range(x.shape[1]):
        y[:, t] = sum(b[k] * x[:, t - k] for k in range(5) if t >= k) - sum(a[k] * y[:, t - k] for k in range(1, 5) if t >= k)
    got, state = filters.lfilter(b, a, x)
    assert np.allclose(got, y, atol=1e-8)
    first, s = filters.lfilter(b, a, x[:, :300])
    second, _ = filters.lfilter(b, a, x[:, 300:], s)
    assert np.allclose(np.concatenate([first, second], axis=1), got, atol=1e-8)


def test_filtfilt_has_no_phase():
    t = np.arange(6000) / 30000
    x = np.sin(2 * np.pi * 2000 * t)[None, :]
    b, a = filters.butterworth(4, 300, 30000)
    assert np.abs(filters.filtfilt(b, a, x)[0, 500:-500] - x[0, 500:-500]).max() < 0.01


def test_resample_keeps_samples_and_band():
    t = np.arange(200)
    x = np.sin(2 * np.pi * 0.05 * t)[None, :]
    y = filters.resample(x, 4)
    assert y.shape == (1, 200 * 4 - 3)
    assert np.allclose(y[0, ::4], x[0], atol=1e-9)
    fine = np.sin(2 * np.pi * 0.05 * np.arange(y.shape[1]) / 4)
    assert np.abs(y[0, 100:-100] - fine[100:-100]).max() < 0.05


def test_wavelet_filter():
    lo = filters.daubechies(4)
    assert len(lo) == 8 and lo.sum() == pytest.approx(2**0.5) and lo @ lo == pytest.approx(1)
    t = np.arange(8192) / 30000
    slow, fast = np.sin(2 * np.pi * 10 * t), np.sin(2 * np.pi * 3000 * t)
    y = filters.wavelet_highpass((slow + fast)[None, :])
    assert y.shape == (1, 8192)
    assert np.abs(y[0, 1000:-1000] - fast[1000:-1000]).max() < 0.1


def test_envelopes():
    t = np.arange(3000) / 30000
    x = (1 + 0.5 * np.sin(2 * np.pi * 10 * t)) * np.sin(2 * np.pi * 1000 * t)
    env = filters.analytic_envelope(x[None, :])[0]
    assert np.abs(env - (1 + 0.5 * np.sin(2 * np.pi * 10 * t)))[300:-300].max() < 0.05
    assert filters.rectified_envelope(x[None, :], 30000).shape == (1, 3000)


def test_gaussian_fits_find_planted_sources():
    y = np.arange(0, 700, 50.0)
    x = np.zeros_like(y)
    got = fits.gaussian_1d(100 * np.exp(-((y - 333) ** 2) / (2 * 60**2)), x, y)
    assert got[1] == pytest.approx(333, abs=8) and got[2] == pytest.approx(60, rel=0.2)
    gx, gy = (a.ravel().astype(float) for a in np.meshgrid(np.arange(0, 200, 40), np.arange(0, 400, 40)))
    got = fits.gaussian_2d(100 * np.exp(-((gx - 90) ** 2 + (gy - 210) ** 2) / (2 * 55**2)), gx, gy)
    assert got[0] == pytest.approx(90, abs=6) and got[1] == pytest.approx(210, abs=6)
    assert fits.gaussian_1d(np.ones(14), x, y, most_sigma=50) is None
    assert fits.spatial_mean([0, 0], np.array([1.0, 3.0]), np.array([0.0, 2.0])) == (2.0, 1.0)


def test_align_best_recovers_shifts():
    rng = np.random.default_rng(1)
    base = np.zeros((3, 40))
    base[:, 18:22] = [-10, -60, 40, 10]
    shifts = rng.integers(-2, 3, 200)
    waves = np.stack([fits.shift_wave(base, int(s)) for s in shifts]) + rng.normal(size=(200, 3, 40))
    got = fits.align_best(waves)
    aligned = np.stack([fits.shift_wave(w, int(g)) for w, g in zip(waves, got)])
    assert aligned.var(0).sum() < waves.var(0).sum()
    assert fits.align_best(np.zeros((2, 1, 5))).tolist() == [-2, -2]  # the first of equals


def test_ascent_separates_blobs():
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal((0, 0), 0.1, (150, 2)), rng.normal((2, 2), 0.1, (100, 2)), [[9, 9]]])
    got = clustering.ascend(x, clustering.Ascent(sigma=0.3, alpha=1.0))
    assert set(got[:150]) == {0} and set(got[150:250]) == {1} and got[250] == -1
    assert clustering.ascend(np.zeros((0, 2))).tolist() == []


def test_ica_and_nmf():
    rng = np.random.default_rng(3)
    s = np.stack([rng.laplace(size=4000), rng.uniform(-1, 1, 4000)], 1)
    y = clustering.fast_ica(s @ rng.normal(size=(2, 3)), 2)
    c = np.abs(np.corrcoef(np.concatenate([s, y], 1).T)[:2, 2:])
    assert (c.max(1) > 0.95).all()
    assert (clustering.nmf(np.abs(rng.normal(size=(30, 6))), 3) >= 0).all()


def synthetic(rng, seconds=1.0, rate=30000.0, sites=8):
    n = int(seconds * rate)
    xs, ys = np.zeros(sites), np.arange(sites) * 60.0
    x = rng.normal(0, 8, (sites, n))
    times = np.arange(900, n - 900, 1500)
    wave = np.interp(np.arange(-15, 31), [-15, -5, 0, 6, 12, 30], [0, 0, -1, 0.45, 0.1, 0])
    depth = rng.uniform(60, 360, len(times))
    for t, d in zip(times, depth):
        x[:, t - 15 : t + 31] += 250 * np.exp(-((ys - d) ** 2) / (2 * 50**2))[:, None] * wave
    return x, xs, ys, times, depth


def test_detection_finds_planted_spikes():
    x, xs, ys, times, depth = synthetic(np.random.default_rng(4))
    s = Settings(filter=None, car=None)
    found = list(BlockSearch(x, 1e6 / 30000, xs, ys, s, (0, x.shape[1])).run())
    got = np.array([f["ti"] for f in found])
    hit = np.array([np.abs(got - t).min() <= 3 for t in times])
    assert hit.mean() == 1.0
    assert len(found) <= len(times) * 1.1
    err = [abs(found[int(np.abs(got - t).argmin())]["y0"] - d) for t, d in zip(times, depth)]
    assert np.median(err) < 15
    both = [list(BlockSearch(x, 1e6 / 30000, xs, ys, s, c).run()) for c in ((0, 15000), (15000, x.shape[1]))]
    assert {(f["ti"], f["chan"]) for b in both for f in b} == {(f["ti"], f["chan"]) for f in found}


def test_unsettled_ascent_raises():
    x = np.random.default_rng(0).normal(size=(200, 3))
    with pytest.raises(RuntimeError, match="did not settle"):
        clustering.ascend(x, clustering.Ascent(sigma=0.3, alpha=1.0, rounds=1))
