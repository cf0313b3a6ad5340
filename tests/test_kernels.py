import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.operators import kernels as K


def test_polarity_does_not_matter():
    rows = K.unit_rows(np.array([[2, -1, -2, 1], [-2, 1, 2, -1], [1, 2, -1, -2], [2, 4, -2, -4]], float))
    labels = K.polarity_clusters(rows, 2, 42)[1]
    assert labels[0] == labels[1] and labels[2] == labels[3] and labels[0] != labels[2]


def restart_scan(labels, scores, least):
    """The definition: the first short run with a replacement is replaced, then all starts again."""
    out = list(labels)
    while least > 1:
        cuts = [0, *(i for i in range(1, len(out)) if out[i] != out[i - 1]), len(out)]
        runs = [(a, b, out[a]) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]
        for i, (a, b, _) in enumerate(runs):
            near = ([runs[i - 1][2]] if i else []) + ([runs[i + 1][2]] if i + 1 < len(runs) else [])
            if b - a < least and near:
                out[a:b] = [max(near, key=lambda s: scores[a:b, s].mean())] * (b - a)
                break
        else:
            break
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=1, max_size=40), st.integers(1, 5), st.integers(0, 99))
def test_smoothing_equals_its_definition(labels, least, seed):
    scores = np.random.default_rng(seed).integers(0, 50, (len(labels), 4)).astype(float)
    assert K.smooth_runs(np.array(labels), scores, least).tolist() == restart_scan(labels, scores, least)


def test_peaks_keep_the_highest():
    trace = np.array([0, 1, 0, 3, 0, 2, 2, 2, 0, 5, 0], float)
    assert K.spaced_peaks(trace, 1).tolist() == [1, 3, 6, 9]
    assert K.spaced_peaks(trace, 4).tolist() == [3, 9]


def test_assignment_is_unique_and_best():
    table = np.array([[0.9, 0.8, 0.1], [0.9, 0.2, 0.1]])
    assert K.unique_assignment(table).tolist() == [1, 0]


def test_sign_flips():
    assert K.sign_flip_p(0.01 * np.arange(500) - 2, 42) == 1 / 2049
    assert K.sign_flip_p(np.array([]), 1) == 1.0
    assert K.sign_flip_p(np.full(30, 3.0), 42) < 0.01


def test_analytic_signal_of_a_cosine():
    t = np.arange(256) / 256
    assert np.allclose(np.abs(K.analytic(np.cos(2 * np.pi * 8 * t))), 1)
    a, b = K.analytic(np.cos(2 * np.pi * 8 * t)), K.analytic(np.cos(2 * np.pi * 8 * t + 1))
    assert np.isclose(K.phase_locking(a, b), 1) and np.isclose(K.weighted_phase_lag(a, b), 1)


def test_mutual_information():
    a = np.array([0, 1] * 20)
    assert np.isclose(K.mutual_information(a, a), 1) and K.mutual_information(a, np.zeros(40)) == 0


def test_bootstrap_holds_the_mean():
    mean, low, high = K.bootstrap_interval(np.random.default_rng(0).normal(2, 1, 200), 42)
    assert low < mean < high
