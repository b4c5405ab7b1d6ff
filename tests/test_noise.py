"""First squares of large tables of noise, without all the others."""

import numpy as np

from quorate.operators import structure


def test_the_first_squares_are_those_of_the_whole_table(monkeypatch):
    n, p = 600, 900
    gram = structure.noise_gram(n, p, np.random.default_rng(5))
    assert np.allclose(np.diag(gram).sum(), n * p, rtol=1e-5) and np.allclose(gram.sum(1), 0, atol=0.1)
    want = np.linalg.eigvalsh(gram)[::-1][:5]
    monkeypatch.setattr(np.linalg, "eigvalsh", None)
    assert np.allclose(structure.noise_squares(n, p, np.random.default_rng(5), 5), want, rtol=1e-7)
