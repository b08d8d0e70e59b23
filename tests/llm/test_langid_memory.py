"""The fit runs on the driver, so its memory counts there."""

import tracemalloc

import numpy as np

from tessera.llm import langid as L


def test_fit_makes_no_float_matrix_of_all_rows():
    rng = np.random.Generator(np.random.PCG64(3))
    p = (rng.random((1200, L.DIM)) < 0.02).astype(np.uint8)
    p[::2, :400] |= (rng.random((600, 400)) < 0.3).astype(np.uint8)
    languages, bits = ["one", "two"] * 600, np.packbits(p, axis=1)
    tracemalloc.start()
    m = L.fit(bits, languages, packed=True)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 0.75 * p.size * 4
    plain = L.fit(p, languages)
    assert np.allclose(m.landmarks, plain.landmarks) and np.allclose(m.weights, plain.weights, atol=1e-4) and np.allclose(m.bias, plain.bias, atol=1e-4)
    assert (np.array(m.languages)[m.decide(p).argmax(axis=1)] == languages).mean() > 0.95
