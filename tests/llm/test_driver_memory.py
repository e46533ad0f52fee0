"""What the driver holds while a model is fitted."""

import tracemalloc

import numpy as np

from tremorlake.llm.toxicity import by_similarity


def test_pivots_are_held_for_their_own_terms_only():
    rng, size = np.random.default_rng(0), 200_000
    terms = [np.unique((size * rng.random(50) ** 4).astype(np.int64)) for _ in range(500)]
    vectors = [(t, np.full(len(t), len(t) ** -0.5)) for t in terms]
    tracemalloc.start()
    order = by_similarity(size, vectors)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sorted(order) == list(range(500))
    assert peak < 4_000_000
