"""What the quality classifier's fit takes of the driver's memory beside the features."""

import tracemalloc

import numpy as np

from glosswork.llm import cotraining


def test_training_rows_are_held_once():
    """Beside the labelled rows there are those handed over and one training set, no further copies."""
    rng = np.random.default_rng(7)

    def rows(n):
        y = (np.arange(n) % 2).astype(np.int64)
        idx = np.sort(rng.integers(20, 4000, (n, 400)), 1).astype(np.int32)
        idx[:, 0] = np.where(rng.random(n) < 0.8, y, 1 - y)
        return (np.arange(n + 1) * 400, idx.ravel()), (np.arange(n + 1) * 2, np.stack((y + 3, y * 2), 1).ravel().astype(np.int32)), y

    text, meta, y = rows(16_000)
    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        cotraining.cotrain(text, meta, y, np.arange(16_000) % 5, lambda *_: {v: rows(1000) for v in ("text", "meta")}, 1)
        peak = tracemalloc.get_traced_memory()[1] - before
    finally:
        tracemalloc.stop()
    assert peak < 3 * text[1].nbytes
