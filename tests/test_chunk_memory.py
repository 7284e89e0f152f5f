"""A chunk of the largest size takes a bounded part of a task's memory."""

import tracemalloc

import numpy as np

from tidewater.functions.model import example_model
from tidewater.operators import scan


def test_a_chunk_is_small():
    rng, work, start = np.random.default_rng(1), scan.KnownRegimes(example_model()), np.zeros(scan.CHUNK, dtype=bool)
    start[0] = True
    values = {"y": rng.normal(50, 20, (scan.CHUNK, 1)), "r": rng.integers(0, 2, scan.CHUNK).astype(float)}
    tracemalloc.start()
    try:
        work.passed(work.rows(values, start, None), work.first(), work.last())
        assert tracemalloc.get_traced_memory()[1] < 60e6
    finally:
        tracemalloc.stop()
