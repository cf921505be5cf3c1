"""Memory of a Python worker: bounded by a slice of its batch, not by the batch."""

import tracemalloc

import pyarrow as pa

from crashlens.llm.substrings import _first_level


def test_windows_of_a_batch_take_little_memory():
    texts = pa.array([" ".join(f"w{(i * 7919 + k * k) % 5003}" for k in range(400)) for i in range(4000)], pa.string())
    run = _first_level(20).func
    run(texts.slice(0, 10))
    tracemalloc.start()
    run(texts)
    peak = tracemalloc.get_traced_memory()[1] / 1e6
    tracemalloc.stop()
    assert texts.nbytes > 8e6
    assert peak < 45
