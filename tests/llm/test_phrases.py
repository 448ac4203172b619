"""The memory that one block of phrases takes."""

import inspect
import tracemalloc

import numpy as np

from arbora.llm import phrases as P


def test_a_block_is_counted_in_bounded_memory():
    block = inspect.signature(P.frequent).parameters["block_bytes"].default
    words = np.array([f"w{i}" for i in range(20_000)])
    text = " ".join(words[np.random.default_rng(1).integers(0, len(words), block // 6)].tolist())
    tracemalloc.start()
    P.Grams(["en"], [text])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 250e6
