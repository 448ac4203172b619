"""Resampled stretches in pieces."""

import numpy as np
import pandas as pd
import pytest

from arbora.operators import space as G


def test_a_long_stretch_is_given_in_pieces():
    pdf = pd.DataFrame({"neuron": [1, 1, 1, 2, 2], "node_id": [1, 2, 3, 1, 2], "parent_id": [-1, 1, 1, -1, 1], "x": [0, 1000.0, 0, 0, 7], "y": 0.0, "z": [0, 0, 33.0, 0, 0], "radius": [1.0, 3, 2, 1, 1]})
    some, whole = list(G._resampled(1.0, 64)(pdf)), G.resampler(1.0)(pdf)
    assert max(map(len, some)) < 2 * 64 + 3 and len(some) > 10
    pd.testing.assert_frame_equal(pd.concat(some, ignore_index=True), whole)
    for neuron, n in ((1, 1034), (2, 8)):
        t = whole[whole.neuron == neuron]
        assert len(t) == n and t.node_id.is_unique and set(t.parent_id) - {-1} <= set(t.node_id)
    t = whole.merge(whole, left_on=["neuron", "parent_id"], right_on=["neuron", "node_id"])
    gap = np.sqrt((t.x_x - t.x_y) ** 2 + (t.z_x - t.z_y) ** 2)
    assert gap.to_numpy() == pytest.approx(1.0)
