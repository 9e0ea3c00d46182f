"""Parities rule out no pair at the threshold."""

import numpy as np
import pytest

from atlas_spark.llm import cells as C


@pytest.mark.parametrize("percent", [80, 90])
def test_parts_keep_every_link(percent):
    rng = np.random.default_rng(percent)
    sets = []
    for size in (1, 2, 3, 60, 64, 65, 130, 500, 1100):
        base = rng.integers(0, 2**63, size, dtype=np.int64).view(np.uint64)
        for share in (0, 0, 0.03, 0.05, 0.1, 0.2, 0.5):
            k = int(size * share)
            other = rng.integers(0, 2**63, k + int(rng.integers(0, 3)) * (k > 0), dtype=np.int64).view(np.uint64)
            sets.append(np.unique(np.concatenate([base[k:], other])))
    rng.shuffle(ids := list(range(len(sets))))
    sets = [sets[i] for i in ids]
    top = dict(C._parts(list(range(len(sets))), [C.parities(u) for u in sets], [len(u) for u in sets], [2] * len(sets), percent))
    links = 0
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(np.intersect1d(a, b))
            if 100 * both >= percent * (len(a) + len(b) - both):
                links += 1
                assert top[i] == top[j]
    assert links > 20 and len(set(top.values())) > 5


def test_sides_are_not_compared_with_themselves():
    u = np.arange(100, dtype=np.uint64)
    same = [C.parities(u)] * 3
    assert not list(C._parts([1, 2, 3], same, [100] * 3, [0, 0, 0], 90))
    assert len(list(C._parts([1, 2, 3], same, [100] * 3, [0, 0, 1], 90))) == 3
