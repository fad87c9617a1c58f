"""The index of colours and the merge plan against plain searches."""

import time

import numpy as np
import pytest

from gridloom.operators import color_index
from gridloom.operators.color_index import ColorIndex, Remaining, closest_plain, merge_plan


@pytest.mark.parametrize("kind", ["integers", "coarse", "narrow", "line", "same"])
@pytest.mark.parametrize("size", [1, 5, 129, 700, 4096])
def test_closest_equals_the_plain_search(kind, size):
    rng = np.random.default_rng(size)
    make = {
        "integers": lambda n: rng.integers(0, 256, (n, 3)).astype(float), "coarse": lambda n: rng.integers(0, 4, (n, 3)).astype(float), "narrow": lambda n: 1 + rng.random((n, 3)) * 1e-9,
        "line": lambda n: np.column_stack([rng.random(n), np.zeros(n), np.ones(n)]), "same": lambda n: np.ones((n, 3)),
    }[kind]
    colors, points = make(size), np.concatenate([make(600), rng.normal(0, 300, (50, 3))])
    assert np.array_equal(ColorIndex(colors).closest(points), closest_plain(points, colors))


def test_few_colours_are_looked_at(monkeypatch):
    rng = np.random.default_rng(0)
    colors, points = rng.random((65_536, 3)), rng.random((20_000, 3))
    seen = []
    among = ColorIndex._among
    monkeypatch.setattr(ColorIndex, "_among", lambda self, here, point, run: seen.append(len(run) * color_index.RUN) or among(self, here, point, run))
    found = ColorIndex(colors).closest(points)
    assert sum(seen) < 0.01 * len(colors) * len(points)
    assert np.array_equal(found[:200], closest_plain(points[:200], colors))


def plain_merges(usage, colors, most):
    used, stands = dict(usage), {k: k for k in usage}
    while len(used) > most:
        gone = min(used, key=lambda k: (used[k], -k))
        count = used.pop(gone)
        target = min(used, key=lambda k: (sum((a - b) ** 2 for a, b in zip(colors[gone], colors[k])), k))
        used[target] += count
        stands = {k: target if v == gone else v for k, v in stands.items()}
    return stands


@pytest.mark.parametrize("seed", range(6))
def test_merges_equal_the_plain_ones(seed):
    rng = np.random.default_rng(seed)
    size = [3, 40, 150, 300, 300, 300][seed]
    top = [256, 256, 4, 256, 16, 2][seed]  # few values: ties of distance; few uses: ties of use
    names = rng.permutation(1000)[:size].tolist()
    usage = {int(k): int(rng.integers(1, 6)) for k in names}
    colors = {int(k): tuple(map(float, rng.integers(0, top, 3))) for k in names}
    for most in (1, 2, size // 2, size, size + 5):
        assert merge_plan(usage, colors, most) == plain_merges(usage, colors, most)


def test_sixty_five_thousand_colours_merge_within_a_minute():
    rng = np.random.default_rng(1)
    usage = dict(enumerate(rng.integers(1, 100, 65_536).tolist()))
    colors = dict(enumerate(map(tuple, rng.random((65_536, 3)).tolist())))
    began = time.process_time()
    stands = merge_plan(usage, colors, 24)
    assert len(set(stands.values())) == 24 and time.process_time() - began < 60


def test_remaining_colours():
    colors = np.array([[0.0, 0, 0], [1, 0, 0], [1, 0, 0], [9, 9, 9]])
    left = Remaining(np.arange(4), colors)
    left.take(0)
    assert left.nearest(0) == 1
    left.take(1)
    assert left.nearest(0) == 2
    left.take(2)
    assert left.nearest(0) == 3
