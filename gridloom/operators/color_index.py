"""Nearest colours without looking at all of them.

Colours are put in the order of a space-filling curve and cut into runs with bounding
boxes. A query looks only into the boxes that no bound rules out. Distances are computed as the plain search does, and of equal ones the
lowest place counts, so the answers are the same.
"""

from __future__ import annotations

import heapq

import numpy as np

#: Colours of a run, and of one that is asked for one colour at a time; queries of a run; colours up to which all are looked at.
RUN, WIDE_RUN, ASKED, FEW = 16, 32, 64, 128
#: Bounds may be off by rounding; boxes are ruled out only beyond this share.
SLACK = 1e-9
#: Distances that are held at once.
CELLS = 1 << 21


def _curve(points: np.ndarray, low: np.ndarray, span: np.ndarray) -> np.ndarray:
    """Place of each point on a curve through 1,024 cells a side."""
    cell = np.clip((points - low) / span * 1023, 0, 1023).astype(np.int64)
    out = np.zeros(len(points), dtype=np.int64)
    for bit in range(10):
        for axis in range(3):
            out |= (cell[:, axis] >> bit & 1) << (3 * bit + axis)
    return out


def _squared(points: np.ndarray, colors: np.ndarray) -> np.ndarray:
    p, q, s = (points[:, k, None] - colors[None, :, k] for k in range(3))
    return p * p + q * q + s * s


def closest_plain(points: np.ndarray, colors: np.ndarray) -> np.ndarray:
    """Place of the first nearest row of colors for each row of points, by looking at all."""
    out = np.empty(len(points), dtype=np.int64)
    step = max(1, CELLS // len(colors))
    for lo in range(0, len(points), step):
        out[lo : lo + step] = _squared(points[lo : lo + step], colors).argmin(axis=1)
    return out


class ColorIndex:
    """Runs of colours with their boxes."""

    def __init__(self, colors: np.ndarray, run: int = RUN):
        self.colors = colors
        self.low = colors.min(axis=0)
        self.span = np.maximum(colors.max(axis=0) - self.low, 1e-300)
        codes = _curve(colors, self.low, self.span)
        order = np.argsort(codes, kind="stable")
        self.codes = codes[order]
        self.starts = np.arange(0, len(order), run)
        self.order = order
        # the last run is filled up with its own colours
        self.padded = order[np.minimum(self.starts[:, None] + np.arange(run), len(order) - 1)]
        placed = colors[order]
        self.least, self.most = (f.reduceat(placed, self.starts, axis=0) for f in (np.minimum, np.maximum))

    def closest(self, points: np.ndarray) -> np.ndarray:
        """Place of the first nearest colour of each point.

        The colours next to a point on the curve give a bound; runs of points drop the
        boxes beyond the greatest of theirs, then each point those beyond its own.
        """
        if len(self.colors) <= FEW:
            return closest_plain(points, self.colors)
        codes = _curve(points, self.low, self.span)
        turn = np.argsort(codes, kind="stable")
        at = np.clip(np.searchsorted(self.codes, codes) - RUN // 2, 0, len(self.order) - RUN)
        bound = np.full(len(points), np.inf)
        for k in range(RUN):
            off = points - self.colors[self.order[at + k]]
            np.minimum(bound, (off * off).sum(axis=1), out=bound)
        bound *= 1 + SLACK
        out = np.empty(len(points), dtype=np.int64)
        for lo in range(0, len(turn), ASKED):
            own = turn[lo : lo + ASKED]
            here, most = points[own], bound[own]
            gap = np.maximum(np.maximum(self.least - here.max(axis=0), here.min(axis=0) - self.most), 0)
            runs = np.flatnonzero((gap * gap).sum(axis=1) <= most.max())
            gap = np.maximum(np.maximum(self.least[runs] - here[:, None], here[:, None] - self.most[runs]), 0)
            point, run = np.nonzero((gap * gap).sum(axis=2) <= most[:, None])
            out[own] = self._among(here, point, runs[run])
        return out

    def _among(self, points: np.ndarray, point: np.ndarray, run: np.ndarray) -> np.ndarray:
        """Per point, of which at least one pair (point, run) is given and pairs come by point, the first nearest colour in its runs."""
        places = self.padded[run]
        p, q, s = (points[point, k, None] - self.colors[places, k] for k in range(3))
        far = p * p + q * q + s * s
        starts = np.flatnonzero(np.append(True, point[1:] != point[:-1]))
        least = np.minimum.reduceat(far.min(axis=1), starts)
        first = np.where(far == least[point][:, None], places, len(self.colors)).min(axis=1)
        return np.minimum.reduceat(first, starts)


class Remaining:
    """Colours of which some are taken away, one by one."""

    def __init__(self, places: np.ndarray, colors: np.ndarray):
        self.every, self.alive, self.left = colors, np.zeros(len(colors), dtype=bool), len(places)
        self.alive[places] = True
        self._index(np.asarray(places))

    def _index(self, places: np.ndarray) -> None:
        self.places, self.held = places, len(places)
        self.index = ColorIndex(self.every[places], WIDE_RUN) if len(places) else None

    def take(self, place: int) -> None:
        self.alive[place] = False
        self.left -= 1
        if self.left < self.held // 2:  # empty runs would be looked at in vain
            self._index(np.flatnonzero(self.alive))

    def nearest(self, place: int) -> int:
        """The nearest colour that is left to that of place, of equal ones the lowest place."""
        point, index = self.every[place], self.index
        gap = np.maximum(np.maximum(index.least - point, point - index.most), 0)
        gap *= gap
        near = gap[:, 0] + gap[:, 1] + gap[:, 2]
        while True:  # a run with a colour left, near at hand, gives a bound
            run = near.argmin()
            far, own = self._far(point, index.padded[run])
            if len(own):
                break
            near[run] = np.inf
        runs = np.flatnonzero(near <= far.min() * (1 + SLACK))
        far, own = self._far(point, index.padded[runs].ravel())
        return int(own[far == far.min()].min())

    def _far(self, point: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Squared distances and places of the colours that are left among those of the index at some places."""
        own = self.places[at]
        own = own[self.alive[own]]
        off = self.every[own] - point
        off *= off
        return off[:, 0] + off[:, 1] + off[:, 2], own


def merge_plan(usage: dict[int, int], colors: dict[int, tuple[float, float, float]], most: int) -> dict[int, int]:
    """Representative of each used index once at most ``most`` are left.

    Given up is the least used colour (of equals the larger index), for the nearest in
    use (of equals the smaller index), which takes over its uses. The least used one comes
    from a heap whose entries lapse when their colour's uses change; chains of mergers are
    followed once, at the end.
    """
    names = sorted(usage)
    place = {name: k for k, name in enumerate(names)}
    uses = [int(usage[name]) for name in names]
    left = len(names)
    if left <= most:
        return {name: name for name in names}
    remaining = Remaining(np.arange(left), np.array([colors[name] for name in names], dtype=float))
    heap = [(n, -k) for k, n in enumerate(uses)]
    heapq.heapify(heap)
    stands = list(range(left))
    while left > most:
        n, gone = heapq.heappop(heap)
        gone = -gone
        if not remaining.alive[gone] or uses[gone] != n:
            continue
        remaining.take(gone)
        target = remaining.nearest(gone)
        stands[gone] = target
        uses[target] += n
        heapq.heappush(heap, (uses[target], -target))
        left -= 1
    for k in range(len(names)):
        path = [k]
        while stands[path[-1]] != path[-1]:
            path.append(stands[path[-1]])
        for step in path:
            stands[step] = path[-1]
    return {name: names[stands[place[name]]] for name in names}
