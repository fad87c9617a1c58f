"""Content-defined anchor positions of byte strings, vectorised with numpy.

A *gram* is ``GRAM`` consecutive bytes.  Every window of ``span`` bytes picks the
grams of least hash inside it; the picked start positions are its anchors.  The pick
depends on the window's bytes alone, so equal windows, wherever they stand, have
anchors at equal offsets.  On ordinary text about one byte in ``(span - GRAM) / 2``
is an anchor.
"""

from __future__ import annotations

import numpy as np

GRAM = 64
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_BYTE = np.random.default_rng(20240611).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0x8EBC6AF09C88C6E3)]
_MIX = np.uint64(0xE7037ED1A0B428DB)


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """64-bit hash of the ``GRAM`` bytes at each position that has as many."""
    h = _BYTE[data]
    width = 1
    for step in _STEP:
        h = h[:-width] * step + h[width:]
        h ^= h >> np.uint64(29)
        width *= 2
    h *= _MIX
    return h ^ (h >> np.uint64(32))


def _slide(values: np.ndarray, width: int, pick) -> np.ndarray:
    """pick over ``values[i : i + width]`` for each i that has as many."""
    done, out = 1, values
    while done * 2 <= width:
        out = pick(out[:-done], out[done:])
        done *= 2
    if done < width:
        rest = width - done
        out = pick(out[:-rest], out[rest:])
    return out


def anchors(parts: list[bytes], span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(part number, position in the part, gram hash) of each anchor of each part."""
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    none = np.empty(0, np.int64)
    if not len(sizes) or sizes.max() < span:
        return none, none, np.empty(0, np.uint64)
    data = np.frombuffer(b"".join(parts), dtype=np.uint8)
    ends = np.cumsum(sizes)
    starts = ends - sizes
    h = gram_hashes(data)
    width = span - GRAM + 1
    least = _slide(h, width, np.minimum)
    for start, end in zip(starts, ends):  # windows that would cross into the next part pick nothing
        least[max(start, end - span + 1) : end] = 0
    padded = np.zeros(len(h) + width - 1, np.uint64)
    padded[width - 1 : width - 1 + len(least)] = least
    at = np.flatnonzero((_slide(padded, width, np.maximum) == h) & (h != 0))
    part = np.searchsorted(ends, at, side="right")
    return part, at - starts[part], h[at]
