"""End states of one moving concept that no edge leads back to, as a function of its pull.

Where all rows start alike, as in training, a row's end after some steps depends on the
constant sum that pulls it and on nothing else. That function is tabled once for a slope
and a start, and a row is looked up in place of being iterated.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

#: Cells in a unit of pull, a power of 2, and the widest pull that is tabled: beyond, rows are iterated.
CELLS, WIDEST = 1024, 16.0
#: A cell's polynomial is this near to the iterated values, and to their derivatives, or the cell's rows are iterated.
NEAR, NEAR_DERIVATIVE = 1e-13, 1e-11


def iterated(pull: np.ndarray, slope: float | np.ndarray, memory: float, a: float, b: float, start: float | np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(end, first and second derivative by the pull) of each pull."""
    state, first, second = np.full(pull.shape, start, dtype=float), np.zeros(pull.shape), np.zeros(pull.shape)
    for _ in range(steps):
        state = 1 / (1 + np.exp(-slope * (memory * (a * state + b) + pull)))
        bend, inward = slope * state * (1 - state), memory * a * first + 1
        second = bend * (memory * a * second + slope * (1 - 2 * state) * inward**2)
        first = bend * inward
    return state, first, second


@dataclass(frozen=True)
class Ends:
    """The table of one slope and start (``settings``: slope, memory, a, b, start, steps). ``tabled``: polynomials of the fifth degree, a column for each cell, that have the value and two derivatives at both of its sides; ``left_out``: cells where they aren't near enough."""

    settings: tuple[float, float, float, float, float, int]
    low: float
    tabled: np.ndarray
    left_out: np.ndarray

    def told(self, pull: np.ndarray, end: np.ndarray, slope: np.ndarray | None = None) -> np.ndarray:
        """Writes the end, and its derivative, of each pull of a vector; which ones aren't tabled, and have to be iterated, is returned."""
        place = (pull - self.low) * CELLS
        within = None
        if not (place.min(initial=0) >= 0 and place.max(initial=0) < self.tabled.shape[1]):
            within = (place >= 0) & (place < self.tabled.shape[1])
            place = np.where(within, place, 0)
        cell = place.astype(np.intp)
        apart = self.left_out.take(cell) if within is None else self.left_out.take(cell) | ~within
        place -= cell
        own = np.empty(len(pull))
        self.tabled[5].take(cell, out=end, mode="clip")
        if slope is not None:
            slope[:] = 0
        for k in range(4, -1, -1):
            if slope is not None:
                slope *= place
                slope += end
            end *= place
            end += self.tabled[k].take(cell, out=own, mode="clip")
        if slope is not None:
            slope *= CELLS
        return np.flatnonzero(apart)


def ends_of(tables: list[Ends], pull: np.ndarray, derivative: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """(ends, their derivatives) of tables x pulls; what isn't tabled is iterated together."""
    end, slope = np.empty(pull.shape), np.empty(pull.shape) if derivative else None
    apart = [t.told(pull[i], end[i], slope[i] if derivative else None) for i, t in enumerate(tables)]
    of, row = np.repeat(np.arange(len(tables)), [len(k) for k in apart]), np.concatenate(apart)
    if len(of):
        slopes, memory, a, b, starts, steps = zip(*(t.settings for t in tables), strict=True)
        found = iterated(pull[of, row], np.array(slopes)[of], memory[0], a[0], b[0], np.array(starts)[of], steps[0])
        end[of, row] = found[0]
        if derivative:
            slope[of, row] = found[1]
    return end, slope


@lru_cache(maxsize=64)
def ends(slope: float, memory: float, a: float, b: float, start: float, steps: int, reach: float) -> Ends:
    """The table for pulls from ``-reach`` to ``reach``; a worker makes it once."""
    settings, high = (slope, memory, a, b, start, steps), min(np.ceil(reach), WIDEST)
    sides = np.arange(-high * CELLS, high * CELLS + 1) / CELLS
    value, first, second = iterated(sides, *settings)
    first, second = first / CELLS, second / CELLS**2
    c0, c1, c2 = value[:-1], first[:-1], second[:-1] / 2
    # What the first three terms lack at the other side: value, first and second derivative.
    p, q, r = value[1:] - c0 - c1 - c2, first[1:] - c1 - 2 * c2, second[1:] - 2 * c2
    tabled = np.stack([c0, c1, c2, 10 * p - 4 * q + r / 2, -15 * p + 7 * q - r, 6 * p - 3 * q + r / 2])
    out = Ends(settings, -high, tabled, np.zeros(tabled.shape[1], dtype=bool))
    # The end grows with the pull where ``memory * a`` isn't negative, so that nothing hides between points that agree.
    if memory * a < 0:
        out.left_out[:] = True
        return out
    wrong = np.zeros(tabled.shape[1], dtype=bool)
    for share in (0.25, 0.5, 0.75):
        between = sides[:-1] + share / CELLS
        told, bent = np.empty((2, len(between)))
        out.told(between, told, bent)
        true, real, _ = iterated(between, *settings)
        wrong |= ~((np.abs(told - true) <= NEAR) & (np.abs(bent - real) <= NEAR_DERIVATIVE * np.maximum(1, np.abs(real))))
    out.left_out[:] = wrong
    return out
