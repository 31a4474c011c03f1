"""Order statistics over many ranges of one sequence at once: a wavelet matrix over the values' ranks, in numpy."""

from __future__ import annotations

import numpy as np


class Ranges:
    """The k-th smallest values of ranges [low, high) of a sequence, all questions answered together: a pass over the bits of
    the ranks (as many as the sequence's length has) for all of them."""

    def __init__(self, x: np.ndarray):
        self.values, rank = np.unique(x, return_inverse=True)
        self.bits = max(1, int(len(self.values) - 1).bit_length())
        self.levels: list[tuple[np.ndarray, int]] = []  # ones before each place, and how many zeros there are
        for b in range(self.bits - 1, -1, -1):
            bit = rank >> b & 1
            ones = np.concatenate([[0], np.cumsum(bit)])
            self.levels.append((ones, len(rank) - int(ones[-1])))
            rank = np.concatenate([rank[bit == 0], rank[bit == 1]])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The value at place k (from 0) of each range in order; k beyond a range is taken as its last or first place."""
        low, high = low.copy(), high.copy()
        k = np.clip(k, 0, np.maximum(high - low - 1, 0))
        rank = np.zeros(len(low), np.int64)
        for ones, zeros in self.levels:
            below_low, below_high = ones[low], ones[high]
            smaller = (high - low) - (below_high - below_low)
            right = k >= smaller
            low, high = np.where(right, zeros + below_low, low - below_low), np.where(right, zeros + below_high, high - below_high)
            k = np.where(right, k - smaller, k)
            rank = rank << 1 | right
        return self.values[np.minimum(rank, len(self.values) - 1)]

    def below(self, low: np.ndarray, high: np.ndarray, than: np.ndarray) -> np.ndarray:
        """How many values of each range are less than a number."""
        limit = np.searchsorted(self.values, than)
        every, n = limit >= 1 << self.bits, high - low
        low, high, found = low.copy(), high.copy(), np.zeros(len(low), np.int64)
        for b, (ones, zeros) in zip(range(self.bits - 1, -1, -1), self.levels, strict=True):
            below_low, below_high = ones[low], ones[high]
            right = limit >> b & 1 == 1
            found += np.where(right, (high - low) - (below_high - below_low), 0)
            low, high = np.where(right, zeros + below_low, low - below_low), np.where(right, zeros + below_high, high - below_high)
        return np.where(every, n, found)

    def kth_off(self, low: np.ndarray, high: np.ndarray, centre: np.ndarray, k: np.ndarray) -> np.ndarray:
        """The k-th smallest distance from a centre in each range (of k + 1 values at least)."""
        return self.two_off(low, high, centre, k)[0]

    def two_off(self, low: np.ndarray, high: np.ndarray, centre: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The k-th smallest distance from a centre in each range (of k + 1 values at least), and the one after it (inf if there is
        none): the values below the centre, backwards, and those from it on are two ordered lists; how many the first gives is
        found by bisection."""
        n = high - low
        lower = self.below(low, high, centre)
        a, z = np.maximum(0, k + 1 - (n - lower)), np.minimum(lower, k + 1)
        left = lambda j: centre - self.kth(low, high, lower - 1 - j)
        right = lambda j: self.kth(low, high, lower + j) - centre
        while (open_ := a < z).any():
            t = (a + z) // 2
            enough = (t >= lower) | (k - t < 0) | (left(t) >= right(k - t))
            z, a = np.where(open_ & enough, t, z), np.where(open_ & ~enough, t + 1, a)
        last_left = np.where(a > 0, left(np.maximum(a - 1, 0)), -np.inf)
        last_right = np.where(k - a >= 0, right(np.maximum(k - a, 0)), -np.inf)
        next_left = np.where(a < lower, left(a), np.inf)
        next_right = np.where(k + 1 - a < n - lower, right(k + 1 - a), np.inf)
        return np.maximum(last_left, last_right), np.minimum(next_left, next_right)


class Flags:
    """The same of a sequence of zeros and ones, from counts of ones."""

    def __init__(self, x: np.ndarray):
        self.ones = np.concatenate([[0], np.cumsum(x)])

    def kth(self, low: np.ndarray, high: np.ndarray, k: np.ndarray) -> np.ndarray:
        return (k >= (high - low) - (self.ones[high] - self.ones[low])).astype(float)

    def two_off(self, low: np.ndarray, high: np.ndarray, centre: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ones = self.ones[high] - self.ones[low]
        zero, one = np.abs(centre), np.abs(1 - centre)
        nearer = np.where(zero < one, (high - low) - ones, ones)
        of = lambda j: np.where(j >= high - low, np.inf, np.where(j < nearer, np.minimum(zero, one), np.maximum(zero, one)))
        return of(k), of(k + 1)


def frame_spreads(x: np.ndarray, low: np.ndarray, high: np.ndarray, kinds: tuple[str, ...] = ("sigma", "robust")) -> dict[str, np.ndarray]:
    """mean and, as asked for, std (the population's), sigma and robust scale (see ``windows.lookback_sigmas``) of the values in each
    range. An odd frame's middle values are one, so it is searched once, an even one for sigma once more."""
    n = high - low
    some, many = n > 0, np.maximum(n, 1)
    whole = bool((x == np.floor(x)).all())  # sums of whole numbers are exact
    off = 0.0 if whole or not len(x) else float(x.mean())
    sums, squares = (np.concatenate([[0.0], np.cumsum(v)]) for v in (x - off, (x - off) ** 2))
    total, square = sums[high] - sums[low], squares[high] - squares[low]
    spread = np.maximum(square - total**2 / many, 0.0)
    spread = np.where(spread < 1e-18 * many, 0.0, spread)
    out = {"mean": np.where(some, total / many + off, 0.0)}
    if "std" in kinds:
        out["std"] = np.sqrt(np.maximum(square / many - (total / many) ** 2, 0.0)) * (n > 1)
    ranges = Flags(x) if ((x == 0) | (x == 1)).all() else Ranges(x)
    asked = np.flatnonzero(some)
    mad = np.zeros((2, len(n)))
    lo, hi, m = low[asked], high[asked], n[asked]
    upper = ranges.kth(lo, hi, m // 2)
    middle = (ranges.kth(lo, hi, (m - 1) // 2) + upper) / 2
    first, second = ranges.two_off(lo, hi, middle, (m - 1) // 2)
    mad[1, asked] = (first + np.where(m % 2 == 0, second, first)) / 2
    if "sigma" in kinds:
        mad[0, asked], even = first, m % 2 == 0
        mad[0, asked[even]] = ranges.two_off(lo[even], hi[even], upper[even], m[even] // 2)[0]
        out["sigma"] = np.where(n <= 1, 0.0, np.maximum(np.sqrt(spread / np.maximum(n - 1, 1)), 1.4826 * mad[0]))
    if "robust" in kinds:
        out["robust"] = np.where(some, np.maximum(np.maximum(1e-6, np.sqrt(spread / many)), 1.4826 * mad[1]), 1e-6)
    return out
