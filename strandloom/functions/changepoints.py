"""Kernel: change points of one coverage signal by recursive binary segmentation."""

from __future__ import annotations

import math

import numpy as np

#: The shortest signal that is searched.
LEAST = 20


def smooth(x: np.ndarray, length: int = 11, kind: str = "hanning") -> np.ndarray:
    """Window mean over the mirrored signal; as long as ``x`` plus one, one place late."""
    make = {"flat": np.ones, "hanning": np.hanning, "hamming": np.hamming, "bartlett": np.bartlett, "blackman": np.blackman}[kind]
    w = make(length)
    padded = np.concatenate([x[length - 1 : 0 : -1], x, x[-2 : -length - 1 : -1]])
    full = np.convolve(w / w.sum(), padded, mode="valid")
    return full[length // 2 - 1 : -(length // 2)]


def split_point(x: np.ndarray) -> tuple[float, int]:
    """Least squared error of two parts over places where the value changes, or (0, -1)."""
    at = np.flatnonzero(np.diff(x)) + 1
    if not len(at):
        return 0.0, -1
    s, q, n = np.cumsum(x), np.cumsum(x * x), len(x)
    ls, lq = s[at - 1], q[at - 1]
    error = (lq - ls * ls / at) + (q[-1] - lq) - (s[-1] - ls) ** 2 / (n - at)
    best = int(np.argmin(np.round(error, 9)))
    return float(error[best]), int(at[best])


def rank_test(x: np.ndarray, y: np.ndarray, alternative: str = "two-sided", continuity: bool = True) -> tuple[float, float]:
    """Mann-Whitney: U of the second sample and the p-value by the normal approximation, ties corrected."""
    both = np.concatenate([x, y])
    _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
    ranks = (np.cumsum(counts) - (counts - 1) / 2.0)[inverse]
    n1, n2, n = len(x), len(y), len(both)
    u1 = n1 * n2 + n1 * (n1 + 1) / 2.0 - ranks[:n1].sum()
    u2 = n1 * n2 - u1
    ties = 1.0 - float((counts.astype(float) ** 3 - counts).sum()) / (n**3 - n)
    spread = math.sqrt(ties * n1 * n2 * (n + 1) / 12.0)
    if not spread:
        raise ValueError("all values are equal")
    middle = n1 * n2 / 2.0 + (0.5 if continuity else 0.0)
    z = {"less": u1 - middle, "greater": u2 - middle, "two-sided": abs(max(u1, u2) - middle)}[alternative] / spread
    return float(u2), (2.0 if alternative == "two-sided" else 1.0) * 0.5 * math.erfc(z / math.sqrt(2.0))


def step_test(a: np.ndarray, i: int) -> float:
    """The rank test on the values at which runs end, left and right of place i."""
    left, right = a[:i], a[i:]
    left, right = left[:-1][np.diff(left) != 0], right[:-1][np.diff(right) != 0]
    if not len(left) or not len(right) or len(np.unique(np.concatenate([left, right]))) == 1:
        return 1.0
    return rank_test(left, right)[1]


def change_points(a: np.ndarray, pvalue: float = 0.05, fold: float = 0.8, least: int = LEAST, window: int = 11, kind: str = "hanning", compat: bool = False) -> list[dict]:
    """Places where the level changes: index, extent of the slope, p-value, fold change, sign.

    With ``compat`` the start and end of a change leave out the segment's offset.
    """
    a = np.asarray(a, float)
    if len(a) < window:
        return []
    slope: np.ndarray | None = None
    out: list[dict] = []
    todo = [(0, len(a))]
    while todo:  # preorder: a segment, then its left and its right part
        low, high = todo.pop()
        part = a[low:high]
        if len(part) < least:
            continue
        _, i = split_point(part)
        if i <= 1:
            continue
        p = step_test(part, i)
        if p >= pvalue:
            continue
        small, large = sorted((part[:i].mean(), part[i:].mean()))
        if small / large >= fold:
            continue
        if slope is None:
            slope = np.sign(np.gradient(smooth(a, window, kind)))
        at = low + i
        sign = slope[at]
        if not sign:
            continue
        j = k = 0
        while at - j >= 0 and slope[at - j] == sign:
            j += 1
        while at + k < len(slope) and slope[at + k] == sign:
            k += 1
        base = i if compat else at
        out.append({"index": at, "pos": at, "start": base - j, "end": base + k, "dist_left": j, "dist_right": k, "pvalue": p, "foldchange": small / large, "sign": int(sign)})
        if at + k < high:
            todo.append((at + k, high))
        if i - j > 0:
            todo.append((low, at - j))
    return out


def permuted_steps(x: np.ndarray, rounds: int = 10, seed: int = 0) -> np.ndarray:
    """Signals with the steps of ``x`` at random places, one a row: rises count before theirs, falls from theirs on."""
    rng = np.random.default_rng(seed)
    steps = np.diff(x)
    rises, falls = steps[steps > 0], steps[steps < 0]
    out = np.empty((rounds, len(x)))
    for row in out:
        before, after = np.zeros(len(x)), np.zeros(len(x))
        before[rng.choice(len(x), len(rises), replace=False)] = rises
        after[rng.choice(len(x), len(falls), replace=False)] = falls
        row[:] = x[0] + before.sum() - np.cumsum(before) + np.cumsum(after)
    return out
