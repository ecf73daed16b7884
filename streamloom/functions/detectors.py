"""Scalar state machines of the detectors, shared by batch folds and streaming state."""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import deque
from dataclasses import dataclass, field

MASK = (1 << 64) - 1


@dataclass
class Ewma:
    """Mean and variance, both from 0; the z-score is taken before the update."""

    alpha: float
    mean: float = 0.0
    variance: float = 0.0

    def zscore(self, x: float) -> float:
        return (x - self.mean) / math.sqrt(self.variance) if self.variance > 0 else 0.0

    def update(self, x: float) -> None:
        d, keep = x - self.mean, 1.0 - self.alpha
        self.mean = keep * self.mean + self.alpha * x
        self.variance = keep * self.variance + self.alpha * d * d


@dataclass
class Cusum:
    """Two-sided CUSUM over residuals of its own moving baseline, which starts at the first value."""

    alpha: float
    k: float
    h: float
    warmup: int = 1
    count: int = 0
    mean: float = 0.0
    variance: float = 0.0
    high: float = 0.0
    low: float = 0.0

    def check(self, x: float) -> bool:
        if self.count == 0:
            self.mean, self.count = x, 1
            return False
        d, keep = x - self.mean, 1.0 - self.alpha
        r = d / math.sqrt(self.variance) if self.variance > 0 else 0.0
        self.mean = keep * self.mean + self.alpha * x
        self.variance = keep * self.variance + self.alpha * d * d
        ready, self.count = self.count >= self.warmup, self.count + 1
        if not ready:
            return False
        self.high, self.low = max(0.0, self.high + r - self.k), min(0.0, self.low + r + self.k)
        fired = self.high > self.h or self.low < -self.h
        if fired:
            self.high = self.low = 0.0
        return fired


@dataclass
class Conformal:
    """The quantile of the last `window` scores, kept sorted."""

    window: int
    order: deque = field(default_factory=deque)
    ranked: list = field(default_factory=list)

    def threshold(self, alpha: float) -> float:
        n = len(self.ranked)
        return self.ranked[min(max(math.ceil((1.0 - alpha) * n) - 1, 0), n - 1)] if n else math.inf

    def update(self, score: float) -> None:
        if self.window <= 0:
            return
        if len(self.order) == self.window:
            del self.ranked[bisect_left(self.ranked, self.order.popleft())]
        self.order.append(score)
        insort(self.ranked, score)


@dataclass
class FixedCusum:
    """A CUSUM with known mean and deviation, which fires more than min_gap values apart."""

    k: float = 0.5
    h: float = 5.0
    mu: float = 0.0
    sigma: float = 1.0
    min_gap: int = 10
    up: float = 0.0
    down: float = 0.0
    quiet: float = math.inf  # values since it fired

    def check(self, x: float) -> bool:
        z = (x - self.mu) / self.sigma
        self.up, self.down, self.quiet = max(0.0, self.up + z - self.k), max(0.0, self.down - z - self.k), self.quiet + 1
        fired = (self.up > self.h or self.down > self.h) and self.quiet > self.min_gap
        if fired:
            self.up = self.down = self.quiet = 0.0
        return fired


def fixed_cusum(xs, **options) -> list[int]:
    """Places where a FixedCusum fires."""
    detector = FixedCusum(**options)
    return [t for t, x in enumerate(xs) if detector.check(x)]


#: The increment and the two factors of SplitMix64.
GAMMA, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def splitmix64(seed: int):
    """The SplitMix64 sequence of a seed."""
    while True:
        seed = (seed + GAMMA) & MASK
        z = seed
        z = ((z ^ (z >> 30)) * MIX1) & MASK
        z = ((z ^ (z >> 27)) * MIX2) & MASK
        yield z ^ (z >> 31)


#: The offset basis and the prime of 64-bit FNV-1a.
FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3


def fnv1a(data: bytes, digest: int = FNV_BASIS) -> int:
    for b in data:
        digest = ((digest ^ b) * FNV_PRIME) & MASK
    return digest
