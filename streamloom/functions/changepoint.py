"""Bayesian online changepoint detection: the posterior over the length of the current run of a stream."""

from __future__ import annotations

import math

import numpy as np


class RunLengths:
    """Gaussian values of unknown mean and precision under a Normal-Gamma prior; a run ends with probability 1 / expected_run.

    The pseudo-counts of a run depend on its length alone, so only its mean and beta are state, and the normaliser of its
    predictive density is looked up by length. Lengths below `least` in probability go, except 0.
    """

    def __init__(self, expected_run: float = 250.0, mu: float = 0.0, kappa: float = 1.0, alpha: float = 1.0, beta: float = 1.0, least: float = 1e-6):
        if not expected_run > 1:
            raise ValueError("expected_run must exceed 1")
        self.hazard, self.least = 1.0 / expected_run, least
        self.mu, self.kappa, self.alpha, self.beta = float(mu), float(kappa), float(alpha), float(beta)
        self.table = np.empty(0)
        self.restart()

    def restart(self) -> None:
        self.lengths, self.probs = np.zeros(1, dtype=np.int64), np.ones(1)
        self.means, self.betas = np.full(1, self.mu), np.full(1, self.beta)

    def _normaliser(self) -> np.ndarray:
        """Per length, the part of the log predictive density that depends on nothing else."""
        known, need = len(self.table), int(self.lengths[-1]) + 1
        if need > known:
            more = []
            for r in range(known, max(need, 2 * known, 256)):
                a, k = self.alpha + r / 2, self.kappa + r
                more.append(math.lgamma(a + 0.5) - math.lgamma(a) - 0.5 * math.log(2 * math.pi * (k + 1) / k))
            self.table = np.concatenate([self.table, more])
        return self.table[self.lengths]

    def update(self, x: float) -> None:
        """Take a value in. A posterior without finite mass starts anew from the prior."""
        shape, count = self.alpha + self.lengths / 2, self.kappa + self.lengths
        off = x - self.means
        gain = off * off * count / (2 * (count + 1))
        joint = self.probs * np.exp(self._normaliser() - 0.5 * np.log(self.betas) - (shape + 0.5) * np.log1p(gain / self.betas))
        mass = joint.sum()
        if not (0 < mass < math.inf):
            self.restart()
            return
        joint /= mass
        probs = np.append(self.hazard, joint * (1 - self.hazard))
        keep = probs >= self.least
        keep[0] = True
        self.lengths = np.append(0, self.lengths + 1)[keep]
        self.means = np.append(self.mu, self.means + off / (count + 1))[keep]
        self.betas = np.append(self.beta, self.betas + gain)[keep]
        self.probs = probs[keep] / probs[keep].sum()

    def likeliest(self) -> int:
        return int(self.lengths[self.probs.argmax()])

    def recent(self, within: int = 5) -> float:
        """The probability that the run is at most so long."""
        return float(self.probs[: np.searchsorted(self.lengths, within, "right")].sum())


class Changepoints:
    """Fires when the run is probably at most `within` long, or when its likeliest length falls by half and by `fall` at least;
    not among the first within + 1 values, and not within min_gap of the last time."""

    def __init__(self, threshold: float = 0.5, within: int = 5, min_gap: int = 10, fall: int = 30, **model):
        self.runs = RunLengths(**model)
        self.threshold, self.within, self.min_gap, self.fall = threshold, within, min_gap, fall
        self.seen, self.quiet, self.before = 0, min_gap, 0

    def check(self, x: float) -> tuple[int, float, bool]:
        """The likeliest run length, the probability of a recent change, and whether it fires."""
        self.runs.update(x)
        now, recent = self.runs.likeliest(), self.runs.recent(self.within)
        open_ = self.seen > self.within and self.quiet >= self.min_gap
        fired = open_ and (recent > self.threshold or self.before - now >= max(self.fall, self.before // 2))
        self.seen, self.before = self.seen + 1, now
        self.quiet = 0 if fired else self.quiet + 1
        return now, recent, fired
