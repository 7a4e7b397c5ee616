"""Statistics of small benchmark samples, on the driver."""

from __future__ import annotations

import numpy as np


def percentile(values: list[float], q: float) -> float:
    """Linear percentile, q between 0 and 100."""
    return float(np.percentile(np.asarray(values, float), q)) if len(values) else float("nan")


def paired_bootstrap(before: list[float], after: list[float], rounds: int = 2_000, confidence: float = 0.95, seed: int = 0) -> tuple[float, float, float]:
    """(mean difference after - before, low, high) by resampling pairs."""
    d = np.asarray(after, float) - np.asarray(before, float)
    if not len(d):
        return (float("nan"),) * 3
    means = np.random.default_rng(seed).choice(d, (rounds, len(d))).mean(axis=1)
    tail = (1 - confidence) / 2 * 100
    return float(d.mean()), float(np.percentile(means, tail)), float(np.percentile(means, 100 - tail))


def zero_failure_bound(n: int, confidence: float = 0.95) -> float:
    """Least success rate that n trials without a failure show at a confidence: (1 - c) ** (1 / n)."""
    return (1 - confidence) ** (1 / n) if n > 0 else 0.0
