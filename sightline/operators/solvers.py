"""Minimisation of smooth functions whose values and gradients are computed by Spark."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable

import numpy as np

Objective = Callable[[np.ndarray], tuple[float, np.ndarray]]


def lbfgs(objective: Objective, start: np.ndarray, iterations: int = 100, tolerance: float = 1e-6, memory: int = 10) -> tuple[np.ndarray, float, np.ndarray]:
    """(point, value, gradient) where the gradient's norm is at most ``tolerance`` times max(1, that at the start).

    Limited-memory BFGS; every trial of a step is one call of ``objective``, one Spark job, mostly one an iteration. A step is
    halved until the value falls enough, or doubled while the slope still falls steeply; pairs without positive curvature are left out.
    """
    x = np.asarray(start, float)
    value, slope = objective(x)
    least = tolerance * max(1.0, float(np.linalg.norm(slope)))
    past: deque[tuple[np.ndarray, np.ndarray, float]] = deque(maxlen=memory)
    for _ in range(iterations):
        if np.linalg.norm(slope) <= least:
            break
        way, shares = -slope, []
        for s, y, r in reversed(past):
            shares.append(r * (s @ way))
            way = way - shares[-1] * y
        if past:
            s, y, r = past[-1]
            way = way / (r * (y @ y))
        else:
            way = way / max(1.0, float(np.linalg.norm(slope)))
        for (s, y, r), a in zip(past, reversed(shares), strict=True):
            way = way + s * (a - r * (y @ way))
        fall = float(slope @ way)
        if fall >= 0:
            past.clear()
            continue
        low, high, step = 0.0, np.inf, 1.0
        found = None
        for _ in range(30):
            at = objective(x + step * way)
            if not np.isfinite(at[0]) or at[0] > value + 1e-4 * step * fall:
                high = step
            else:
                found = (step, *at)
                if float(at[1] @ way) >= 0.9 * fall:
                    break
                low = step
            step = 2 * low if high == np.inf else (low + high) / 2
        if found is None:
            break
        step, new, turned = found
        s, y = step * way, turned - slope
        if s @ y > 1e-12 * float(np.linalg.norm(s) * np.linalg.norm(y)):
            past.append((s, y, 1 / float(s @ y)))
        x, value, slope = x + s, new, turned
    return x, value, slope
