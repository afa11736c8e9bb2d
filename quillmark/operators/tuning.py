"""Guided search of settings: Parzen densities of good and of other trials.

Trials so far are split into the best few and the rest.  For every parameter a
density is laid over the values of either part, candidates are drawn from that
of the good ones, and the one is tried where good values are densest compared
with others.  What the densities hold are the trials of one study, so this is
done on the driver; trials are fitted and scored as Spark jobs, a batch at a
time.
"""

from __future__ import annotations

import math
import random
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

Space = dict[str, tuple]
#: Trials drawn at random first, candidates for each value, and the share and
#: most of the trials that count as good.
STARTUP, CANDIDATES, GOOD_SHARE, MOST_GOOD = 10, 24, 0.1, 25


class Density:
    """Normal kernels at values of an interval, cut off at its ends, as wide as
    the gaps between them, and one over the whole interval."""

    def __init__(self, values: list[float], low: float, high: float) -> None:
        self.low, self.high = low, high
        span = high - low
        self.kernels = []
        points = sorted([*values, (low + high) / 2])
        for v in values:
            at = points.index(v)
            gaps = [points[at] - (points[at - 1] if at else low), (points[at + 1] if at + 1 < len(points) else high) - points[at]]
            self.kernels.append((v, min(max(*gaps, span / min(100, len(values) + 2)), span)))
        self.kernels.append(((low + high) / 2, span))

    def draw(self, rng: random.Random) -> float:
        centre, width = rng.choice(self.kernels)
        while not self.low <= (x := rng.gauss(centre, width)) <= self.high:
            pass
        return x

    def __call__(self, x: float) -> float:
        def below(centre: float, width: float, at: float) -> float:
            return 0.5 * (1 + math.erf((at - centre) / (width * math.sqrt(2))))

        each = (math.exp(-0.5 * ((x - c) / w) ** 2) / (w * (below(c, w, self.high) - below(c, w, self.low))) for c, w in self.kernels)
        return sum(each) / len(self.kernels)


class Shares:
    """Smoothed shares of the choices among values."""

    def __init__(self, values: list, choices: tuple) -> None:
        self.choices = choices
        self.weights = [1 + values.count(c) for c in choices]

    def draw(self, rng: random.Random) -> object:
        return rng.choices(self.choices, self.weights)[0]

    def __call__(self, value: object) -> float:
        return self.weights[self.choices.index(value)] / sum(self.weights)


def _scale(kind: str, span: tuple) -> tuple[Callable, Callable, float, float]:
    """Into and out of the scale on which densities are laid, and its ends."""
    if kind == "log":
        return math.log, math.exp, math.log(span[0]), math.log(span[1])
    if kind == "int":
        return float, lambda x: min(max(round(x), span[0]), span[1]), span[0] - 0.5, span[1] + 0.5
    return float, float, *map(float, span)


class Sampler:
    """Settings of a space one after the other, from what was told of others.
    A space names for each parameter its kind (int, float, log or choice) and
    its ends or choices."""

    def __init__(self, space: Space, seed: int = 42, startup: int = STARTUP) -> None:
        self.space, self.startup = space, startup
        self.rng = random.Random(seed)
        self.told: list[tuple[dict, float]] = []

    def tell(self, params: dict, value: float) -> None:
        self.told.append((params, value))

    def ask(self, pending: tuple[dict, ...] = ()) -> dict:
        """The next setting; those still being tried count among the others, so
        a batch isn't one setting many times."""
        if len(self.told) < self.startup:
            return {name: self._any(*what) for name, what in self.space.items()}
        ranked = sorted(self.told, key=lambda t: -t[1])
        n = min(math.ceil(GOOD_SHARE * len(ranked)), MOST_GOOD)
        good, rest = [p for p, _ in ranked[:n]], [p for p, _ in ranked[n:]] + list(pending)
        return {name: self._best(name, good, rest, *what) for name, what in self.space.items()}

    def _any(self, kind: str, *span: object) -> object:
        if kind == "choice":
            return self.rng.choice(span)
        _, out, low, high = _scale(kind, span)
        return out(self.rng.uniform(low, high))

    def _best(self, name: str, good: list[dict], rest: list[dict], kind: str, *span: object) -> object:
        into, out = (lambda v: v), (lambda v: v)
        if kind == "choice":
            one, two = (Shares([p[name] for p in part], span) for part in (good, rest))
        else:
            into, out, low, high = _scale(kind, span)
            one, two = (Density([into(p[name]) for p in part], low, high) for part in (good, rest))
        drawn = [one.draw(self.rng) for _ in range(CANDIDATES)]
        return out(max(drawn, key=lambda v: one(v) / two(v)))


def study(space: Space, score: Callable[[dict], float], trials: int = 50, batch: int = 1, seed: int = 42, startup: int = STARTUP) -> list[tuple[dict, float]]:
    """All trials and their scores, best first; ``batch`` at a time."""
    sampler = Sampler(space, seed, startup)
    with ThreadPoolExecutor(max(1, batch)) as pool:
        while len(sampler.told) < trials:
            some: list[dict] = []
            for _ in range(min(batch, trials - len(sampler.told))):
                some.append(sampler.ask(tuple(some)))
            for params, value in zip(some, list(pool.map(score, some)), strict=True):
                sampler.tell(params, value)
    return sorted(sampler.told, key=lambda t: -t[1])
