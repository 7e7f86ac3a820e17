"""Least squares of ARMA models over pieces of a series.

The errors of a model and their derivatives follow one linear recursion, so a piece of the
series acts on the state at its start as an affine map, and the products of errors and
derivatives that it adds are a quadratic form in that state. Maps and forms of neighbouring
pieces compose: a pass looks at all pieces at once, whatever the length of the series.
Inside a piece the same is done with lanes of equal length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LANE = 256  # values of a lane, whose steps are walked side by side with those of all others
DAMPINGS = (0.0, 1.0, 100.0, 10_000.0)  # of one pass, times the current damping
ENOUGH = 1e-10  # share of the loss that a step must win
MAX_PASSES = 40
Summary = tuple[np.ndarray, np.ndarray]  # map of the state (with a last 1), products as a form in it


@dataclass(frozen=True)
class Orders:
    p: int
    q: int
    mean: bool

    @property
    def size(self) -> int:
        return int(self.mean) + self.p + self.q

    def split(self, theta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        start = int(self.mean)
        return float(theta[0]) if self.mean else 0.0, theta[start : start + self.p], theta[start + self.p :]

    def blocks(self) -> dict[str, tuple[int, int]]:
        """Where the state holds the last errors, and the last derivatives by the first
        autoregressive weight, the first moving-average weight and the mean. Derivatives by
        later weights are earlier values of the first."""
        sizes = {"e": max(self.q, 1), "ar": max(self.p, self.q) if self.p else 0, "ma": self.q, "mean": max(self.q, 1) if self.mean else 0}
        at, out = 0, {}
        for name, size in sizes.items():
            out[name] = (at, at + size)
            at += size
        return out

    def outputs(self) -> list[int]:
        """Places of the error and its derivatives, in the order of theta, in the state."""
        b = self.blocks()
        return [0, *([b["mean"][0]] if self.mean else []), *range(b["ar"][0], b["ar"][0] + self.p), *range(*b["ma"])]

    def step(self, theta: np.ndarray) -> np.ndarray:
        """The state's linear step."""
        _, _, ma = self.split(theta)
        b = self.blocks()
        n = b["mean"][1]
        matrix = np.zeros((n, n))
        for low, high in b.values():
            if high > low:
                matrix[low, low : low + self.q] = -ma
                for row in range(low + 1, high):
                    matrix[row, row - 1] = 1.0
        if self.q:
            matrix[b["ma"][0], 0] -= 1.0  # the first weight's derivative takes in the last error
        return matrix


def stable(weights: np.ndarray) -> bool:
    """All roots of 1 - w1 z - w2 z^2 ... outside the unit circle."""
    if not len(weights):
        return True
    return bool(np.isfinite(weights).all() and np.all(np.abs(np.roots(np.r_[1.0, -weights])) < 0.9999))


def summarise(values: np.ndarray, context: int, start: int, theta: np.ndarray, orders: Orders) -> Summary:
    """Map and form of a piece: `values` with `context` earlier ones in front, the first own
    value having index `start` in the series. Nothing before the series deviates from the
    mean; the first p errors do not count."""
    mean, ar, _ = orders.split(theta)
    blocks, outputs = orders.blocks(), orders.outputs()
    size, n = blocks["mean"][1], len(values) - context
    centred = np.concatenate([np.zeros(max(0, orders.p + 1 - context)), values - mean])
    own = len(centred) - n
    part = centred[own:].copy()
    for lag, weight in enumerate(ar, 1):
        part -= weight * centred[own - lag : len(centred) - lag]
    force = np.zeros((n, size))
    force[:, 0] = part
    if orders.p:
        force[:, blocks["ar"][0]] = -centred[own - 1 : len(centred) - 1]
    if orders.mean:
        index = start + np.arange(n)
        force[:, blocks["mean"][0]] = -1.0
        for lag, weight in enumerate(ar, 1):
            force[:, blocks["mean"][0]] += np.where(index >= lag, weight, 0.0)
    whole = n // LANE * LANE
    maps, form = np.eye(size + 1), np.zeros((len(outputs) * (size + 1),) * 2)
    for low, high, lane in ((0, whole, LANE), (whole, n, n - whole)):
        if high > low:
            uncounted = max(0, min(high - low, orders.p - start - low))
            maps, form = compose((maps, form), _lanes(force[low:high].reshape(-1, lane, size), uncounted, theta, orders))
    return maps, form


def _lanes(force: np.ndarray, uncounted: int, theta: np.ndarray, orders: Orders) -> Summary:
    lanes, steps, size = force.shape
    matrix, outputs = orders.step(theta), orders.outputs()
    state, answer = np.zeros((lanes, size)), np.eye(size)  # from nothing, and from each unit state
    found, answers = np.empty((lanes, steps, len(outputs))), np.empty((steps, len(outputs), size))
    for t in range(steps):
        state = state @ matrix.T + force[:, t]
        answer = matrix @ answer
        found[:, t] = state[:, outputs]
        answers[t] = answer[outputs]
    entry = np.empty((lanes, size, size + 1))  # a lane's first state from the first lane's
    now = np.eye(size, size + 1)
    for lane in range(lanes):
        entry[lane] = now
        now = answer @ now
        now[:, -1] += state[lane]
    response = np.einsum("tki,lij->ltkj", answers, entry, optimize=True)
    response[..., -1] += found
    flat = response.reshape(lanes * steps, -1)[uncounted:]
    return np.vstack([now, np.eye(size + 1)[-1:]]), flat.T @ flat


def compose(first: Summary, second: Summary) -> Summary:
    """Summary of two neighbours."""
    n = len(first[0])
    k = len(first[1]) // n
    form = second[1].reshape(k, n, k, n)
    moved = np.einsum("aibj,im,jn->ambn", form, first[0], first[0], optimize=True).reshape(k * n, k * n)
    return second[0] @ first[0], first[1] + moved


def settle_state(summary: Summary) -> tuple[np.ndarray, np.ndarray]:
    """Products of error and derivatives over a whole series, and its last state."""
    n = len(summary[0])
    k = len(summary[1]) // n
    return summary[1].reshape(k, n, k, n)[:, -1, :, -1], summary[0][:-1, -1]


@dataclass
class Fit:
    """Damped Gauss-Newton steps towards the least squares, one pass over the series each."""

    orders: Orders
    trials: list[list[float]] = field(default_factory=list)
    theta: list[float] | None = None
    products: list[list[float]] | None = None
    state: list[float] | None = None
    damping: float = 1e-3
    passes: int = 0
    done: bool = False

    @classmethod
    def begin(cls, orders: Orders, mean: float) -> Fit:
        return cls(orders, [([mean] if orders.mean else []) + [0.0] * (orders.p + orders.q)])

    @property
    def loss(self) -> float:
        return np.inf if self.products is None else self.products[0][0]

    def update(self, summaries: list[Summary]) -> None:
        """Take the best of the trials, and think of the next ones."""
        before = self.loss
        self.passes += 1
        for theta, summary in zip(self.trials, summaries, strict=True):
            products, state = settle_state(summary)
            if products[0, 0] < self.loss:
                self.theta, self.products, self.state = theta, products.tolist(), state.tolist()
        won = before - self.loss
        if self.loss < before:
            self.damping = max(self.damping / 10, 1e-12)
        else:
            self.damping *= 1e5
        small = self.loss < before < np.inf and won <= ENOUGH * before
        self.done = small or not self.orders.size or self.damping > 1e12 or self.passes >= MAX_PASSES or self.loss == 0.0 or self.theta is None
        self.trials = [] if self.done else self._steps()
        self.done = not self.trials

    def _steps(self) -> list[list[float]]:
        products, theta = np.array(self.products), np.array(self.theta)
        normal, pull = products[1:, 1:], products[1:, 0]
        out = []
        for factor in DAMPINGS:
            damped = normal + self.damping * factor * np.diag(np.diag(normal) + 1e-12)
            move = np.linalg.lstsq(damped, -pull, rcond=None)[0]
            for _ in range(30):
                trial = theta + move
                _, ar, ma = self.orders.split(trial)
                if stable(ar) and stable(-ma):
                    if not any(np.array_equal(trial, o) for o in [theta, *out]):
                        out.append(trial)
                    break
                move = move / 2
        return [t.tolist() for t in out]


def fit(values: np.ndarray, orders: Orders) -> Fit:
    """Fit a series that is at hand as a whole."""
    found = Fit.begin(orders, float(values.mean()))
    while not found.done:
        found.update([summarise(values, 0, 0, np.array(t), orders) for t in found.trials])
    return found
