"""Probabilities of the usual test statistics, from a handful of numbers."""

from __future__ import annotations

import functools
import math
from fractions import Fraction
from statistics import NormalDist

_NORMAL = NormalDist()


def normal_upper(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def normal_quantile(p: float) -> float:
    return _NORMAL.inv_cdf(p)


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta I_x(a, b), by Lentz's continued fraction."""
    if x <= 0 or math.isnan(x):
        return 0.0 if x <= 0 else math.nan
    if x >= 1:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - beta_share(b, a, 1 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    value = d
    for m in range(1, 10_000):
        for top in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1 + top * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + top / c
            c = c if abs(c) > tiny else tiny
            value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value / a


def gamma_upper(a: float, x: float) -> float:
    """Regularised upper incomplete gamma Q(a, x): series below a + 1, fraction above."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-16:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    value = d
    for i in range(1, 10_000):
        top = -i * (i - a)
        b += 2
        d = 1 / (top * d + b or tiny)
        c = b + top / c or tiny
        value *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * value


def t_two_sided(t: float, dof: float) -> float:
    if math.isinf(t):
        return 0.0
    return beta_share(dof / 2, 0.5, dof / (dof + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    if math.isinf(f):
        return 0.0
    return beta_share(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, dof: float) -> float:
    return gamma_upper(dof / 2, x / 2)


def correlation_p(r: float, n: int) -> float:
    """Two-sided p of a correlation under the t distribution."""
    if n <= 2:
        return 1.0
    if abs(r) >= 1:
        return 0.0
    dof = n - 2
    return t_two_sided(r * math.sqrt(dof / ((1 - r) * (1 + r))), dof)


@functools.cache
def _bounded_partitions(m: int) -> tuple[int, list[int]]:
    """L and the coefficients of (1 - q^L)^(m+1) / ((1 - q) (1 - q) (1 - q^2) ... (1 - q^m)),
    L being divisible by 1 to m: a polynomial, as L / i steps of i make one of L."""
    period = math.lcm(*range(1, m + 1))
    counts = [1]
    for i in (1, *range(1, m + 1)):
        longer = [0] * (len(counts) + period - i)
        for k in range(len(longer)):
            # A running sum of every i-th coefficient over one period.
            longer[k] = (longer[k - i] if k >= i else 0) + (counts[k] if k < len(counts) else 0)
            if k >= period and k - period < len(counts):
                longer[k] -= counts[k - period]
        counts = longer
    return period, counts


def _partitions_upto(x: int, m: int) -> int:
    """Number of ways to write a number of at most x as a sum of parts of at most m."""
    if x < 0:
        return 0
    period, counts = _bounded_partitions(m)
    return sum(counts[s] * math.comb((x - s) // period + m, m) for s in range(x % period, min(x + 1, len(counts)), period))


def rank_sum_upto(u: int, m: int, n: int) -> int:
    """Number of orderings of m and n items with U of at most u (no ties), in closed form.

    The orderings by U are the coefficients of the Gaussian binomial
    prod (1 - q^(n+i)) / (1 - q^i), i = 1..m. Its numerator has few terms for a small m, and
    the rest counts partitions, a polynomial in u for each remainder: the cost does not
    depend on n.
    """
    m, n = min(m, n), max(m, n)
    terms = {0: 1}
    for i in range(1, m + 1):
        for shift, weight in list(terms.items()):
            terms[shift + n + i] = terms.get(shift + n + i, 0) - weight
    return sum(weight * _partitions_upto(u - shift, m) for shift, weight in terms.items() if weight)


def rank_sum_upper(u: float, m: int, n: int) -> float:
    """P(U >= u) without ties; the distribution is symmetric around m n / 2."""
    at_least = math.ceil(u)
    if at_least <= 0:
        return 1.0
    upper = Fraction(rank_sum_upto(m * n - at_least, m, n), math.comb(m + n, min(m, n)))
    return float(upper)


def inversions_two_sided(c: int, n: int) -> float:
    """Exact two-sided p of Kendall's test: twice the share of permutations of n
    with at most c inversions, where c is the smaller of both tails."""
    if 4 * c >= n * (n - 1):
        return 1.0
    if c == 0:
        return min(1.0, math.exp(math.log(2) - math.lgamma(n + 1)))
    if c == 1:
        return min(1.0, math.exp(math.log(2) - math.lgamma(n)))
    ways = [1] + [0] * c
    for j in range(2, n + 1):
        running, longer = 0, []
        for k in range(c + 1):
            running += ways[k]
            if k >= j:
                running -= ways[k - j]
            longer.append(running)
        ways = longer
    return min(1.0, 2 * sum(ways) / math.factorial(n))


# Polynomial coefficients of the W test approximation (Royston 1995).
W_LARGEST = [0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056]
W_SECOND = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
W_SMALL_MEAN = [0.544, -0.39978, 0.025054, -6.714e-4]
W_SMALL_SPREAD = [1.3822, -0.77857, 0.062767, -0.0020322]
W_LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
W_LARGE_SPREAD = [-0.4803, -0.082676, 0.0030302]
W_GAMMA = [-2.273, 0.459]


def _poly(coefficients: list[float], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def shapiro_wilk(values) -> tuple[float, float]:
    """W statistic and p-value of 3 to 5000 values."""
    import numpy as np

    x = np.sort(np.asarray(values, dtype=float))
    n = len(x)
    if x[-1] - x[0] < 1e-19:
        return 1.0, 1.0
    scores = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        weights = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        norm = float(scores @ scores)
        root = 1 / math.sqrt(n)
        last = _poly(W_LARGEST, root) + scores[-1] / math.sqrt(norm)
        weights = np.empty(n)
        if n > 5:
            second = _poly(W_SECOND, root) + scores[-2] / math.sqrt(norm)
            scale = math.sqrt(
                (norm - 2 * scores[-1] ** 2 - 2 * scores[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
            )
            weights[:] = scores / scale
            weights[-2], weights[1] = second, -second
        else:
            scale = math.sqrt((norm - 2 * scores[-1] ** 2) / (1 - 2 * last**2))
            weights[:] = scores / scale
        weights[-1], weights[0] = last, -last
    centred = x - x.mean()
    w = min(1.0, float(weights @ centred) ** 2 / float(centred @ centred))
    if n == 3:
        p = 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))
        return w, min(1.0, max(0.0, p))
    if w >= 1:
        return w, 1.0
    y = math.log1p(-w)
    if n <= 11:
        gamma = _poly(W_GAMMA, n)
        if y >= gamma:
            return w, 1e-99
        y = -math.log(gamma - y)
        mean, spread = _poly(W_SMALL_MEAN, n), math.exp(_poly(W_SMALL_SPREAD, n))
    else:
        logn = math.log(n)
        mean, spread = _poly(W_LARGE_MEAN, logn), math.exp(_poly(W_LARGE_SPREAD, logn))
    return w, normal_upper((y - mean) / spread)
