"""Closed-form test statistics as Column expressions (no SciPy; evaluated JVM-side per group)."""
from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c):
    return F.col(c) if isinstance(c, str) else c


def _series(m: Column, ratio) -> Column:
    """1 + sum_{k=1..m} prod_{j<=k} ratio(j)  (running product by ``aggregate``; empty when m < 1)."""
    ks = F.when(m >= 1, F.sequence(F.lit(1), m.cast("int"))).otherwise(F.array().cast("array<int>"))
    init = F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("total"))

    def step(acc, k):
        term = acc["term"] * ratio(k)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))
    return F.aggregate(ks, init, step, lambda acc: acc["total"])


def t_two_sided_p(t, df) -> Column:
    """Two-sided p-value of Student's t with integer degrees of freedom (finite trigonometric sums)."""
    t, v = F.abs(_col(t)), _col(df).cast("int")
    theta = F.atan(t / F.sqrt(v.cast("double")))
    s, c = F.sin(theta), F.cos(theta)
    c2 = c * c
    even = s * _series((v - 2) / 2, lambda k: (2 * k - 1) / (2 * k) * c2)
    odd_gt1 = (2 / math.pi) * (theta + s * c * _series((v - 3) / 2, lambda k: (2 * k) / (2 * k + 1) * c2))
    inside = F.when(v % 2 == 0, even).when(v == 1, 2 * theta / math.pi).otherwise(odd_gt1)
    return F.when(v >= 1, F.greatest(F.lit(0.0), 1 - inside))


def signed_rank_exact_p(w, n) -> Column:
    """Exact two-sided p of the signed-rank statistic w = min(W+, W-) for n untied non-zero differences:
    2 * P(W <= w) under the null, by a dynamic program over the subset-sum counts (array of n(n+1)/2 + 1)."""
    w, n = _col(w).cast("int"), _col(n).cast("int")
    top = n * (n + 1) / 2
    size = top.cast("int") + 1
    zero = F.transform(F.sequence(F.lit(0), size - 1), lambda s: F.when(s == 0, F.lit(1.0)).otherwise(F.lit(0.0)))

    def add(counts, k):
        return F.transform(counts, lambda c, s: c + F.when(s >= k, F.element_at(counts, s - k + 1)).otherwise(F.lit(0.0)))
    dist = F.aggregate(F.sequence(F.lit(1), n), zero, add)
    below = F.aggregate(F.slice(dist, 1, w + 1), F.lit(0.0), lambda a, x: a + x)
    return F.when(n >= 1, F.least(F.lit(1.0), 2 * below / F.pow(F.lit(2.0), n)))


def normal_two_sided_p(z) -> Column:
    """P(|N(0, 1)| >= |z|): the odd-factorial series up to 5, the continued fraction of the tail beyond."""
    z = F.abs(_col(z)).cast("double")
    density = F.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    series = 1 - 2 * density * z * _series(F.lit(100), lambda k: z * z / (2 * k + 1))
    tail = F.aggregate(F.sequence(F.lit(60), F.lit(1)), z, lambda a, k: z + k / a)
    return F.when(z < 5, F.greatest(F.lit(0.0), series)).when(z.isNotNull(), 2 * density / tail)


EXACT_PAIRS = 50   # up to so many untied non-zero differences the null distribution is counted (1,276 sums at most)


def signed_rank_p(w_plus, w_minus, n, zeros, ties) -> Column:
    """Two-sided p of the signed-rank test: exact for up to EXACT_PAIRS untied non-zero differences, else the normal approximation
    without the zeros, its variance less sum(t**3 - t) / 48 over groups of t ties. Null without a non-zero difference."""
    n, zeros, ties = _col(n), _col(zeros), _col(ties).cast("double")
    w = F.least(_col(w_plus), _col(w_minus))
    m = (n - zeros).cast("double")
    sd = F.sqrt(m * (m + 1) * (2 * m + 1) / 24 - ties / 48)
    z = (w - m * (m + 1) / 4) / sd
    return F.when(signed_rank_is_exact(n, zeros, ties), signed_rank_exact_p(w, n)).when(m > 0, normal_two_sided_p(z))


def signed_rank_is_exact(n, zeros, ties) -> Column:
    return (_col(zeros) == 0) & (_col(ties) == 0) & (_col(n) > 0) & (_col(n) <= EXACT_PAIRS)
