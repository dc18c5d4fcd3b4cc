"""Small square matrices as columns ``array<array<double>>``, rows first, and their exponentials, on the JVM."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from cladewise.functions import scalars as S

TERMS, MOST_HALVINGS = 16, 64


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body or a lambda in it needs it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def identity(k: int) -> Column:
    return F.array(*[F.array(*[F.lit(float(a == b)) for b in range(k)]) for a in range(k)])


def scaled(a: Column, by: Column) -> Column:
    return let(by, lambda f: F.transform(a, lambda row: F.transform(row, lambda v: v * f)))


def added(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda r, s: F.zip_with(r, s, lambda x, y: x + y))


def transposed(a: Column, k: int) -> Column:
    return let(a, lambda m: F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda j: F.transform(m, lambda row: F.get(row, j))))


def times(a: Column, b_transposed: Column) -> Column:
    """The product of ``a`` with the matrix whose transpose is given."""
    return let(b_transposed, lambda b: F.transform(a, lambda row: F.transform(b, lambda col: S.dot(row, col))))


def apply(a: Column, x: Column) -> Column:
    return let(x, lambda v: F.transform(a, lambda row: S.dot(row, v)))


def apply_left(x: Column, a: Column, k: int) -> Column:
    return apply(transposed(a, k), x)


def cholesky(a: Column, k: int) -> Column:
    """Rows of the lower triangle L with L L' = ``a``, each as long as it has entries; null or not a number where ``a`` is not positive definite."""

    def row(m: Column, rows: Column, i: Column) -> Column:
        def entry(done: Column, j: Column) -> Column:
            left = F.get(F.get(m, i), j)
            off = F.try_divide(left - S.dot(done, F.slice(F.get(rows, j), F.lit(1), j)), F.get(F.get(rows, j), j))
            return F.concat(done, F.array(F.when(j < i, off).otherwise(F.sqrt(left - S.dot(done, done)))))

        return F.aggregate(F.sequence(F.lit(0), i), F.array().cast("array<double>"), entry)

    empty = F.array().cast("array<array<double>>")
    return let(a, lambda m: F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), empty, lambda rows, i: F.concat(rows, F.array(row(m, rows, i)))))


def forward(lower: Column, b: Column, k: int) -> Column:
    """The y with L y = ``b`` for the rows of a lower triangle."""
    step = lambda y, i: F.concat(y, F.array(F.try_divide(F.get(b, i) - S.dot(y, F.slice(F.get(lower, i), F.lit(1), i)), F.get(F.get(lower, i), i))))
    return F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.array().cast("array<double>"), step)


def backward(lower: Column, y: Column, k: int) -> Column:
    """The x with L' x = ``y``."""

    def step(x: Column, i: Column) -> Column:
        under = F.transform(F.slice(lower, i + 2, k - 1 - i), lambda row: F.get(row, i))
        return F.concat(F.array(F.try_divide(F.get(y, i) - S.dot(under, x), F.get(F.get(lower, i), i))), x)

    return F.aggregate(F.sequence(F.lit(k - 1), F.lit(0), F.lit(-1)), F.array().cast("array<double>"), step)


def log_det(lower: Column) -> Column:
    """Log determinant of L L'."""
    return 2.0 * S.total(F.transform(lower, lambda row: F.log(F.get(row, F.size(row) - 1))))


def exponential(q: Column, t: Column, k: int, turns: Column | None = None) -> Column:
    """Struct ``p``, exp(q t), and ``d``, its slopes by the rate matrix's slopes ``turns`` (an array of matrices).

    Uniformisation: with a rate above all of leaving, the chain is a jump chain
    at that rate, so the exponential is a mean of powers of one matrix of
    probabilities, all terms positive. The time is halved until that rate is
    one half at most, and the result squared as often; slopes follow both by the product rule.
    """
    leave = F.array_max(F.transform(q, lambda row: -F.array_min(row))) * t
    halvings = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(leave, F.lit(1e-300)))) + 1).cast("int")
    none = turns if turns is not None else F.array().cast("array<array<array<double>>>")
    rate = 0.5

    def sums(jump: Column, turn: Column, zero: Column) -> Column:
        def term(acc: Column, n: Column) -> Column:
            share = rate / n

            def joined(next_t: Column) -> Column:
                d = F.zip_with(acc["td"], turn, lambda d, by: scaled(added(times(d, jump), times(acc["t"], by)), share))
                return let(d, lambda next_d: F.struct(next_t.alias("t"), next_d.alias("td"), added(acc["p"], next_t).alias("p"), F.zip_with(acc["d"], next_d, added).alias("d")))

            return let(scaled(times(acc["t"], jump), share), joined)

        start = F.struct(identity(k).alias("t"), zero.alias("td"), identity(k).alias("p"), zero.alias("d"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(TERMS)), start, term)

    def square(acc: Column, _: Column) -> Column:
        slopes = lambda p_t: F.transform(acc["d"], lambda m: added(times(m, p_t), times(acc["p"], transposed(m, k))))
        return let(transposed(acc["p"], k), lambda p_t: F.struct(times(acc["p"], p_t).alias("p"), slopes(p_t).alias("d")))

    def whole(small: Column) -> Column:
        jump = transposed(added(identity(k), scaled(q, small / rate)), k)
        turn = F.transform(none, lambda m: transposed(scaled(m, small / rate), k))
        zero = F.transform(none, lambda m: scaled(m, F.lit(0.0)))
        found = let(jump, lambda j: let(turn, lambda u: let(zero, lambda z: sums(j, u, z))))
        weight = F.exp(F.lit(-rate))
        first = let(found, lambda x: F.struct(scaled(x["p"], weight).alias("p"), F.transform(x["d"], lambda m: scaled(m, weight)).alias("d")))
        return F.aggregate(F.slice(F.sequence(F.lit(1), F.lit(MOST_HALVINGS)), F.lit(1), halvings), first, square)

    return let(t / F.pow(F.lit(2.0), halvings), whole)


def reversible(rates: Column, freqs: Column, k: int, normal: bool) -> Column:
    """Rate matrix from exchange rates of the pairs of states in order and frequencies; ``normal``: one change a unit of time expected."""
    off = lambda a, b: F.get(rates, F.lit(_place(a, b, k))) * F.get(freqs, F.lit(b))
    rows = [[off(a, b) if a != b else None for b in range(k)] for a in range(k)]
    full = F.array(*[F.array(*[x if x is not None else -_sum([y for y in row if y is not None]) for x in row]) for row in rows])
    return scaled(full, 1.0 / changes(rates, freqs, k)) if normal else full


def changes(rates: Column, freqs: Column, k: int) -> Column:
    """Changes expected in a unit of time before rates are made normal."""
    return _sum([2.0 * F.get(rates, F.lit(_place(a, b, k))) * F.get(freqs, F.lit(a)) * F.get(freqs, F.lit(b)) for a in range(k) for b in range(a + 1, k)])


def reversible_turns(rates: Column, freqs: Column, k: int, normal: bool) -> Column:
    """Slopes of :func:`reversible` in each exchange rate."""
    q, c = reversible(rates, freqs, k, normal), changes(rates, freqs, k)
    out = []
    for i in range(k):
        for j in range(i + 1, k):
            cell = {(i, j): F.get(freqs, F.lit(j)), (j, i): F.get(freqs, F.lit(i)), (i, i): -F.get(freqs, F.lit(j)), (j, j): -F.get(freqs, F.lit(i))}
            own = F.array(*[F.array(*[cell.get((a, b), F.lit(0.0)) for b in range(k)]) for a in range(k)])
            fall = -2.0 * F.get(freqs, F.lit(i)) * F.get(freqs, F.lit(j)) / c
            out.append(added(scaled(own, 1.0 / c), scaled(q, fall)) if normal else own)
    return F.array(*out)


def modes(rates: list[float], freqs: list[float], normal: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``right, left, roots, turned`` of a reversible model whose frequencies are above zero: its rate matrix is right diag(roots) left, roots ascending.

    ``turned``: the rate matrix's slopes in each exchange rate between these bases, left slope right.
    """
    pi, k = np.asarray(freqs, float), len(freqs)
    pairs = [(a, b) for a in range(k) for b in range(a + 1, k)]
    full = np.zeros((k, k))
    for (a, b), rate in zip(pairs, rates):
        full[a, b], full[b, a] = rate * pi[b], rate * pi[a]
    np.fill_diagonal(full, -full.sum(1))
    c = 2.0 * sum(rate * pi[a] * pi[b] for (a, b), rate in zip(pairs, rates)) if normal else 1.0
    full /= c
    root = np.sqrt(pi)
    even = root[:, None] * full / root
    roots, v = np.linalg.eigh((even + even.T) / 2)
    right, left, turned = v / root[:, None], v.T * root, []
    for a, b in pairs:
        own = np.zeros((k, k))
        own[a, b], own[b, a], own[a, a], own[b, b] = pi[b], pi[a], -pi[b], -pi[a]
        turned.append(left @ (own / c - full * (2.0 * pi[a] * pi[b] / c if normal else 0.0)) @ right)
    return right, left, roots, np.array(turned)


def _place(a: int, b: int, k: int) -> int:
    a, b = min(a, b), max(a, b)
    return a * (2 * k - a - 1) // 2 + b - a - 1


def _sum(parts: list[Column]) -> Column:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out
