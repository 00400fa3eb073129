"""Exact eigenvalues of a symmetric integer matrix: characteristic polynomial, real roots, null vectors.

All of it is integer arithmetic. Polynomials are lists of integers from the highest power down, and
monic; matrices are lists of rows. Nothing here depends on the number of rows of any table.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import isqrt

import numpy as np

# Primes lie below this, so that products of two residues fit a signed 64-bit number.
PRIMES_BELOW = 1 << 31


def is_prime(n: int) -> bool:
    """Miller-Rabin; the four bases decide every number below 3.2 thousand millions."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """The largest primes whose product exceeds ``bound``."""
    found, product, n = [], 1, PRIMES_BELOW - 1
    while product <= bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def coefficient_bound(matrix: list[list[int]]) -> int:
    """More than twice any coefficient, for a matrix without negative eigenvalues.

    A coefficient is an elementary symmetric function of eigenvalues, largest where all are equal.
    """
    d = len(matrix)
    return 2 * (2 + sum(matrix[i][i] for i in range(d)) // d) ** d


def _inverses(values: np.ndarray, primes: np.ndarray) -> np.ndarray:
    """Inverses modulo the primes, by Fermat; 0 gives 0."""
    out, base, power = np.ones_like(values), values.copy(), primes - 2
    while power.any():
        out = np.where(power & 1, out * base % primes, out)
        base, power = base * base % primes, power >> 1
    return out


def residues(matrix: list[list[int]], primes: Sequence[int]) -> np.ndarray:
    """Coefficients of the characteristic polynomial modulo each prime, all primes worked on together.

    The matrix is brought to Hessenberg form by similarities; from there the leading minors'
    polynomials follow one from the other.
    """
    d, count = len(matrix), len(primes)
    p = np.array(primes, dtype=np.int64)
    a = np.array([[[x % q for x in row] for row in matrix] for q in primes], dtype=np.int64)
    p1, p2, every = p[:, None], p[:, None, None], np.arange(count)
    for k in range(d - 2):
        pivot = (a[:, k + 1 :, k] != 0).argmax(1) + k + 1
        rows = a[every, pivot].copy()
        a[every, pivot], a[:, k + 1] = a[:, k + 1].copy(), rows
        columns = a[every, :, pivot].copy()
        a[every, :, pivot], a[:, :, k + 1] = a[:, :, k + 1].copy(), columns
        f = a[:, k + 2 :, k] * _inverses(a[:, k + 1, k], p)[:, None] % p1
        a[:, k + 2 :] = (a[:, k + 2 :] - f[:, :, None] * a[:, k + 1, None, :]) % p2
        a[:, :, k + 1] = (a[:, :, k + 1] + (a[:, :, k + 2 :] * f[:, None, :] % p2).sum(2)) % p1
    # polys[k]: of the leading k by k part, from the constant up.
    polys = np.zeros((d + 1, count, d + 1), dtype=np.int64)
    polys[0, :, 0] = 1
    for k in range(1, d + 1):
        now = -a[:, k - 1, k - 1, None] * polys[k - 1] % p1
        now[:, 1:] += polys[k - 1, :, :-1]
        below = np.ones(count, dtype=np.int64)
        for i in range(1, k):
            below = below * a[:, k - i, k - i - 1] % p
            now -= (a[:, k - i - 1, k - 1] * below % p)[:, None] * polys[k - i - 1] % p1
        polys[k] = now % p1
    return polys[d, :, ::-1]


def combined(parts: list[tuple[int, Sequence[int]]]) -> list[int]:
    """The numbers of least size with the given residues: ``(prime, residues)`` by Chinese remaindering."""
    product = 1
    for prime, _ in parts:
        product *= prime
    weights = [(product // prime) * pow(product // prime, -1, prime) for prime, _ in parts]
    out = []
    for k in range(len(parts[0][1])):
        x = sum(w * int(r[k]) for w, (_, r) in zip(weights, parts)) % product
        out.append(x - product if 2 * x > product else x)
    return out


def _derivative(f: list[int]) -> list[int]:
    n = len(f) - 1
    return [c * (n - i) for i, c in enumerate(f[:-1])]


def _gcd_modulo(f: list[int], g: list[int], p: int) -> list[int]:
    """Monic greatest common divisor modulo a prime."""

    def trimmed(h: list[int]) -> list[int]:
        first = next((i for i, c in enumerate(h) if c), len(h))
        return h[first:]

    f, g = trimmed([c % p for c in f]), trimmed([c % p for c in g])
    while g:
        inverse = pow(g[0], -1, p)
        while len(f) >= len(g):
            q = f[0] * inverse % p
            f = trimmed([(c - q * g[i]) % p if i < len(g) else c for i, c in enumerate(f)])
        f, g = g, f
    inverse = pow(f[0], -1, p)
    return [c * inverse % p for c in f]


def _divided(f: list[int], g: list[int]) -> tuple[list[int], list[int]]:
    """Quotient and rest by a monic polynomial."""
    f, out = f.copy(), []
    for i in range(len(f) - len(g) + 1):
        q = f[i]
        out.append(q)
        if q:
            for j, c in enumerate(g):
                f[i + j] -= q * c
    return out, f[len(out) :]


def _common(f: list[int]) -> list[int]:
    """Monic greatest common divisor of a monic polynomial and its derivative.

    Images modulo primes are joined until the result divides both; those of too high a
    degree come from unlucky primes and go.
    """
    slope, parts, n = _derivative(f), [], PRIMES_BELOW - 1
    while True:
        if is_prime(n):
            image = _gcd_modulo(f, slope, n)
            if len(image) == 1:
                return [1]
            if not parts or len(image) <= len(parts[0][1]):
                parts = [(n, image)] if parts and len(image) < len(parts[0][1]) else [*parts, (n, image)]
                # Tries at growing numbers of primes, so that trials cost little beside the images.
                if (len(parts) & (len(parts) - 1)) == 0:
                    g = combined(parts)
                    if not any(_divided(f, g)[1]) and not any(_divided([x * 1 for x in slope], g)[1]):
                        return g
        n -= 2


def simple_factors(f: list[int]) -> list[tuple[int, list[int]]]:
    """``(m, polynomial)``: the roots of multiplicity m, each as a simple root. Roots 0 are left out."""
    while len(f) > 1 and f[-1] == 0:
        f = f[:-1]
    parts = []
    while len(f) > 1:
        common = _common(f)
        parts.append(_divided(f, common)[0])
        f = common
    parts.append([1])
    out = [(m, _divided(a, b)[0]) for m, (a, b) in enumerate(zip(parts, parts[1:]), start=1)]
    return [(m, g) for m, g in out if len(g) > 1]


def roots_above(f: list[int], c: int, k: int) -> int:
    """How many roots exceed c / 2**k, for a polynomial with real roots only.

    Moved there, such a polynomial has as many changes of sign as positive roots (Descartes; exact
    because all roots are real).
    """
    a = [x << (k * i) for i, x in enumerate(f)]
    for stop in range(len(a), 1, -1):
        for i in range(1, stop):
            a[i] += c * a[i - 1]
    signs = [x > 0 for x in a if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _value(f: list[int], c: int, k: int) -> int:
    """The polynomial at c / 2**k, times a power of two."""
    total, scale = 0, 0
    for x in f:
        total = total * c + (x << scale)
        scale += k
    return total


@dataclass
class Root:
    """The one root of ``poly`` in (low / 2**k, (low + 1) / 2**k], of so many eigenvalues."""

    poly: list[int]
    low: int
    k: int
    multiplicity: int

    def halve(self) -> None:
        middle = 2 * self.low + 1
        # The sign right of all roots is plus and changes at each root; one root lies inside.
        at_middle, at_end = _value(self.poly, middle, self.k + 1), _value(self.poly, 2 * self.low + 2, self.k + 1)
        above = at_middle != 0 and (at_end == 0 or (at_middle > 0) != (at_end > 0))
        self.low, self.k = (middle if above else 2 * self.low), self.k + 1

    def at(self, k: int) -> int:
        return self.low << (k - self.k)


def _isolated(f: list[int], multiplicity: int, top: int, k: int, most: int) -> list[Root]:
    """The largest ``most`` roots of a polynomial, apart, all of them in (0, 2**top]."""
    found: list[Root] = []
    # Intervals (low, low + 1] at scale 2**-k, with the roots above both ends; the rightmost first.
    waiting = [(0, -top, len(f) - 1, 0)]
    while waiting and len(found) < most:
        low, k, over_low, over_high = waiting.pop()
        if over_low == over_high:
            continue
        if over_low - over_high == 1:
            found.append(Root(f, low, k, multiplicity))
            continue
        middle = 2 * low + 1
        if k + 1 < 0:
            over = roots_above(f, middle << -(k + 1), 0)
        else:
            over = roots_above(f, middle, k + 1)
        waiting += [(2 * low, k + 1, over_low, over), (middle, k + 1, over, over_high)]
    for root in found:
        # Whole numbers first: what lies in (low, low + 1] times 2**-k, k negative, is halved down to k = 0.
        while root.k < 0:
            middle = 2 * root.low + 1
            over = roots_above(f, middle << -(root.k + 1), 0) - roots_above(f, (root.low + 1) << -root.k, 0)
            root.low, root.k = (middle if over else 2 * root.low), root.k + 1
    return found


def largest_roots(f: list[int], most: int, spare: int = 100) -> list[Root]:
    """Distinct positive roots from the largest down until they stand for ``most``, and one more if there is one.

    Each is known to 2**-spare of its distance to the next one, and of its size.
    """
    top = max(1, (abs(f[1]) if len(f) > 1 else 1).bit_length() + 1)
    roots = [r for m, g in simple_factors(f) for r in _isolated(g, m, top, 0, most + 1)]
    for root in roots:
        while root.low == 0:
            root.halve()
    while True:
        k = max((r.k for r in roots), default=0)
        roots.sort(key=lambda r: -r.at(k))
        # Neighbours whose intervals touch are halved until they lie apart.
        close = [
            r
            for a, b in zip(roots, roots[1:])
            if a.at(k) - b.at(k) <= 2 * ((1 << (k - a.k)) + (1 << (k - b.k)))
            for r in (a, b)
        ]
        if not close:
            break
        for root in {id(r): r for r in close}.values():
            root.halve()
    k = max((r.k for r in roots), default=0)
    gaps = [a.at(k) - b.at(k) for a, b in zip(roots, roots[1:])]
    kept, total = [], 0
    for i, root in enumerate(roots):
        near = min([root.at(k), *gaps[max(0, i - 1) : i + 1]])
        # near / 2**k is the distance; the last place of the root must lie spare bits below it.
        while root.k < spare + k - near.bit_length() + 1:
            root.halve()
        kept.append(root)
        total += root.multiplicity
        if total >= most:
            break
    return kept


def null_vectors(matrix: list[list[int]], low: int, k: int, count: int, spare: int = 100) -> list[list[float]]:
    """Unit vectors, at right angles, with ``matrix`` times v near to low / 2**k times v.

    Inverse iteration in fixed point. The root is known to 2**-k, so the first steps already take all
    other directions down by more than a double can tell. Of each vector the largest entry is positive.
    """
    d = len(matrix)
    top = max(1, sum(matrix[i][i] for i in range(d)).bit_length())
    bits = 2 * (top + k) + spare
    a = np.array([[x << (bits - top) for x in row] for row in matrix], dtype=object).reshape(d, d)
    a[np.diag_indices(d)] -= low << (bits - top - k)
    order = np.arange(d)
    for c in range(d):
        pivot = c + int(np.argmax(np.abs(a[c:, c])))
        if pivot != c:
            a[[c, pivot]], order[[c, pivot]] = a[[pivot, c]], order[[pivot, c]]
        if a[c, c] == 0:
            a[c, c] = 1
        if c + 1 < d:
            a[c + 1 :, c] = (a[c + 1 :, c] << bits) // a[c, c]
            a[c + 1 :, c + 1 :] -= (a[c + 1 :, c, None] * a[None, c, c + 1 :]) >> bits

    def solved(b: np.ndarray) -> np.ndarray:
        x = b[order].copy()
        for c in range(d):
            x[c + 1 :] -= (a[c + 1 :, c] * x[c]) >> bits
        for c in reversed(range(d)):
            x[c] = (x[c] << bits) // a[c, c]
            x[:c] -= (a[:c, c] * x[c]) >> bits
        return x

    def unit(x: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            x = (x << bits) // max(1, isqrt(int((x * x).sum())))
            for v in others:
                x = x - ((v * (int((v * x).sum()) >> bits)) >> bits)
        return (x << bits) // max(1, isqrt(int((x * x).sum())))

    draw, found = 88172645463325252, []
    for _ in range(count):
        start = []
        for _ in range(d):
            draw = (draw * 6364136223846793005 + 1442695040888963407) % (1 << 64)
            start.append((draw << bits >> 64) + 1)
        x = unit(np.array(start, dtype=object), found)
        for _ in range(3):
            x = unit(solved(x), found)
        if x[int(np.argmax(np.abs(x)))] < 0:
            x = -x
        found.append(x)
    return [[int(v) / (1 << bits) for v in x] for x in found]
