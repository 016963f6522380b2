"""Exact spectra of symmetric integer matrices.

The characteristic polynomial is computed modulo many primes (reduction to Hessenberg form, then the recurrence over its leading
blocks) and put together by the Chinese remainder theorem. All its roots are real, so the sign changes of its coefficients,
shifted to a point, count the roots beyond that point exactly; bisection isolates the roots in fixed point. Eigenvectors come from inverse
iteration on the null space in the same fixed point. Nothing depends on how close the eigenvalues are.
"""

from __future__ import annotations

import random
from collections.abc import Iterable
from math import comb, isqrt

import numpy as np

#: fractional bits of roots, and of the elimination's multipliers and vectors
ROOT_BITS = 96
WORK_BITS = 192


def is_prime(n: int) -> bool:
    """Miller-Rabin with bases that decide every n below 2**32."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    d, r = n - 1, 0
    while d % 2 == 0:
        d, r = d // 2, r + 1
    for a in (2, 3, 5, 7):
        x = pow(a, d, n)
        if x in (1, n - 1):
            continue
        for _ in range(r - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_for(trace: int, d: int) -> list[int]:
    """Primes under 2**31 whose product exceeds every coefficient of a positive semidefinite matrix of this size and trace: the k-th
    is at most that of d equal roots."""
    bound = max(comb(d, k) * trace ** k // d ** k + 1 for k in range(d + 1)) if d else 1
    out, product, p = [], 1, (1 << 31) - 1
    while product <= 2 * bound:  # both signs
        if is_prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def charpoly_mod(rows: list[list[int]], p: int) -> list[int]:
    """Coefficients of det(x - A) modulo the prime p, highest power first."""
    h = np.array([[x % p for x in r] for r in rows], np.int64).reshape(len(rows), len(rows))
    d = len(h)
    for k in range(1, d - 1):  # column k - 1 to zero below row k, by similarity
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        i = k + int(below[0])
        if i != k:
            h[[k, i]] = h[[i, k]]
            h[:, [k, i]] = h[:, [i, k]]
        f = h[k + 1:, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1:] = (h[k + 1:] - f[:, None] * h[k] % p) % p
        h[:, k] = (h[:, k] + (h[:, k + 1:] * f % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)  # polys[k]: of the leading block of size k, lowest power first
    polys[0, 0] = 1
    for k in range(1, d + 1):
        now = np.roll(polys[k - 1], 1)  # times x: the top place is still free
        weight, t = np.zeros(k, np.int64), 1
        weight[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            t = t * int(h[i + 1, i]) % p
            weight[i] = int(h[i, k - 1]) * t % p
        polys[k] = (now - (weight[:, None] * polys[:k] % p).sum(axis=0)) % p
    return polys[d, ::-1].tolist()


def by_remainders(residues: Iterable[tuple[int, list[int]]]) -> list[int]:
    """The coefficients between -m/2 and m/2 (m: the product of the primes) with these remainders."""
    values, m = None, 1
    for p, r in residues:
        if values is None:
            values, m = list(r), p
            continue
        inverse = pow(m, -1, p)
        values = [v + m * ((x - v) * inverse % p) for v, x in zip(values, r)]
        m *= p
    return [v - m if 2 * v > m else v for v in values or [1]]


def roots_above(poly: list[int], a: int) -> int:
    """Roots greater than ``a`` of a polynomial (highest power first) whose roots are all real: Descartes' rule is exact there."""
    c, changes, last = list(poly), 0, 0
    for i in range(len(c) - 1):
        for j in range(1, len(c) - i):
            c[j] += a * c[j - 1]
    for x in c:
        if x:
            changes += bool(last) and (x > 0) != (last > 0)
            last = x
    return changes


def top_roots(poly: list[int], count: int, bits: int = ROOT_BITS) -> list[tuple[int, int]]:
    """(root * 2**bits rounded up, multiplicity) of the greatest positive roots, falling, until ``count`` are found (the
    last may bring more). All roots of ``poly`` are real and not negative. Roots less than 2**-bits apart count as one."""
    poly = list(poly)
    while len(poly) > 1 and not poly[-1]:  # roots that are exactly zero
        poly.pop()
    if len(poly) < 2:
        return []
    scaled = [c << bits * k for k, c in enumerate(poly)]
    high = 1 << (-scaled[1]).bit_length()  # over the sum of the roots
    out, found = [], 0
    todo = [(0, high, len(poly) - 1, 0)]  # roots in (low, high], roots beyond high
    while todo and found < count:
        low, high, here, beyond = todo.pop()
        if here == 1:
            out.append((_bisect(scaled, low, high, beyond), 1))
            found += 1
        elif high - low <= 1:
            out.append((high, here))
            found += here
        else:
            mid = (low + high) // 2
            upper = roots_above(scaled, mid) - beyond
            if here > upper:
                todo.append((low, mid, here - upper, beyond + upper))
            if upper:
                todo.append((mid, high, upper, beyond))
    return out


def _bisect(poly: list[int], low: int, high: int, beyond: int) -> int:
    """The one root in (low, high], rounded up; the sign right of it follows from the number of roots beyond."""
    while high - low > 1:
        mid, value = (low + high) // 2, 0
        for c in poly:
            value = value * mid + c
        if value == 0:
            return mid
        if (value > 0) == (beyond % 2 == 0):
            high = mid
        else:
            low = mid
    return high


def null_vectors(rows: list[list[int]], root: int, count: int, bits: int = ROOT_BITS) -> list[list[float]]:
    """``count`` orthogonal unit eigenvectors of the symmetric integer matrix for the eigenvalue ``root`` / 2**bits, to double
    precision; the largest entry of each is positive."""
    d, w = len(rows), WORK_BITS
    a = [[(x << bits) - (root if i == j else 0) for j, x in enumerate(r)] for i, r in enumerate(rows)]
    perm, factors = list(range(d)), [[0] * d for _ in range(d)]
    for k in range(d):
        i = max(range(k, d), key=lambda r: abs(a[r][k]))
        a[k], a[i] = a[i], a[k]
        perm[k], perm[i] = perm[i], perm[k]
        factors[k], factors[i] = factors[i], factors[k]
        a[k][k] = a[k][k] or 1  # exactly singular: the smallest step away
        top, pivot = a[k], a[k][k]
        for r in range(k + 1, d):
            row = a[r]
            if row[k]:
                f = factors[r][k] = (row[k] << w) // pivot
                for j in range(k + 1, d):
                    row[j] -= f * top[j] >> w

    def solve(b):
        z = [b[i] for i in perm]
        for i in range(d):
            z[i] -= sum(f * y for f, y in zip(factors[i][:i], z)) >> w
        for i in range(d - 1, -1, -1):
            z[i] = ((z[i] << bits) - sum(x * y for x, y in zip(a[i][i + 1:], z[i + 1:]))) // a[i][i]
        return z

    rnd, out = random.Random(d), []
    for _ in range(count):
        z = [rnd.randrange(1, 1 << 32) << w for _ in range(d)]
        for _ in range(3):
            z = solve(z)
            for q in out:
                part, whole = sum(x * y for x, y in zip(z, q)), sum(x * x for x in q)
                z = [x - part * y // whole for x, y in zip(z, q)]
            size = max(abs(x) for x in z).bit_length() - w
            z = [x >> size for x in z] if size > 0 else [x << -size for x in z]
        out.append(z)
    units = []
    for z in out:
        norm = isqrt(sum(x * x for x in z)) or 1
        v = [float((x << 96) // norm) / 2.0 ** 96 for x in z]
        units.append([-x for x in v] if max(v, key=abs) < 0 else v)
    return units
