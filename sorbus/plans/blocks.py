"""Effects that share a key: per level a small weighted least squares problem, of its Gram matrix and right-hand sides.

Columns are scaled to length 1 first, so what counts as dependent doesn't change with the units. The rank rule: a direction
whose eigenvalue is at most CUTOFF times the largest is left out, and of the solutions that are left the shortest one, in
scaled columns, is taken. This is where an iteration that starts at 0 ends, too.
"""

from __future__ import annotations

import numpy as np

CUTOFF = 1e-11


def scaled(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scales, correlations) of Gram matrices (levels, p, p); the scale of a column of zeros is 0."""
    square = np.einsum("lpp->lp", gram)
    s = np.divide(1, np.sqrt(square, where=square > 0, out=np.ones_like(square)), out=np.zeros_like(square), where=square > 0)
    return s, gram * s[:, :, None] * s[:, None, :]


def directions(corr: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors, which of them count)."""
    value, vector = np.linalg.eigh(corr)
    return value, vector, (value > np.maximum(value[:, -1:], 0) * CUTOFF) & (value > 0)


def roots(gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(S, its pseudo-inverse) per level: columns times S have length 1 and are at right angles; a column of S that has no
    direction left is 0. One column: 1 over the root of its sum of squares."""
    if gram.shape[1] == 1:
        s, length = scaled(gram)[0][:, :, None], np.sqrt(gram)
        return s, np.where(s > 0, length, 0)
    s, corr = scaled(gram)
    value, vector, kept = directions(corr)
    root = np.sqrt(np.where(kept, value, 1))
    length = np.divide(1, s, out=np.zeros_like(s), where=s > 0)
    return s[:, :, None] * vector * np.where(kept, 1 / root, 0)[:, None, :], np.where(kept, root, 0)[:, :, None] * vector.transpose(0, 2, 1) * length[:, None, :]


def solved(gram: np.ndarray, right: np.ndarray, unit: int | None = None, shift: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (levels, p, m) of gram times coefficients = right (levels, p, m).

    With `shift`, the columns are given less these numbers (0 for `unit`, the column of ones), so that slopes that lie far
    from 0 cost no digits; the coefficients, and which solution is the shortest, are those of the columns as they were.
    """
    s, corr = scaled(gram)
    value, vector, kept = directions(corr)
    z = np.einsum("lpq,lpm->lqm", vector, right * s[:, :, None])
    z *= np.where(kept, 1 / np.where(kept, value, 1), 0)[:, :, None]
    out = np.einsum("lpq,lqm->lpm", vector, z) * s[:, :, None]
    if shift is None:
        return out
    out[:, unit] -= np.einsum("p,lpm->lm", shift, out)
    short = ~kept.all(1)
    if short.any():
        free = np.where(s > 0, s, 1)[short][:, :, None] * vector[short] * ~kept[short][:, None, :]
        free[:, unit] -= np.einsum("p,lpq->lq", shift, free)
        out[short] = shortest(out[short], free, *lengths(gram[short], unit, shift))
    return out


def lengths(gram: np.ndarray, unit: int, shift: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the columns with `shift` added back (levels, p), and what they could be; what is rounding only is 0."""
    terms = np.stack([np.einsum("lpp->lp", gram), 2 * gram[:, :, unit] * shift, shift**2 * gram[:, unit, unit][:, None]])
    square, most = terms.sum(0), np.abs(terms).sum(0)
    return np.sqrt(np.where(square > 1e-13 * most, square, 0)), np.sqrt(most)


def shortest(some: np.ndarray, free: np.ndarray, length: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of the solutions `some` (levels, p, m) plus any combination of `free` (levels, p, q), the shortest in columns scaled
    by `length`; a column of length 0 has coefficient 0, and a direction that has only such columns is none."""
    z, n = some * length[:, :, None], free * length[:, :, None]
    size, could = np.linalg.norm(n, axis=1, keepdims=True), np.linalg.norm(free * most[:, :, None], axis=1, keepdims=True)
    n = np.divide(n, size, out=np.zeros_like(n), where=size > 1e-6 * could)
    z -= n @ (np.linalg.pinv(n, rcond=1e-9) @ z)
    return np.divide(z, length[:, :, None], out=np.zeros_like(z), where=length[:, :, None] > 0)
