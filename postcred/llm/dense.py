"""Small dense algebra for the driver, on matrices of a bounded size.

No call goes to a threaded library: one that has started its threads may wait for them forever in a process
that has since forked (as a session's start does).
"""

from __future__ import annotations

import numpy as np


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,jk->ik", a, b)


def orthonormal(a: np.ndarray) -> np.ndarray:
    """Q of the thin QR factorisation (Gram-Schmidt, each column twice); a dependent column is replaced by a new direction."""
    q = np.zeros_like(a, dtype=float)
    spare = np.random.default_rng(a.shape[0])
    for j in range(a.shape[1]):
        v, done = a[:, j].astype(float), q[:, :j]
        size = np.sqrt((v * v).sum())
        while True:
            for _ in range(2):
                v = v - (done * (done * v[:, None]).sum(axis=0)).sum(axis=1)
            left = np.sqrt((v * v).sum())
            if left > 1e-10 * size and left > 0:
                break
            v = spare.standard_normal(len(v))
            size = np.sqrt((v * v).sum())
        v = v / left
        v = v - (done * (done * v[:, None]).sum(axis=0)).sum(axis=1)
        q[:, j] = v / np.sqrt((v * v).sum())
    return q


def symmetric_eigen(a: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (falling) and eigenvectors (columns) by cyclic Jacobi rotations."""
    a = (a + a.T) / 2
    n = len(a)
    vectors = np.eye(n)
    for _ in range(sweeps):
        off = a - np.diag(np.diag(a))
        if not n or (off * off).sum() <= 1e-34 * (a * a).sum():
            break
        for p in range(n - 1):
            for q in range(p + 1, n):
                if abs(a[p, q]) <= 1e-18 * np.sqrt(abs(a[p, p] * a[q, q])) or a[p, q] == 0:
                    continue
                ratio = (a[q, q] - a[p, p]) / (2 * a[p, q])
                t = (1.0 if ratio >= 0 else -1.0) / (abs(ratio) + np.sqrt(ratio * ratio + 1))
                c = 1 / np.sqrt(t * t + 1)
                s = t * c
                for m in (a, vectors):
                    m[:, [p, q]] = np.stack([c * m[:, p] - s * m[:, q], s * m[:, p] + c * m[:, q]], axis=1)
                a[[p, q], :] = np.stack([c * a[p] - s * a[q], s * a[p] + c * a[q]])
    order = np.argsort(-np.diag(a), kind="stable")
    return np.diag(a)[order], vectors[:, order]
