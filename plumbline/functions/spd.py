"""Symmetric positive definite matrices of any size, in numpy: the kernels of grouped Arrow functions."""

from __future__ import annotations

import numpy as np

FLOOR = 1e-12


def powered(a: np.ndarray, f) -> np.ndarray:
    w, v = np.linalg.eigh(a)
    return (v * f(np.maximum(w, FLOOR))[..., None, :]) @ np.swapaxes(v, -1, -2)


def log_spd(a: np.ndarray) -> np.ndarray:
    return powered(a, np.log)


def exp_sym(a: np.ndarray) -> np.ndarray:
    w, v = np.linalg.eigh(a)
    return (v * np.exp(w)[..., None, :]) @ np.swapaxes(v, -1, -2)


def shrink(a: np.ndarray, lam: float) -> np.ndarray:
    c = a.shape[-1]
    return (1 - lam) * a + lam * (np.trace(a, axis1=-2, axis2=-1) / c)[..., None, None] * np.eye(c)


def affine2(many: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Squared affine-invariant distances of stacked matrices from the stacked (or one) target, whitened once."""
    w = powered(target, lambda x: x**-0.5)
    return (np.log(np.maximum(np.linalg.eigvalsh(w @ many @ w), FLOOR)) ** 2).sum(-1)


def log_euclid2(many: np.ndarray, target: np.ndarray) -> np.ndarray:
    return ((log_spd(many) - log_spd(target)) ** 2).sum((-2, -1))


def flat2(many: np.ndarray, target: np.ndarray) -> np.ndarray:
    return ((many - target) ** 2).sum((-2, -1))


METRICS = {"airm": affine2, "logeuclid": log_euclid2, "euclid": flat2}


def frechet_mean(a: np.ndarray, rounds: int = 5) -> np.ndarray:
    """Riemannian mean by a fixed number of fixed-point rounds from the arithmetic mean."""
    m = a.mean(0)
    for _ in range(rounds):
        half, back = powered(m, np.sqrt), powered(m, lambda x: x**-0.5)
        m = half @ exp_sym(log_spd(back @ a @ back).mean(0)) @ half
    return m


def tangent(a: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Upper triangles of logs at `reference`, off the diagonal times the root of two."""
    back = powered(reference, lambda x: x**-0.5)
    s = log_spd(back @ a @ back)
    i, j = np.triu_indices(a.shape[-1])
    return s[..., i, j] * np.where(i == j, 1.0, np.sqrt(2.0))


def shrunk(s: np.ndarray, fourth: float, n: int) -> np.ndarray:
    """A covariance of n centred rows, shrunk to a multiple of the identity (Ledoit and Wolf 2004). fourth: the mean of their squared square norms."""
    p = len(s)
    mu = np.trace(s) / p
    d2 = ((s - mu * np.eye(p)) ** 2).sum()
    b2 = min(d2, (fourth - (s**2).sum()) / n)
    k = b2 / d2 if d2 else 0.0
    return (1 - k) * s + k * mu * np.eye(p)


def class_covariance(x: np.ndarray) -> np.ndarray:
    """Of one class: standardised by its own deviations, shrunk, and scaled back."""
    scale = x.std(0)
    scale[scale == 0] = 1
    z = (x - x.mean(0)) / scale
    return shrunk(z.T @ z / len(z), float(((z**2).sum(1) ** 2).mean()), len(z)) * np.outer(scale, scale)


def discriminants(cov: np.ndarray, means: np.ndarray, prior: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, intercepts) of linear discriminants, a row for each class."""
    coef = np.linalg.lstsq(cov, means.T, rcond=None)[0].T
    return coef, np.log(prior) - 0.5 * (means * coef).sum(1)


def lda(train: np.ndarray, labels: np.ndarray, test: np.ndarray) -> np.ndarray:
    """Labels of `test` by linear discriminants with the classes' shrunk covariances, weighed by their shares."""
    classes, at = np.unique(labels, return_inverse=True)
    means = np.stack([train[at == k].mean(0) for k in range(len(classes))])
    prior = np.bincount(at) / len(at)
    cov = sum(prior[k] * class_covariance(train[at == k]) for k in range(len(classes)))
    coef, intercept = discriminants(cov, means, prior)
    return classes[(test @ coef.T + intercept).argmax(1)]


def balanced_accuracy(truth: np.ndarray, said: np.ndarray) -> float:
    return float(np.mean([(said[truth == k] == k).mean() for k in np.unique(truth)]))
