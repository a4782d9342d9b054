"""Losses with their gradients and hessians in the prediction, as column expressions.

p is a probability for the cross-entropy family and a plain prediction for the regression family.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Loss = tuple[Column, Column, Column]


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def cross_entropy(y: Column, p: Column) -> Loss:
    """Gradient and hessian in the raw score behind p."""
    return -(y * F.log(p) + (1 - y) * F.log(1 - p)), p - y, p * (1 - p)


def balanced_cross_entropy(y: Column, p: Column, alpha: float = 0.5) -> Loss:
    loss = -(alpha * y * F.log(p) + (1 - alpha) * (1 - y) * F.log(1 - p))
    grad = (1 - alpha) * (1 - y) * p - alpha * y * (1 - p)
    return loss, grad, ((1 - alpha) * (1 - y) + alpha * y) * p * (1 - p)


def focal(y: Column, p: Column, alpha: float = 0.5, gamma: float = 2.0) -> Loss:
    """Derivatives by the chain rule through p = sigmoid(score), for the probability of the true class."""
    t = F.when(y == 1, p).otherwise(1 - p)
    a = F.when(y == 1, alpha).otherwise(1 - alpha)
    sign = F.when(y == 1, 1.0).otherwise(-1.0)
    u = F.pow(1 - t, F.lit(gamma))
    loss = -a * u * F.log(t)
    inner = gamma * t * F.log(t) - (1 - t)
    grad = sign * a * u * inner
    slope = u * (gamma * (F.log(t) + 1) + 1) - gamma * F.pow(1 - t, F.lit(gamma - 1)) * inner
    return loss, grad, a * t * (1 - t) * slope


def squared(y: Column, p: Column) -> Loss:
    return (y - p) * (y - p), 2 * (p - y), F.lit(2.0)


def absolute(y: Column, p: Column) -> Loss:
    return F.abs(y - p), F.signum(p - y), F.lit(1.0)


def huber(y: Column, p: Column, delta: float = 1.0) -> Loss:
    d = p - y
    near = F.abs(d) <= delta
    return F.when(near, d * d / 2).otherwise(delta * (F.abs(d) - delta / 2)), F.when(near, d).otherwise(delta * F.signum(d)), F.when(near, 1.0).otherwise(0.0)


def fair(y: Column, p: Column, c: float = 1.0) -> Loss:
    d = p - y
    a = F.abs(d)
    return c * c * (a / c - F.log(a / c + 1)), c * d / (a + c), c * c / ((a + c) * (a + c))


def log_cosh(y: Column, p: Column) -> Loss:
    d = p - y
    return F.log(F.cosh(d)), F.tanh(d), 1 - F.tanh(d) * F.tanh(d)


def tweedie(y: Column, p: Column, rho: float = 1.5) -> Loss:
    """p is the logarithm of the mean."""
    a, b = F.exp((1 - rho) * p), F.exp((2 - rho) * p)
    return -y * a / (1 - rho) + b / (2 - rho), -y * a + b, -(1 - rho) * y * a + (2 - rho) * b


LOSSES: dict[str, Callable[..., Loss]] = {f.__name__: f for f in (cross_entropy, balanced_cross_entropy, focal, squared, absolute, huber, fair, log_cosh, tweedie)}


def softmax(scores: list[Column]) -> list[Column]:
    top = F.greatest(*scores)
    e = [F.exp(s - top) for s in scores]
    total = sum(e[1:], e[0])
    return [x / total for x in e]


def multi_cross_entropy(y: Column, scores: list[Column]) -> tuple[Column, list[Column], list[Column]]:
    """Loss, and gradient and hessian for each class, in the raw scores; y counts classes from 0."""
    p = softmax(scores)
    hit = [(y == k).cast("double") for k in range(len(scores))]
    loss = -F.log(sum((h * x for h, x in zip(hit[1:], p[1:], strict=True)), hit[0] * p[0]))
    return loss, [x - h for x, h in zip(p, hit, strict=True)], [x * (1 - x) for x in p]
