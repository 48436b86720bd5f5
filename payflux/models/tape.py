"""Reverse accumulation over matrices: values that know what they were made of.

The graph of values may branch and meet: gradients are added up at each value before they are handed on.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

EPSILON = 1e-5


class Value:
    """A matrix; parents with functions that turn its gradient into theirs."""

    __slots__ = ("data", "parents", "gradient")

    def __init__(self, data: np.ndarray, *parents: tuple[Value, Callable[[np.ndarray], np.ndarray]]):
        self.data, self.parents, self.gradient = data, parents, None


def accumulated(seeds: list[tuple[Value, np.ndarray]]) -> None:
    """Adds to all values behind the seeds the gradients that the seeds' gradients give them."""
    order, seen, stack = [], set(), [(v, False) for v, _ in seeds]
    while stack:
        v, done = stack.pop()
        if done:
            order.append(v)
        elif id(v) not in seen:
            seen.add(id(v))
            stack.append((v, True))
            stack.extend((p, False) for p, _ in v.parents)
    for v, g in seeds:
        v.gradient = g if v.gradient is None else v.gradient + g
    for v in reversed(order):
        if v.gradient is not None:
            for p, f in v.parents:
                g = f(v.gradient)
                p.gradient = g if p.gradient is None else p.gradient + g


def product(x: Value, w: Value) -> Value:
    return Value(x.data @ w.data, (x, lambda g: g @ w.data.T), (w, lambda g: x.data.T @ g))


def total(x: Value, y: Value) -> Value:
    return Value(x.data + y.data, (x, lambda g: g), (y, lambda g: g))


def shifted(x: Value, b: Value) -> Value:
    """x + a row."""
    return Value(x.data + b.data, (x, lambda g: g), (b, lambda g: g.sum(axis=0)))


def times(x: Value, factor: np.ndarray) -> Value:
    return Value(x.data * factor, (x, lambda g: g * factor))


def joined(parts: list[Value]) -> Value:
    ends = np.cumsum([0, *(p.data.shape[1] for p in parts)])
    return Value(np.concatenate([p.data for p in parts], axis=1), *((p, lambda g, a=a, b=b: g[:, a:b]) for p, a, b in zip(parts, ends[:-1], ends[1:], strict=True)))


def by_heads(z: Value, a: Value) -> Value:
    """Of each head of z (rows: the heads' vectors, one after the other) the product with the head's vector in a."""
    heads, width = a.data.shape
    cube = z.data.reshape(len(z.data), heads, width)
    return Value((cube * a.data).sum(-1), (z, lambda g: (g[..., None] * a.data).reshape(len(g), -1)), (a, lambda g: (g[..., None] * cube).sum(axis=0)))


def with_token(x: np.ndarray, is_token: np.ndarray, token: Value) -> Value:
    """x, with the token in the rows that are marked."""
    return Value(np.where(is_token[:, None], token.data, x), (token, lambda g: g[is_token].sum(axis=0, keepdims=True)))


def _normal(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distribution function and density of the normal distribution; the former by the series of Abramowitz and Stegun, 7.1.26."""
    z = np.abs(x) / np.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * np.exp(-z * z)
    return np.where(x >= 0, 0.5 * (1 + erf), 0.5 * (1 - erf)), np.exp(-x * x / 2) / np.sqrt(2 * np.pi)


def _bent(name: str, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An activation and its slope."""
    if name == "relu":
        return np.maximum(x, 0), (x > 0).astype(float)
    if name == "leaky_relu":
        return np.where(x >= 0, x, 0.2 * x), np.where(x >= 0, 1.0, 0.2)
    if name == "elu":
        y = np.where(x >= 0, x, np.expm1(np.minimum(x, 0)))
        return y, np.where(x >= 0, 1.0, y + 1)
    if name == "sigmoid":
        y = 1 / (1 + np.exp(-x))
        return y, y * (1 - y)
    if name == "tanh":
        y = np.tanh(x)
        return y, 1 - y * y
    if name == "gelu":
        cdf, density = _normal(x)
        return x * cdf, cdf + x * density
    raise ValueError(f"unknown activation: {name}")


def activated(name: str | None, x: Value, slope: Value | None = None) -> Value:
    if name in (None, "none"):
        return x
    if name == "prelu":
        low = np.minimum(x.data, 0)
        return Value(np.where(x.data >= 0, x.data, slope.data * x.data), (x, lambda g: np.where(x.data >= 0, g, slope.data * g)), (slope, lambda g: np.array([(g * low).sum()])))
    y, bend = _bent(name, x.data)
    return Value(y, (x, lambda g: g * bend))


def scaled(x: Value, gamma: Value, beta: Value) -> Value:
    return Value(x.data * gamma.data + beta.data, (x, lambda g: g * gamma.data), (gamma, lambda g: (g * x.data).sum(axis=0)), (beta, lambda g: g.sum(axis=0)))


def row_normed(x: Value) -> Value:
    """Each row with mean 0 and population variance 1."""
    centred = x.data - x.data.mean(axis=1, keepdims=True)
    root = np.sqrt((centred**2).mean(axis=1, keepdims=True) + EPSILON)
    y = centred / root
    return Value(y, (x, lambda g: (g - g.mean(axis=1, keepdims=True) - y * (g * y).mean(axis=1, keepdims=True)) / root))


def column_normed(x: Value, mean: Value, var: Value) -> Value:
    """Each column less a mean, over the root of a variance; both are values of their own."""
    root = np.sqrt(var.data + EPSILON)
    y = (x.data - mean.data) / root
    return Value(y, (x, lambda g: g / root), (mean, lambda g: (-g / root).sum(axis=0, keepdims=True)), (var, lambda g: (-g * y / (2 * root * root)).sum(axis=0, keepdims=True)))
