"""Arithmetic on array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Shorter vectors count as so long, as zero vectors have no direction.
LEAST_NORM = 1e-12


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """0 if either vector is zero."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(LEAST_NORM)) * F.greatest(norm(b), F.lit(LEAST_NORM)))


def mean_of(a: Column, of=lambda x: x, then=lambda mean: mean) -> Column:
    """The mean of `of` of each element, or what `then` makes of it. However often then has the mean, elements are summed once a vector."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + of(x.cast("double")), lambda total: then(total / F.size(a)))


def layer_norm(a: Column, eps: float = 1e-5) -> Column:
    """Each vector with mean 0 and population variance 1."""
    scaled = lambda mean, var: F.transform(a, lambda x: (x.cast("double") - mean) / F.sqrt(var + eps))
    return mean_of(a, then=lambda mean: mean_of(a, lambda x: (x - mean) * (x - mean), lambda var: scaled(mean, var)))


ACTIVATIONS = {
    "relu": lambda x: F.greatest(x, F.lit(0.0)),
    "leaky_relu": lambda x, slope=0.2: F.when(x >= 0, x).otherwise(x * slope),
    "prelu": lambda x, slope=0.25: F.when(x >= 0, x).otherwise(x * slope),
    "elu": lambda x: F.when(x >= 0, x).otherwise(F.exp(x) - 1),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "tanh": F.tanh,
    "none": lambda x: x,
    # the normal distribution function by the series of Abramowitz and Stegun, 7.1.26 (error under 1.5e-7)
    "gelu": lambda x: x * _normal_cdf(x),
}


def _normal_cdf(x: Column) -> Column:
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + z * 0.3275911)
    erf = 1 - t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429)))) * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


def activation(name: str | None):
    key = name or "none"
    if key not in ACTIVATIONS:
        raise ValueError(f"unknown activation: {name}")
    return ACTIVATIONS[key]
