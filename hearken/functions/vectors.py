"""Arithmetic on array columns; floats are widened to double first."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def _doubles(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("array<double>")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body names it.

    Catalyst does not share subexpressions across a lambda, so a value named inside
    one would be computed again for every element.
    """
    return F.transform(F.array(value), body)[0]


def dot(a: Column | str, b: Column | str) -> Column:
    products = F.zip_with(_doubles(a), _doubles(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(v: Column | str) -> Column:
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda acc, x: acc + x * x))


def l2_normalize(v: Column | str) -> Column:
    """Unit length; a zero vector stays zero."""
    values = _doubles(v)
    return let(
        norm(values),
        lambda length: F.when(length == 0, values).otherwise(
            F.transform(values, lambda x: x / length)
        ),
    )


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays, 0 where either is the zero vector."""
    return let(
        norm(a) * norm(b),
        lambda length: F.when(length == 0, F.lit(0.0)).otherwise(dot(a, b) / length),
    )


def softmax(scores: Column | str) -> Column:
    """Softmax shifted by the largest score, so big scores do not overflow."""

    def shares(exps: Column) -> Column:
        total = F.aggregate(exps, F.lit(0.0), lambda acc, x: acc + x)
        return let(total, lambda z: F.transform(exps, lambda x: x / z))

    def shifted(values: Column) -> Column:
        return let(
            F.array_max(values), lambda top: F.transform(values, lambda x: F.exp(x - top))
        )

    return let(let(_doubles(scores), shifted), shares)


def prediction(probabilities: Column | str, names: list[str]) -> Column:
    """Label, confidence and all class probabilities; the first index wins ties."""
    labels = F.array(*[F.lit(n) for n in names])

    def described(probs: Column) -> Column:
        best = F.array_max(probs)
        return F.struct(
            F.element_at(labels, F.array_position(probs, best).cast("int")).alias("label"),
            best.alias("confidence"),
            F.map_from_arrays(labels, probs).alias("probs"),
        )

    return let(_doubles(probabilities), described)
