"""Column functions on logarithms, soft votes, names and units."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def log_sum_exp(xs: Column) -> Column:
    """ln of the sum of exponentials of an array; null if it is empty."""
    top = F.array_max(xs)
    return top + F.log(F.aggregate(xs, F.lit(0.0), lambda s, x: s + F.exp(x - top)))


def log_add(a: Column, wa: Column, b: Column, wb: Column) -> Column:
    """ln(wa e**a + wb e**b)."""
    return log_sum_exp(F.array(a + F.log(wa), b + F.log(wb)))


def digamma(x: Column) -> Column:
    """Derivative of ln gamma: recurrence up to 12, then its asymptotic series; reflection below 0; -inf at its poles."""

    @F.pandas_udf("double")
    def run(values: pd.Series) -> pd.Series:
        v = values.to_numpy(float)
        z = np.where(v < 0, 1 - v, v)
        out, pole = np.zeros(len(z)), (v <= 0) & (np.floor(v) == v)
        z = np.where(pole, 1.0, z)
        for _ in range(12):
            low = z < 12
            out -= np.where(low, 1 / z, 0)
            z = np.where(low, z + 1, z)
        r = 1 / z**2
        # Bernoulli numbers over twice their index
        out += np.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
        with np.errstate(all="ignore"):
            out = np.where(v < 0, out - np.pi / np.tan(np.pi * v), out)
        return pd.Series(np.where(pole, -np.inf, out))

    return run(x)


def weights_of_two(a: Column, b: Column) -> tuple[Column, Column]:
    """Softmax of two logarithms."""
    total = log_sum_exp(F.array(a, b))
    return F.exp(a - total), F.exp(b - total)


def certainty(a: Column, b: Column) -> Column:
    """ln 2 less the entropy of the softmax of two."""
    part = lambda w: F.when(w < 2.220446049250313e-16, 0.0).otherwise(w * F.log(w))
    return F.lit(float(np.log(2.0))) + sum((part(w) for w in weights_of_two(a, b)), F.lit(0.0))


def _first(total: Column) -> Column:
    return F.when(F.round(total, 9) >= 0, 0).otherwise(1)


#: Votes for the first (0) or second (1) of two models from logarithms (a, b) of each piece, as aggregates; sums within
#: 1e-9 of 0 are ties, which go to the first.
VOTES: dict[str, Callable[[Column, Column], Column]] = {
    "naive": lambda a, b: _first(F.sum(a - b)),
    "independent": lambda a, b: F.when(2 * F.count_if(a > b) >= F.count(F.lit(1)), 0).otherwise(1),
    "sol": lambda a, b: _first(F.sum(certainty(a, b) * (a - b))),
    "sow": lambda a, b: _first(F.sum(certainty(a, b) * (weights_of_two(a, b)[0] - weights_of_two(a, b)[1]))),
}


def well_of(name: Column) -> Column:
    """A read's name up to its last slash."""
    return F.regexp_replace(name, "/[^/]*$", "")


def last_unit(length: Column, unit: int = 100) -> Column:
    """Index of the last whole unit of a sequence; -1 if there is none."""
    return F.call_function("div", length, F.lit(unit)) - 1


def short_count(n: Column) -> Column:
    """``1234567`` -> ``1234k``; below a thousand as it is."""
    return F.when(n >= 1000, F.concat(F.call_function("div", n, F.lit(1000)).cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def natural_parts(name: Column) -> Column:
    """``a_b`` of two whole numbers, to sort by them."""
    two = F.split(name, "_")
    return F.struct(F.get(two, F.lit(0)).try_cast("long").alias("a"), F.get(two, F.lit(1)).try_cast("long").alias("b"))
