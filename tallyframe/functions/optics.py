"""Formulas of elementary optics as column expressions."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Refractive index nd, Abbe number and density in g/cm3 of four glasses.
GLASSES = (("N-BK7", 1.5168, 64.1, 2.51), ("N-SF11", 1.7847, 25.8, 3.78), ("F2", 1.6200, 36.4, 3.61), ("N-SSK8", 1.6880, 53.2, 3.31))


def propagated(angle: Column, distance: Column) -> Column:
    """Height that a ray gains over a distance of free space."""
    return angle * distance


def through_thin_lens(angle: Column, height: Column, focal: Column) -> Column:
    return angle - height / focal


def wavefront(coefficients: Column, rho: Column, theta: Column) -> Column:
    """Sum of c_i * rho^i * cos(i * theta) over an array of coefficients."""
    terms = F.transform(coefficients, lambda c, i: c * F.pow(rho, i) * F.cos(i * theta))
    return F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)


def achromat_powers(focal: Column) -> Column:
    """Powers of the two elements of a doublet."""
    return F.struct((2.0 / focal).alias("first"), (-1.0 / focal).alias("second"))


def mtf(frequency: Column, wavelength: Column, fnumber: Column) -> Column:
    """|sinc| of the frequency over the cutoff 1 / (1.22 * wavelength * fnumber), 0 beyond it."""
    x = frequency * (1.22 * wavelength * fnumber) * math.pi
    return F.when(frequency > 1 / (1.22 * wavelength * fnumber), F.lit(0.0)).when(x == 0, F.lit(1.0)).otherwise(F.abs(F.sin(x) / x))


def distortion(actual: Column, ideal: Column) -> Column:
    """Deviation of a height in per cent, 0 where the ideal height is 0."""
    return F.when(ideal == 0, F.lit(0.0)).otherwise((actual - ideal) / ideal * 100)


def transmission(reflections: Column, thicknesses: Column, absorption: float = 0.01) -> Column:
    """Product of (1 - R) over surfaces and exp(-absorption * t) over thicknesses, both arrays."""
    passed = F.aggregate(reflections, F.lit(1.0), lambda p, r: p * (1 - r))
    return F.aggregate(thicknesses, passed, lambda p, t: p * F.exp(-absorption * t))


def attainment(achieved: Column, target: Column) -> Column:
    """Share of a target that is reached, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), achieved / target))


def cost_efficiency(success_rate: Column, cost: Column, baseline: float = 1.0) -> Column:
    return F.when(cost == 0, F.lit(0.0)).otherwise(success_rate / (cost / baseline))


def glasses(spark: SparkSession) -> DataFrame:
    """The glasses as a dimension of four rows."""
    return spark.createDataFrame(GLASSES, "glass string, nd double, abbe double, density double")


#: Share of an interval that golden sections keep.
GOLDEN = (math.sqrt(5) - 1) / 2


def minimized(objective: Callable[[Column], Column], start: Column, low: Column, high: Column, rounds: int = 3, sections: int = 48) -> Column:
    """Values within bounds that make an objective of an array of doubles least, and the least value: a struct of ``x`` and ``value``.

    One coordinate after another is searched by golden sections over its whole interval, ``rounds`` times over all of them; an interval shrinks by 0.618 with each of ``sections`` steps. It finds the minimum of
    objectives with one valley along each coordinate that further rounds do not lower; others end in a point that no single coordinate improves. All rows are searched at once, without Python. A start outside of the bounds is moved
    to them; a row whose objective is null keeps its start and a null value; no coordinates leave nothing to search.
    """
    number = lambda c: c.cast("array<double>")
    start = F.zip_with(F.zip_with(number(start), number(low), lambda a, b: F.greatest(a, b)), number(high), lambda a, b: F.least(a, b))
    put = lambda x, k, v: F.transform(x, lambda old, i: F.when(i == k, v).otherwise(old))

    def along(x: Column, k: Column) -> Column:
        """``x`` with coordinate k at the least value found."""
        at = lambda v: objective(put(x, k, v))

        def step(s: Column, _: Column) -> Column:
            width = (s["b"] - s["a"]) * GOLDEN
            # the lower inner point wins ties, so a flat stretch is left at its lower end
            return F.when(at(s["b"] - width) <= at(s["a"] + width), F.struct(s["a"].alias("a"), (s["a"] + width).alias("b"))).otherwise(F.struct((s["b"] - width).alias("a"), s["b"].alias("b")))

        interval = F.struct(F.get(number(low), k).alias("a"), F.get(number(high), k).alias("b"))
        found = F.aggregate(F.sequence(F.lit(1), F.lit(sections)), interval, step, lambda s: (s["a"] + s["b"]) / 2)
        # ends of the interval are never inner points
        options = F.transform(F.array(found, F.get(number(low), k), F.get(number(high), k), F.get(x, k)), lambda v: F.struct(at(v).alias("value"), v.alias("v")))
        return put(x, k, F.coalesce(F.array_min(F.filter(options, lambda o: o["value"].isNotNull()))["v"], F.get(x, k)))

    n = F.size(start)
    turns = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.lit(rounds) * F.greatest(n, F.lit(1)) - 1), lambda t: t % n)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(turns, start, along, lambda x: F.struct(x.alias("x"), objective(x).alias("value")))


def minimized_batches(objective: Callable[..., np.ndarray], start: list[Column], low: list[Column], high: list[Column], given: list[Column], rounds: int = 3, sections: int = 48) -> Column:
    """The same search as ``minimized`` for objectives over numpy arrays: ``objective(x, *given)`` gets an array for each coordinate and for each given column, and gives the values of all rows of a batch.

    Each step takes one evaluation for a whole batch, as the inner point that stays is known: some hundred times less work a row than higher-order functions take. NaN stands for null in what an objective gets and gives;
    a row whose value is NaN keeps its start and a null value.
    """
    n = len(start)

    def search(*columns: pd.Series) -> pd.DataFrame:
        begin, least, most, own = ([c.to_numpy(dtype=float, na_value=np.nan) for c in columns[a:b]] for a, b in ((0, n), (n, 2 * n), (2 * n, 3 * n), (3 * n, None)))
        x = [np.minimum(np.maximum(s, a), b) for s, a, b in zip(begin, least, most, strict=True)]
        with np.errstate(all="ignore"):
            for k in [*range(n)] * rounds:
                at = lambda v, k=k: objective([*x[:k], v, *x[k + 1 :]], *own)
                a, b = least[k], most[k]
                width = (b - a) * GOLDEN
                low_in, high_in = b - width, a + width
                low_value, high_value = at(low_in), at(high_in)
                for _ in range(sections):
                    down = low_value <= high_value  # the lower inner point wins ties
                    a, b = np.where(down, a, low_in), np.where(down, high_in, b)
                    width = (b - a) * GOLDEN
                    fresh = np.where(down, b - width, a + width)
                    value = at(fresh)
                    low_in, high_in = np.where(down, fresh, high_in), np.where(down, low_in, fresh)
                    low_value, high_value = np.where(down, value, high_value), np.where(down, low_value, value)
                # ends of the interval are never inner points
                options = np.stack([(a + b) / 2, least[k], most[k], x[k]])
                values = np.stack([np.broadcast_to(at(v), v.shape) for v in options])
                # the least point of those with the least value
                best = np.where(values == np.fmin.reduce(values), options, np.nan)
                x[k] = np.where(np.isnan(values).all(axis=0), x[k], np.fmin.reduce(best))
            value = np.broadcast_to(np.asarray(objective(x, *own), dtype=float), x[0].shape)
        return pd.DataFrame({"x": list(np.stack(x, axis=1)), "value": pd.Series(value).astype("Float64").mask(np.isnan(value))})

    return F.pandas_udf(search, "x array<double>, value double")(*[c.cast("double") for c in (*start, *low, *high, *given)])


#: Rows for which a task is worth its start where each row takes long.
ROWS_EACH = 50_000


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly over tasks, one for each ROWS_EACH: a small table that takes long a row may be a single split."""
    return rows.repartition(max(1, -(-rows.count() // ROWS_EACH)))


def merit(weights: Column, achieved: Column, targets: Column) -> Column:
    """Sum over three arrays of weight times what is missing to the target; nothing for a target that is reached."""
    missing = F.zip_with(achieved, targets, lambda a, t: F.greatest(F.lit(0.0), t - a))
    return F.aggregate(F.zip_with(weights, missing, lambda w, m: w * m), F.lit(0.0), lambda s, x: s + x)
