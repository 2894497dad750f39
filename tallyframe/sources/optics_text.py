"""Text exports of optical design programs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def _rows(text: Column, least: int) -> Column:
    """Lines that begin with that many numbers, as arrays of doubles."""
    parts = F.transform(F.split(text, "\n"), lambda line: F.filter(F.split(F.trim(line), r"\s+"), lambda w: w != ""))
    numbers = F.transform(F.filter(parts, lambda p: F.size(p) >= least), lambda p: F.transform(F.slice(p, 1, least), lambda w: w.try_cast("double")))
    return F.filter(numbers, lambda p: ~F.exists(p, lambda x: x.isNull()))


def _bound(rows: Column, made: Callable[[Column], Column]) -> Column:
    """``made`` of the rows, which are parsed once: transform over one element binds them."""
    return F.element_at(F.transform(F.array(rows), made), 1)


def parse_mtf(text: Column) -> Column:
    """Three parallel arrays: frequency, tangential and sagittal contrast; other lines are left out."""
    names = ("spatial_frequency", "mtf_tangential", "mtf_sagittal")
    return _bound(_rows(text, 3), lambda rows: F.struct(*[F.transform(rows, (lambda k: lambda r: r[k])(k)).alias(name) for k, name in enumerate(names)]))


def parse_spot(text: Column) -> Column:
    """Rays as x and y; radius and diffraction limit stay 0 as no line gives them."""
    rays = F.transform(_rows(text, 2), lambda r: F.struct(r[0].alias("x"), r[1].alias("y")))
    return _bound(rays, lambda r: F.struct(r.alias("rays"), F.lit(0.0).alias("rms_radius"), F.lit(0.0).alias("diffraction_limit")))
