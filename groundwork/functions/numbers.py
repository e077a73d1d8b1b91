"""Rounding that two engines agree on, and text to number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def round_exact(value: Column, digits: int) -> Column:
    """Round half up on the decimal value, as a numeric type does, and return a double."""
    return F.round(value.cast("decimal(28,10)"), digits).cast("double")


def six_places(distance: Column) -> Column:
    """A distance to six places, never minus zero. Every ranking uses this value."""
    return F.when(F.abs(distance) < 5e-7, F.lit(0.0)).otherwise(F.round(distance, 6))


def six_place_steps(distances: np.ndarray) -> np.ndarray:
    """The same rounding, half up, in workers: distances as whole numbers of the sixth place."""
    return np.floor(distances * 1e6 + 0.5)


def average_hours(hours: Column) -> Column:
    """Mean of the known hours to one place; null when every ticket is open."""
    return round_exact(F.avg(hours), 1)


def parse_hours(text: Column) -> Column:
    """Blank, missing, unreadable and NaN hours become null."""
    return F.nanvl(text.try_cast("double"), F.lit(None).cast("double"))
