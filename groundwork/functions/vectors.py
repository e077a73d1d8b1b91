"""Column expressions over array<float> vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _as_double(vector: Column) -> Column:
    return vector.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(_as_double(a), _as_double(b), lambda x, y: x * y)
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(_as_double(vector), F.lit(0.0), lambda acc, x: acc + x * x))


def cosine_distance(a: Column, b: Column) -> Column:
    """One minus the cosine; null for a vector without direction."""
    return 1 - dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def shorten(vector: Column | str, dims: int) -> Column:
    """A shorter vector is a prefix of the longer one; cosine needs no new norm."""
    return F.slice(vector, 1, dims)


def preview(vector: Column | str, values: int = 12) -> Column:
    return F.transform(F.slice(vector, 1, values), lambda x: F.round(x.cast("double"), 6))


def to_text(vector: Column | str) -> Column:
    """`[v1,v2,...]` with seven decimals (half to even), the exchange form of a vector."""
    parts = F.transform(vector, lambda x: F.format_string("%.7f", F.bround(x.cast("double"), 7)))
    return F.concat(F.lit("["), F.array_join(parts, ","), F.lit("]"))


def from_text(text: Column | str) -> Column:
    return F.from_json(text, "array<float>")
