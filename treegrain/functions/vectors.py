"""Vector functions over ARRAY<FLOAT> as Catalyst expressions; operators.dense has the fast path for many queries."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LETTERS = "abcdefgh"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = F.greatest(norm(v), F.lit(1e-12))
    return F.transform(v, lambda x: (x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 with a zero vector."""
    return dot(a, b) / (F.greatest(norm(a), F.lit(1e-12)) * F.greatest(norm(b), F.lit(1e-12)))


def checked(v: Column, dim: int) -> Column:
    """v, or an error where its length isn't dim."""
    if dim <= 0:
        raise ValueError("dim must be positive")
    return F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"expected {dim} dimensions, got "), F.size(v).cast("string"))))


def letter_counts(text: Column) -> Column:
    """An encoder without weights: how often each of a..h occurs, ignoring case."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.array(*[(F.length(t) - F.length(F.replace(t, F.lit(c), F.lit("")))).cast("double") for c in LETTERS])
