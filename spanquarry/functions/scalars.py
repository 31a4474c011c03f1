"""Scalar and array expressions that scores are made of."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def logit(p: Column) -> Column:
    q = clamp(p, 1e-6, 1 - 1e-6)
    return F.ln(q / (1 - q))


def sixth(x: Column) -> Column:
    """Six decimals: results of different engines agree to that."""
    return F.round(x, 6)


def top_weighted(values: Column, weights: tuple[float, ...] = (0.5, 0.3, 0.2)) -> Column:
    """Weighted sum of the largest values."""
    top = F.slice(F.sort_array(values, asc=False), 1, len(weights))
    return F.aggregate(F.zip_with(top, F.array(*map(F.lit, weights)), lambda v, w: F.coalesce(v, F.lit(0.0)) * w), F.lit(0.0), lambda acc, x: acc + x)


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements; 1 for two empty sets."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 1.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 at least."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, F.greatest(dot(a, b) / norm, F.lit(0.0))).otherwise(0.0)


def nearest_rank(values: Column, q: float) -> Column:
    """Lower nearest-rank quantile of an array."""
    return F.get(F.sort_array(values), F.floor(q * (F.size(values) - 1)).cast("int"))


def upper_median(values: Column) -> Column:
    return F.get(F.sort_array(values), F.floor(F.size(values) / 2).cast("int"))


def hash_uniform(*parts: Column | str | int) -> Column:
    """A number in [0, 1) from a hash of the parts, the same in every run and engine."""
    text = F.concat_ws(":", *[p if isinstance(p, Column) else F.lit(str(p)) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("double") / 4294967296.0


def target_size(n: Column, share: float) -> Column:
    """Rows that a share of n rows allows: half to even, at least 1, at most n."""
    return F.greatest(F.lit(1), F.least(n, F.bround(n * share).cast("long")))


def slug(name: Column) -> Column:
    """A name for files: trimmed, in lower case, percent signs, dots and blanks written out."""
    return F.translate(F.replace(F.replace(F.lower(F.trim(name)), F.lit("%"), F.lit("pct")), F.lit("."), F.lit("p")), " ", "-")


# ---- service names from pod names ----


def drop_two_parts(pod: Column) -> Column:
    """Three or more parts: without the last two."""
    return F.regexp_replace(pod, "-[^-]*-[^-]*$", "")


def drop_two_hashes(pod: Column) -> Column:
    """Without the last two parts if both look generated (5 to 20 small letters or digits)."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(pod)), "_", "-"), "-[a-z0-9]{5,20}-[a-z0-9]{5,20}$", "")


def drop_replica(pod: Column) -> Column:
    """Without a replica-set hash and pod suffix, else without a suffix of five."""
    name = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(F.trim(pod)), "_", "-"), "[^a-z0-9-]", ""), "-+", "-")
    both = F.regexp_replace(name, "-[a-f0-9]{8,10}-[a-z0-9]{5}$", "")
    return F.when(both != name, both).otherwise(F.regexp_replace(name, "-[a-z0-9]{5}$", ""))


def first_part(pod: Column) -> Column:
    return F.substring_index(pod, "-", 1)
