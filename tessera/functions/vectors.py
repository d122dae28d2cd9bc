"""Vector arithmetic as Column expressions: higher-order functions, so rows stay in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "euclidean", "dot", "manhattan")


def literal(vector: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def _pairs(a: Column, b: Column, f) -> Column:
    """Sum of ``f`` over paired components; vectors of different lengths are an error, null ones give null."""
    same = F.when(F.size(a) == F.size(b), F.zip_with(a, b, lambda x, y: f(x.cast("double"), y.cast("double"))))
    checked = F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(same, F.raise_error(F.lit("vectors differ in dimension")).cast("array<double>")))
    return F.aggregate(checked, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: x * y)


def squared_euclidean(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: (x - y) * (x - y))


def euclidean(a: Column, b: Column) -> Column:
    return F.sqrt(squared_euclidean(a, b))


def manhattan(a: Column, b: Column) -> Column:
    return _pairs(a, b, lambda x, y: F.abs(x - y))


def hamming(a: Column, b: Column) -> Column:
    """Number of components that differ."""
    return _pairs(a, b, lambda x, y: (x != y).cast("double")).cast("int")


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column, norm_b: Column | None = None) -> Column:
    """Cosine similarity; 0 if either vector is zero. ``norm_b`` saves computing the norm of ``b`` where it is known."""
    return F.when(a.isNull() | b.isNull(), None).otherwise(F.coalesce(F.try_divide(dot(a, b), norm(a) * (norm(b) if norm_b is None else norm_b)), F.lit(0.0)))


def normalize(a: Column) -> Column:
    """Unit vector; a zero vector stays as it is."""
    return F.transform(a, lambda x: F.coalesce(F.try_divide(x.cast("double"), norm(a)), F.lit(0.0)))


def similarity(metric: str, a: Column, b: Column) -> Column:
    """Higher is nearer: the cosine, the dot product, or 1 / (1 + distance)."""
    if metric == "cosine":
        return cosine(a, b)
    if metric == "dot":
        return dot(a, b)
    if metric == "euclidean":
        return 1 / (1 + euclidean(a, b))
    if metric == "manhattan":
        return 1 / (1 + manhattan(a, b))
    raise ValueError(f"unknown metric {metric!r}; known: {', '.join(METRICS)}")


def distance(metric: str, a: Column, b: Column) -> Column:
    """Lower is nearer: 1 - cosine, the negated dot product, or the distance itself."""
    if metric == "cosine":
        return 1 - cosine(a, b)
    if metric == "dot":
        return -dot(a, b)
    if metric == "euclidean":
        return euclidean(a, b)
    if metric == "manhattan":
        return manhattan(a, b)
    if metric == "hamming":
        return hamming(a, b)
    raise ValueError(f"unknown metric {metric!r}")


def from_text(text: Column) -> Column:
    """``[1,2]`` as an array of floats; text that is none gives null."""
    return F.from_json(text, "array<float>")


def to_text(vector: Column) -> Column:
    return F.to_json(vector)


def metadata_filter(metadata: Column, wanted: dict) -> Column:
    """All of ``wanted`` hold in a JSON object: null means that the key is absent, numbers compare as numbers."""
    out = F.lit(True)
    for key, value in wanted.items():
        if not key.replace("_", "").replace("-", "").isalnum():
            raise ValueError(f"bad metadata key {key!r}")
        found = F.get_json_object(metadata, f"$['{key}']")
        if value is None:
            test = found.isNull()
        elif isinstance(value, bool):
            test = found == str(value).lower()
        elif isinstance(value, (int, float)):
            test = found.try_cast("double") == float(value)
        else:
            test = found == F.lit(value)
        out = out & F.coalesce(test, F.lit(False))
    return out
