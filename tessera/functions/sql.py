"""Vector functions by name for SQL: temporary SQL functions, which Catalyst inlines, so nothing leaves the JVM."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Components are floats, as in the collections; the arithmetic is in doubles.
_A, _B = (f"transform(from_json({p}, 'array<float>'), z -> CAST(z AS DOUBLE))" for p in "ab")


def _sum(of: str) -> str:
    """Sum of ``of`` over pairs x, y of components; null for a null, an error for different dimensions."""
    checked = f"if(size({_A}) <> size({_B}), CAST(raise_error('vectors differ in dimension') AS array<double>), zip_with({_A}, {_B}, (x, y) -> {of}))"
    return f"aggregate({checked}, 0D, (s, v) -> s + v)"


def _norm(of: str) -> str:
    return f"sqrt(aggregate({of}, 0D, (s, v) -> s + v * v))"


#: Bodies over vectors a and b as text (``[1,2]``). All are distances: lower is nearer, the dot product negated.
FUNCTIONS = {
    "l2_distance": f"sqrt({_sum('(x - y) * (x - y)')})",
    "manhattan_distance": _sum("abs(x - y)"),
    "hamming_distance": _sum("CAST(x <> y AS DOUBLE)"),
    "dot_product": f"-{_sum('x * y')}",
    "cosine_distance": f"if(a IS NULL OR b IS NULL, NULL, 1 - coalesce(try_divide({_sum('x * y')}, {_norm(_A)} * {_norm(_B)}), 0D))",
}


def register(spark: SparkSession) -> None:
    """Make ``FUNCTIONS`` known to the session's SQL, in place of functions of the same names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a STRING, b STRING) RETURNS DOUBLE RETURN {body}")
