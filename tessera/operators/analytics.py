"""Analytics templates: profile, time series, correlation, anomalies, histograms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.times import time_bucket

AGGREGATES = ("sum", "avg", "min", "max", "count", "stddev", "variance", "median")


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = False, digits: int | None = None, quartiles: bool = True) -> DataFrame:
    """A row per column: name, type, min, max, distinct, avg, std, quartiles, count of values, share of nulls.

    All figures come from one aggregation over the table. ``exact`` replaces the sketches (distinct values,
    quartiles) by exact figures from each column's value counts: every column is then read once more, by itself,
    and only its distinct values are shuffled. ``digits`` rounds avg and std; without ``quartiles`` there are none.
    """
    columns = columns or df.columns
    aggregates, rows, counted = [F.count(F.lit(1)).alias("__rows")], [], []
    rounded = (lambda c: c) if digits is None else (lambda c: F.round(c, digits))
    quarters, none = ((25, 50, 75) if quartiles else ()), F.lit(None).cast("double")
    for i, name in enumerate(columns):
        kind, c = df.schema[name].dataType, F.col(f"`{name}`")
        number = isinstance(kind, T.NumericType)
        ordered = not isinstance(kind, (T.MapType, T.ArrayType, T.StructType, T.BinaryType, T.VariantType))
        plain = c if ordered else F.to_json(F.struct(c))
        parts = {
            "min": F.min(plain).cast("string"),
            "max": F.max(plain).cast("string"),
            "avg": rounded(F.avg(c)) if number else none,
            "std": rounded(F.stddev(c)) if number else none,
            "count": F.count(c),
        }
        if exact:
            values = df.filter(c.isNotNull()).groupBy(plain.alias("v")).agg(F.count(F.lit(1)).alias("n"))
            counted.append(values.agg(F.count("v").alias("n_distinct")).withColumn("column_name", F.lit(name)))
        else:
            parts |= {"n_distinct": F.approx_count_distinct(plain)} | {f"q{q}": (F.percentile_approx(c, F.lit(q / 100)).cast("double") if number else none) for q in quarters}
        aggregates += [v.alias(f"__{i}_{k}") for k, v in parts.items()]
        nulls = F.lit(100.0) * (F.col("__rows") - F.col(f"__{i}_count")) / F.greatest(F.col("__rows"), F.lit(1))
        rows.append(F.struct(F.lit(name).alias("column_name"), F.lit(kind.simpleString()).alias("column_type"), *[F.col(f"__{i}_{k}").alias(k) for k in parts], nulls.alias("null_percentage")))
    out = df.agg(*aggregates).select(F.explode(F.array(*rows)).alias("r")).select("r.*")
    if exact:  # a row per column
        out = out.join(F.broadcast(reduce(DataFrame.unionAll, counted)), "column_name")
        if quarters:
            numbers = [c for c in columns if isinstance(df.schema[c].dataType, T.NumericType)]
            found = exact_quantiles(df, numbers, [q / 100 for q in quarters]) if numbers else []
            marks = [(c, *values) for c, values in zip(numbers, found, strict=True)]
            kinds = ", ".join(["column_name string", *[f"q{q} double" for q in quarters]])
            out = out.join(F.broadcast(df.sparkSession.createDataFrame(marks, kinds)), "column_name", "left")
    return out.select("column_name", "column_type", "min", "max", "n_distinct", "avg", "std", *[f"q{q}" for q in quarters], "count", "null_percentage")


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float], error: float = 1e-4) -> list[list[float | None]]:
    """Exact quantiles, interpolated between neighbours, of each of ``columns`` (null values left out; none: None).

    A sketch brackets each of them; then what lies below the brackets is counted, and only values inside, a share of
    about four times ``error``, are put in order. No task gets all values of a column.
    """
    wide = [min(1.0, max(0.0, p + d)) for p in probabilities for d in (-2 * error, 2 * error)]
    brackets = df.select([F.col(f"`{c}`").cast("double").alias(c) for c in columns]).approxQuantile(columns, wide, error)
    asked = [(i, k, F.col(f"`{c}`").cast("double"), F.lit(marks[2 * k]), F.lit(marks[2 * k + 1]), p) for i, (c, marks) in enumerate(zip(columns, brackets, strict=True)) if marks for k, p in enumerate(probabilities)]
    out: list[list[float | None]] = [[None] * len(probabilities) for _ in columns]
    if not asked:
        return out
    counted = df.agg(*[c for n, (_, _, v, lo, _, _) in enumerate(asked) for c in (F.count(v).alias(f"t{n}"), F.count_if(v < lo).alias(f"b{n}"))])
    ranks = counted.select(F.inline(F.array(*[F.struct(F.lit(n).alias("of"), F.col(f"b{n}").alias("below"), (F.lit(x[5]) * (F.col(f"t{n}") - 1)).alias("position")) for n, x in enumerate(asked)])))
    inside = F.array(*[F.when((v >= lo) & (v <= hi), F.struct(F.lit(n).alias("asked"), v.alias("v"))) for n, (_, _, v, lo, hi, _) in enumerate(asked)])
    values = df.select(F.inline(F.array_compact(inside))).groupBy("asked", "v").agg(F.count(F.lit(1)).alias("n"))
    up_to = F.col("below") + F.sum("n").over(Window.partitionBy("asked").orderBy("v"))
    ranked = values.join(F.broadcast(ranks), F.col("asked") == F.col("of")).withColumn("up_to", up_to)
    at = lambda rank: F.min(F.when(F.col("up_to") > rank, F.col("v")))
    found = ranked.groupBy("asked").agg(at(F.floor("position")).alias("a"), at(F.ceil("position")).alias("b"), F.max(F.col("position") - F.floor("position")).alias("share"))
    for r in found.select("asked", (F.col("a") + (F.col("b") - F.col("a")) * F.col("share")).alias("q")).collect():  # a row per column and probability
        out[asked[r["asked"]][0]][asked[r["asked"]][1]] = r["q"]
    return out


def time_series(df: DataFrame, ts: str, value: str, width: str, aggregate: str = "sum", digits: int | None = None) -> DataFrame:
    """time_bucket and ``<AGGREGATE>_value``, in time order."""
    if aggregate.lower() not in AGGREGATES:
        raise ValueError(f"unknown aggregate {aggregate!r}")
    found = getattr(F, aggregate.lower())(F.col(value))
    name = f"{aggregate.upper()}_value"
    out = df.filter(F.col(ts).isNotNull()).groupBy(time_bucket(F.col(ts), width).alias("time_bucket")).agg((found if digits is None else F.round(found, digits)).alias(name))
    return out.orderBy("time_bucket")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """Pearson's coefficient over rows with both values; 0 where it is not defined (no rows, a constant)."""
    both = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
    r = F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))
    return both.agg(F.coalesce(r, F.lit(0.0)).alias("correlation"))


def anomalies(df: DataFrame, ts: str, value: str, threshold: float = 3.0) -> DataFrame:
    """Rows whose value is more than ``threshold`` standard deviations from the mean: timestamp, value, z_score, status.

    Mean and deviation are one row, so the join with them is a broadcast of a proven size.
    """
    stats = df.agg(F.avg(value).alias("__mean"), F.stddev_pop(value).alias("__sd"))
    z = F.try_divide(F.col(value) - F.col("__mean"), F.col("__sd"))
    out = df.select(ts, value).crossJoin(F.broadcast(stats)).select(F.col(ts).alias("timestamp"), F.col(value).alias("value"), z.alias("z_score"))
    return out.filter(F.abs("z_score") > threshold).withColumn("status", F.lit("Anomaly")).orderBy("timestamp")


#: Rows of a range of :func:`rolling`; a table of fewer rows is one range.
RANGE_ROWS = 2_000_000


def rolling(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 30, ranges: int | None = None) -> DataFrame:
    """``df`` with rolling_avg and rolling_std over the current and the ``rows`` preceding rows of the same ``keys``.

    A key may have very many rows: these are dealt to ``ranges`` (default: by their number) of the first ``order``
    column, of about equal size. Each range is sorted by itself, after the last ``rows`` rows of those before it.
    """
    if not keys:
        raise ValueError("a rolling window needs keys: without them one task would sort the whole table")
    ranges = -(-df.count() // RANGE_ROWS) if ranges is None else ranges
    found = lambda frame: {"rolling_avg": F.avg(value).over(frame), "rolling_std": F.stddev(value).over(frame)}
    if ranges <= 1:
        return df.withColumns(found(Window.partitionBy(*keys).orderBy(*order).rowsBetween(-rows, 0)))
    number = F.unix_micros(F.col(order[0]).cast("timestamp")).cast("double") if isinstance(df.schema[order[0]].dataType, (T.TimestampType, T.TimestampNTZType, T.DateType)) else F.col(order[0]).cast("double")
    marks = sorted(set(df.select(number.alias("n")).approxQuantile("n", [i / ranges for i in range(1, ranges)], 1 / (4 * ranges))))
    at = F.coalesce(F.size(F.filter(F.array(*[F.lit(m) for m in marks]), lambda m: m <= number)), F.lit(0)) if marks else F.lit(0)
    dealt = df.withColumn("__range", at)
    # The last rows of each range, and of these, for each range, the last of all before it.
    backwards = Window.partitionBy(*keys, "__range").orderBy(*[F.col(c).desc_nulls_last() for c in order])
    tails = dealt.withColumn("__nth", F.row_number().over(backwards)).filter(F.col("__nth") <= rows)
    along = Window.partitionBy(*keys).orderBy("__range", *order)
    held = tails.withColumn("__held", F.collect_list(F.struct(*[f"`{c}`" for c in df.columns])).over(along.rowsBetween(-rows + 1, 0)))
    halo = held.withColumn("__next", F.lead("__range").over(along)).filter("__next > __range")
    halo = halo.select(F.explode("__held").alias("__row"), F.col("__next").alias("__range")).select("__row.*", "__range", F.lit(True).alias("__halo"))
    both = dealt.withColumn("__halo", F.lit(False)).unionByName(halo)
    frame = Window.partitionBy(*keys, "__range").orderBy(*order).rowsBetween(-rows, 0)
    return both.withColumns(found(frame)).filter("NOT __halo").drop("__range", "__halo")


def rolling_anomalies(df: DataFrame, keys: list[str], order: list[str], value: str, rows: int = 30, threshold: float = 3.0) -> DataFrame:
    out = rolling(df, keys, order, value, rows)
    return out.filter(F.abs(F.col(value) - F.col("rolling_avg")) > threshold * F.col("rolling_std"))


def histogram(df: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """bin (0 to bins - 1, nearest of equally spaced marks between least and greatest value) and its count."""
    ends = df.agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
    share = F.coalesce(F.try_divide(F.col(value) - F.col("__lo"), F.col("__hi") - F.col("__lo")), F.lit(0.0))
    placed = df.filter(F.col(value).isNotNull()).select(value).crossJoin(F.broadcast(ends))
    return placed.groupBy(F.round(share * (bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def shape_stats(log: DataFrame, shape: str | Column, millis: str, rows: str, slow_ms: float = 100.0) -> DataFrame:
    """Running statistics per query shape of a query log: count, total, least, greatest and mean time, mean rows, slow."""
    out = log.groupBy((F.col(shape) if isinstance(shape, str) else shape).alias("shape")).agg(
        F.count("*").alias("executions"), F.sum(millis).alias("total_ms"), F.min(millis).alias("min_ms"), F.max(millis).alias("max_ms"), F.avg(millis).alias("avg_ms"), F.avg(rows).alias("avg_rows")
    )
    return out.withColumn("slow", F.col("avg_ms") > slow_ms)


def query_shape(sql: Column) -> Column:
    """Fingerprint of a statement: literals and digits become ``?``, white space single."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(sql, r"'[^']*'|\"[^\"]*\"", "?"), r"\d", "?"), r"\s+", " ")


def compare_runs(a: DataFrame, b: DataFrame, stage: str, millis: str) -> DataFrame:
    """Mean time per stage of two runs and their difference in per cent."""
    left = a.groupBy(stage).agg(F.avg(millis).alias("avg_a"))
    right = b.groupBy(stage).agg(F.avg(millis).alias("avg_b"))
    return left.join(right, stage, "full").withColumn("difference_percent", F.try_divide(100 * (F.col("avg_b") - F.col("avg_a")), F.col("avg_a")))
