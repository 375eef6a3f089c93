"""Feature statistics, report histograms and stage counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Edges of the distance histogram and of the separation histogram.
CA_EDGES = [0.0, 0.5, 1.0, 2.0, 3.0, 4.0, 5.0]
SEPARATIONS = [("1", 1, 1), ("2-4", 2, 4), ("5-12", 5, 12), ("13-24", 13, 24), ("25-64", 25, 64), (">64", 65, None)]
QUANTILES = [("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95), ("p99", 0.99)]
STAGES = ["pairs", "after_valid", "after_distance", "after_cap"]


def standardizer(rows: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """feature, mean, std (population, floored): one pass for all columns."""
    one = rows.agg(*(F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.greatest(F.stddev_pop(c), F.lit(floor)).alias("std")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def standardize(rows: DataFrame, columns: list[str], floor: float = 1e-6) -> DataFrame:
    """rows with (x - mean) / std in place of each column; the fitted row is one small broadcast."""
    fit = rows.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.greatest(F.stddev_pop(c), F.lit(floor)).alias(f"_s_{c}") for c in columns))
    out = rows.crossJoin(F.broadcast(fit))
    return out.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).select(*rows.columns)


def feature_stats(rows: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean, std, min, max."""
    one = rows.agg(*(F.struct(F.lit(c).alias("feature"), F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max")).alias(c) for c in columns))
    return one.select(F.explode(F.array(*columns)).alias("s")).select("s.*")


def level_counts(rows: DataFrame, column: str) -> DataFrame:
    """Counts by level, UNKNOWN for null."""
    return rows.groupBy(F.coalesce(column, F.lit("UNKNOWN")).alias("level")).agg(F.count("*").alias("n"))


def group_size_quantiles(rows: DataFrame, *keys: str) -> DataFrame:
    """Exact, linearly interpolated quantiles of how many rows a group has."""
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    found = sizes.agg(F.count("*").alias("count"), F.min("n").alias("min"), F.max("n").alias("max"), F.avg("n").alias("mean"), F.stddev_pop("n").alias("std"), F.percentile("n", F.array(*(F.lit(q) for _, q in QUANTILES))).alias("q"))
    return found.select("count", "min", "max", "mean", "std", *(F.get("q", F.lit(k)).alias(name) for k, (name, _) in enumerate(QUANTILES)))


def _bins(rows: DataFrame, named: list[tuple[str, Column]]) -> DataFrame:
    one = rows.agg(*(F.count_if(c).alias(f"b{k}") for k, (_, c) in enumerate(named)))
    return one.select(F.explode(F.array(*(F.struct(F.lit(name).alias("bin"), F.col(f"b{k}").alias("n")) for k, (name, _) in enumerate(named)))).alias("s")).select("s.*")


def distance_histogram(rows: DataFrame, column: str, edges: list[float] = CA_EDGES, closed: bool = False) -> DataFrame:
    """bin, n for half-open bins and an overflow bin; closed=True counts the last edge in both last bins, as some histograms do."""
    x, named = F.col(column), []
    for k, (low, high) in enumerate(zip(edges, edges[1:])):
        upper = (x <= high) if closed and k == len(edges) - 2 else (x < high)
        named.append((f"[{low}, {high})", (x >= low) & upper))
    return _bins(rows, [*named, (f">={edges[-1]}", x >= edges[-1])])


def separation_histogram(rows: DataFrame, separation: Column) -> DataFrame:
    """bin, n of sequence separations; those under 1 count as 1."""
    s = F.greatest(F.lit(1), separation)
    return _bins(rows, [(name, s >= low if high is None else s.between(low, high)) for name, low, high in SEPARATIONS])


def stage_counts(alignments: DataFrame) -> DataFrame:
    """Sums over alignments of the pairs left after each stage, and counts of errors, empty and degenerate alignments."""
    ok = F.col("error_type").isNull()
    return alignments.agg(
        F.count("*").alias("alignments"), F.count_if(~ok).alias("errored"), *(F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in STAGES),
        (2 * F.coalesce(F.sum(F.when(ok, F.col("after_cap"))), F.lit(0))).alias("examples"),
        F.count_if(ok & (F.col("after_cap") == 0)).alias("empty"), F.count_if(ok & F.col("status").isNotNull()).alias("degenerate"),
        F.coalesce(F.sum(F.when(ok & F.col("status").isNotNull(), F.col("after_valid"))), F.lit(0)).alias("dropped_degenerate"),
    )


def reconciles(counts: DataFrame) -> DataFrame:
    """One row, ok: counts never grow from stage to stage, and each pair kept gives two examples."""
    falling = [F.col(a) >= F.col(b) for a, b in zip(STAGES, STAGES[1:])]
    return counts.select((falling[0] & falling[1] & falling[2] & (2 * F.col("after_cap") == F.col("examples"))).alias("ok"))


def nonfinite(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row: for each column, how many values are null, NaN or infinite."""
    bad = lambda c: F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf"))
    return rows.agg(*(F.count_if(bad(c)).alias(c) for c in columns))
