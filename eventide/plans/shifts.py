"""Shifts of distributions between periods, on mergeable sketches; silent sources (L1, L3).

Values of a period are kept as a KLL quantile sketch, aggregated map-side.  A baseline is the union of earlier periods' sketches:
events are read once, whatever windows are looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from eventide.params import TrendParams

SKETCH_K = 4096  # exact up to about so many values; rank error below 0.1 % beyond
GRID = 256  # quantiles compared: adds at most 1/256 to the error of a distance


def sketches(values: DataFrame, keys: list[str], value: str = "value", k: int = SKETCH_K) -> DataFrame:
    """Per key: ``n`` values and their ``sketch``; null values don't count."""
    known = values.where(F.col(value).isNotNull())
    return known.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k)).alias("sketch"))


def trailing_union(sk: DataFrame, keys: list[str], period: str, back: int) -> DataFrame:
    """Per key and period: sketch of the ``back`` periods before it, how many of these had values, and how many values."""
    later = sk.select(*keys, F.explode(F.sequence(F.col(period) + 1, F.col(period) + back)).alias(period), "n", "sketch")
    return later.groupBy(*keys, period).agg(
        F.count(F.lit(1)).alias("base_periods"), F.sum("n").alias("base_n"), F.kll_merge_agg_double("sketch").alias("base"))


def ks_distance(pairs: DataFrame, keys: list[str], a: str, b: str, out: str = "distance", grid: int = GRID) -> DataFrame:
    """(keys, ``out``): Kolmogorov-Smirnov distance of two sketches a row: the greatest gap between their distributions.

    Both are laid out as ``grid`` quantiles; the distance is that of the two step functions, so it is off by at most two rank errors of
    the sketches and 1/``grid``.
    """
    ranks = F.array(*[F.lit(i / grid) for i in range(1, grid + 1)])
    steps = lambda s, sign: pairs.select(*keys, F.explode(F.kll_sketch_get_quantile_double(s, ranks)).alias("_x"), F.lit(sign).alias("_s"))
    level = steps(a, 1).unionByName(steps(b, -1)).groupBy(*keys, "_x").agg(F.sum("_s").alias("_s"))
    so_far = Window.partitionBy(*keys).orderBy("_x").rowsBetween(Window.unboundedPreceding, 0)
    level = level.withColumn("_d", F.abs(F.sum("_s").over(so_far)))
    return level.groupBy(*keys).agg((F.max("_d") / grid).alias(out))


def value_shift(
    values: DataFrame, period: str, p: TrendParams, keys: list[str] | None = None, value: str = "value", k: int = SKETCH_K
) -> DataFrame:
    """Per key and period with values: n, base_periods, base_n, distance to the ``baseline_days`` periods before, shift.

    ``period`` is a whole number (a day).  ``shift`` says that the distance reaches ``shift_threshold``; it is null, as the
    distance is, with fewer than ``min_days`` periods to compare with.  For confidence or novelty (hash distance) of frames and events.
    """
    keys = keys or []
    sk = sketches(values, [*keys, period], value, k)
    base = trailing_union(sk, keys, period, p.baseline_days)
    both = sk.join(base, [*keys, period], "left").withColumn("base_periods", F.coalesce("base_periods", F.lit(0)))
    ready = both.where(F.col("base_periods") >= p.min_days)
    far = ks_distance(ready, [*keys, period], "sketch", "base")
    return both.join(far, [*keys, period], "left").select(
        *keys, period, "n", "base_periods", F.coalesce("base_n", F.lit(0)).alias("base_n"), "distance",
        (F.col("distance") >= p.shift_threshold).alias("shift"))


def stale_sources(g: DataFrame, p: TrendParams) -> DataFrame:
    """Per day with events: sources known from it or the ``baseline_days`` before, how many of them were silent, and their share.

    Reads the rollup grain (hour, source); one row per source and day is all that is exploded.
    """
    seen = g.where(F.col("source").isNotNull()).select("source", F.to_date("hour").alias("day")).distinct()
    known = seen.select("source", F.explode(F.sequence(F.lit(0), F.lit(p.baseline_days))).alias("age"), "day")
    per = known.groupBy(F.date_add("day", F.col("age")).alias("date"), "source").agg(F.min("age").alias("age"))
    return per.groupBy("date").agg(
        F.count(F.lit(1)).alias("known_sources"), F.count_if(F.col("age") > 0).alias("stale_sources")
    ).where("stale_sources < known_sources").withColumn("stale_rate", F.col("stale_sources") / F.col("known_sources"))
