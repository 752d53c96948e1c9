"""Trends over the rollups: day metrics, baselines, anomalies, digests.

All of it reads day or hour rows, which are few; only the caption operators
see event-sized input and are written for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from eventide.functions.text import tokens
from eventide.functions.times import iso_z, quarter_start
from eventide.operators import blocks
from eventide.params import TrendParams


def day_metrics(g: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Per day of the grain: events, motion and object share, up-time, duplicate rate.

    Up-time is the share of the day's 24 hours with events.  The duplicate rate
    is the share of ``duplicate`` among the day's frames in ``labels`` (ts,
    novelty: the ``frame_labels`` of the perception job); NULL without frames.
    """
    n = F.sum("events")
    share = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("events"))), F.lit(0)) / n
    kind = F.col("kind")
    per_day = g.groupBy(F.to_date("hour").alias("date")).agg(
        n.alias("total_events"),
        share(kind.startswith("motion")).alias("motion_share"),
        share(kind.startswith("track") | kind.startswith("object")).alias("object_share"),
        (F.count_distinct("hour") / F.lit(24.0)).alias("uptime"),
    )
    if labels is None:
        per_day = per_day.withColumn("duplicate_rate", F.lit(None).cast("double"))
    else:
        rates = labels.groupBy(F.to_date("ts").alias("date")).agg(
            (F.count_if(F.col("novelty") == "duplicate") / F.count("novelty")).alias("duplicate_rate"))
        per_day = per_day.join(rates, "date", "left")
    return per_day.withColumn("downtime", F.lit(1.0) - F.col("uptime"))


def fill_days(days: DataFrame) -> DataFrame:
    """Every date between the first and last day; missing ones have 0 events."""
    span = days.agg(F.min("date").alias("a"), F.max("date").alias("z")).where(F.col("a").isNotNull())
    spine = span.select(F.explode(F.sequence("a", "z")).alias("date"))
    return spine.join(days, "date", "left").fillna({"total_events": 0})


def baselines(days: DataFrame, p: TrendParams, metric: str = "total_events") -> DataFrame:
    """Mean and deviation of the days before each day, and whether they can be used.

    cold: fewer than ``min_days`` days with events in the window; stale: the
    newest of them is older than ``stale_after_days``; else ready.  One row per
    calendar day, so the window without a key is as long as the calendar.
    """
    # days in one partition by nature: 366 rows a year
    w = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(-p.baseline_days, -1)
    seen = F.col("total_events") > 0
    b = days.withColumns({
        "baseline_days": F.count(F.when(seen, 1)).over(w),
        "baseline_mean": F.avg(F.when(seen, F.col(metric))).over(w),
        "baseline_std": F.stddev_pop(F.when(seen, F.col(metric))).over(w),
        "_newest": F.max(F.when(seen, F.col("date"))).over(w),
    })
    age = F.date_diff("date", "_newest")
    state = (
        F.when(F.col("baseline_days") < p.min_days, "cold")
        .when(age > p.stale_after_days, "stale")
        .otherwise("ready")
    )
    return b.withColumn("baseline_state", state).drop("_newest")


def activity_flags(base: DataFrame, p: TrendParams, metric: str = "total_events") -> DataFrame:
    """Days with a ready baseline that lie off it: ``spike`` or ``drop``, with the z score."""
    spread = F.greatest(F.col("baseline_std"), F.lit(1e-9))
    z = (F.col(metric) - F.col("baseline_mean")) / spread
    flag = F.when(z >= p.z_threshold, "spike").when(z <= -p.z_threshold, "drop")
    return base.withColumn("z", z).withColumn(
        "flag", F.when(F.col("baseline_state") == "ready", flag)
    )


def missing_motion(days: DataFrame) -> DataFrame:
    """Days with events but no motion while the day before had some."""
    prev = F.lag("motion_share").over(Window.partitionBy(F.lit(0)).orderBy("date"))
    return days.withColumn(
        "missing_motion",
        (F.col("total_events") > 0) & (F.coalesce("motion_share", F.lit(0.0)) == 0) & (F.coalesce(prev, F.lit(0.0)) > 0),
    )


def mix_shift(kind_days: DataFrame, p: TrendParams) -> DataFrame:
    """Total-variation distance of a day's kind shares from the day before, and whether it is a shift.

    Input: flat counts ``date, kind, n``.
    """
    total = kind_days.groupBy("date").agg(F.sum("n").alias("_t"))
    share = kind_days.join(total, "date").select("date", "kind", (F.col("n") / F.col("_t")).alias("s"))
    # each share also counts, negated, for the next day
    nxt = share.select(F.date_add("date", 1).alias("date"), "kind", (-F.col("s")).alias("s"))
    both = share.join(nxt.select("date").distinct(), "date", "left_semi").unionByName(
        nxt.join(share.select("date").distinct(), "date", "left_semi"))
    diff = both.groupBy("date", "kind").agg(F.abs(F.sum("s")).alias("d")).groupBy("date").agg(
        (F.sum("d") / 2).alias("mix_distance"))
    return diff.withColumn("mix_shift", F.col("mix_distance") >= p.mix_threshold)


def week_over_week(days: DataFrame, metric: str = "total_events") -> DataFrame:
    """Each day against the same weekday one week earlier (by date, gaps allowed)."""
    before = days.select(F.date_add("date", 7).alias("date"), F.col(metric).alias("week_ago"))
    return days.select("date", metric).join(before, "date", "left").withColumn(
        "change", F.col(metric) - F.col("week_ago")
    ).withColumn("ratio", F.col(metric) / F.nullif(F.col("week_ago"), F.lit(0)))


def quarter_counts(journal: DataFrame) -> DataFrame:
    """Events per source and 15-minute segment."""
    return journal.groupBy("source", quarter_start(F.col("created_utc")).alias("quarter")).agg(
        F.count(F.lit(1)).alias("events"))


def still_bursts(stills: DataFrame, seconds: int = 1) -> DataFrame:
    """Stills (camera, ts, path) grouped in short windows, with their paths in time order.

    A window of one second holds what a camera takes in a second, so the list
    is short however long the history.
    """
    w = F.window("ts", f"{seconds} seconds")
    return (
        stills.groupBy("camera", w.alias("w"))
        .agg(F.array_sort(F.collect_list(F.struct("ts", "path"))).alias("_f"))
        .select("camera", F.col("w.start").alias("burst_start"), F.transform("_f", lambda f: f["path"]).alias("paths"))
    )


def jaccard(a: Column, b: Column) -> Column:
    """Overlap of two token sets; NULL if either is NULL, 1 for two empty ones."""
    union = F.size(F.array_union(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), F.when(union == 0, 1.0).otherwise(
        F.size(F.array_intersect(a, b)) / union))


def caption_repeats(captions: DataFrame, p: TrendParams, keys: list[str], order: list[str], block_s: float) -> DataFrame:
    """Adds ``similarity`` to the previous caption of the same source, and ``repeat``.

    ``order`` starts with a timestamp column; ``text`` holds the caption.
    """
    ts = order[0]
    words = F.array_distinct(tokens(F.lower("text")))
    df = blocks.previous(
        captions.withColumn("_words", words), keys, order, {"_prev": "_words"}, block_s, ts)
    return (
        df.withColumn("similarity", jaccard(F.col("_words"), F.col("_prev")))
        .withColumn("repeat", F.coalesce(F.col("similarity") >= p.caption_similarity, F.lit(False)))
        .drop("_words", "_prev")
    )


def audible(chunks: DataFrame, p: TrendParams, seconds: str = "speech_s", level: str | None = None) -> DataFrame:
    """Speech chunks that are neither too short nor too quiet."""
    keep = F.col(seconds) >= p.min_speech_s
    if level:
        keep &= F.col(level) >= p.min_level
    return chunks.where(keep)


def retained(journal: DataFrame, today: Column, p: TrendParams, date: str = "created_date") -> DataFrame:
    """Rows of the last ``retention_days`` days; prunes date partitions."""
    return journal.where(F.col(date) > F.date_sub(today, p.retention_days))


def digest(hours: DataFrame, words: DataFrame, n: int = 3) -> DataFrame:
    """One line of text about each of the newest ``n`` hours with events.

    ``words`` are ranked top words per hour.
    """
    top = words.groupBy("hour").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda w: w["word"]), ", ")
        .alias("_words"))
    newest = hours.where(F.col("total_events") > 0).orderBy(F.col("hour").desc()).limit(n)
    text = F.concat_ws(
        "; ",
        F.format_string("%s: %d events", iso_z(F.col("hour")), F.col("total_events")),
        F.format_string("%d motion, %d speech", F.col("motion_summary_events"), F.col("speech_events")),
        F.concat(F.lit("words "), F.col("_words")),
    )
    return newest.join(top, "hour", "left").select("hour", text.alias("line"))


def dwell(track_table: DataFrame) -> DataFrame:
    """Per camera, hour and class: tracks that entered and their dwell seconds."""
    t = track_table.where(F.col("enter_ts").isNotNull() & F.col("exit_ts").isNotNull())
    return t.groupBy("camera", F.date_trunc("hour", "enter_ts").alias("hour"), "cls").agg(
        F.count(F.lit(1)).alias("tracks"), F.sum("duration_s").alias("dwell_s"))
