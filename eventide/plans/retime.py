"""Shift whole shards in time.

Lines stay text: only the values of known top-level time fields are replaced,
so key order and free text are those of the input.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.times import iso_local, iso_utc_micros, local_hour_start, parse_ts
from eventide.sources.jsonl import parse_lines

SHARD_FIELDS = ("ts", "start_ts", "end_ts")
TRANSCRIPT_FIELDS = ("ts", "start_ts", "end_ts", "start_utc", "end_utc")
# order in which a line's own clock is looked for, and in which loc_ts is chosen
CLOCK_FIELDS = ("start_utc", "start_ts", "ts", "end_ts", "end_utc")
LOCAL_FIELDS = ("start_ts", "ts", "start_utc", "end_ts", "end_utc")


def _field_ts(name: str) -> Column:
    return parse_ts(F.col("obj")[name])


def _set(line: Column, name: str, text: Column) -> Column:
    """Replace the string value of a field; unchanged where ``text`` is NULL."""
    new = F.regexp_replace(line, F.lit(rf'("{name}"\s*:\s*)"[^"]*"'), F.concat(F.lit('$1"'), text, F.lit('"')))
    return F.coalesce(new, line)


_PART = re.compile(r'"(?:[^"\\]|\\.)*"|[{}\[\]]')
_COLON = re.compile(r"\s*:")


def set_top_level(line: str, new: dict[str, str | None]) -> str:
    """A JSON object's text with the string values of some of its own fields replaced; inner objects stay as they are."""
    out, at, depth, key = [], 0, 0, None
    for m in _PART.finditer(line):
        part = m[0]
        if part in "{[":
            depth, key = depth + 1, None
        elif part in "}]":
            depth, key = depth - 1, None
        elif depth == 1:
            if _COLON.match(line, m.end()):
                key = part[1:-1]
            else:
                if new.get(key) is not None:
                    out += [line[at : m.start()], '"', new[key], '"']
                    at = m.end()
                key = None
    return "".join(out) + line[at:]


def _set_plain(line: Column, texts: dict[str, Column]) -> Column:
    """Replace string values of fields of a line without inner objects, where their text is not NULL."""
    for name, text in texts.items():
        line = _set(line, name, text)
    return line


def _set_nested(line: Column, texts: dict[str, Column]) -> Column:
    """The same for the top-level fields of any line, by a text scanner."""
    names = list(texts)

    @F.pandas_udf("string")
    def nested(lines: pd.Series, *new: pd.Series) -> pd.Series:
        rows = zip(lines, *new, strict=True)
        return pd.Series([None if x is None else set_top_level(x, dict(zip(names, v, strict=True))) for x, *v in rows], dtype=object)

    return nested(line, *texts.values())


def _by_shape(parsed: DataFrame, moved: Callable[[DataFrame, Callable], DataFrame]) -> DataFrame:
    """``moved(lines, setter)`` of the lines without and of those with inner objects (a second brace), each with its setter.

    The lines are told apart by their text before they are parsed, so each is parsed once and only the latter meet Python.
    """
    flat = F.coalesce(F.regexp_count("line", F.lit(r"\{")) <= 1, F.lit(True))
    return moved(parsed.where(flat), _set_plain).unionByName(moved(parsed.where(~flat), _set_nested))


def _shifted(ts: Column, delta_us: Column) -> Column:
    return F.timestamp_micros(F.unix_micros(ts) + delta_us)


def file_clocks(parsed: DataFrame, order: list[str], fields: tuple[str, ...] = ("ts",)) -> DataFrame:
    """Per file: time of its first timed line, and whether every line is JSON."""
    ts = F.coalesce(*(_field_ts(f) for f in fields))
    return parsed.withColumn("_t", ts).groupBy("file").agg(
        F.min_by("_t", F.when(F.col("_t").isNotNull(), F.struct(*order))).alias("first_ts"),
        F.bool_and(F.col("obj").isNotNull()).alias("all_json"),
    )


def retime(
    parsed: DataFrame, targets: DataFrame, order: list[str], tz: str = "UTC", per_line: bool = False
) -> DataFrame:
    """Move every file so that its first event falls in its target hour.

    ``parsed`` has file, line, obj and the ``order`` columns; ``targets`` has
    file and target (any instant of the hour).  A file with a line that is not
    JSON, or without a usable time, passes through; with ``per_line`` only the
    bad lines do.
    """
    clocks = file_clocks(parsed, order).join(targets, "file")
    delta = F.unix_micros(local_hour_start(F.col("target"), tz)) - F.unix_micros(
        local_hour_start(F.col("first_ts"), tz)
    )
    usable = F.col("first_ts").isNotNull() & (F.lit(True) if per_line else F.col("all_json"))
    clocks = clocks.select("file", F.when(usable, delta).alias("delta_us"))
    texts = {f: iso_local(_shifted(_field_ts(f), F.col("delta_us")), tz) for f in SHARD_FIELDS}

    def moved(lines: DataFrame, put: Callable) -> DataFrame:
        return lines.join(clocks, "file", "left").withColumn("line", put(F.col("line"), texts))

    return _by_shape(parsed, moved).withColumn("retimed", F.col("delta_us").isNotNull()).drop("obj")


def align_transcript(
    parsed: DataFrame, anchor: DataFrame, order: list[str], tz: str = "UTC", fields: tuple[str, ...] = TRANSCRIPT_FIELDS
) -> DataFrame:
    """Move transcripts so that each file's first utterance falls on the anchor.

    ``anchor`` is a one-row table with ``anchor``.  Adds ``loc_ts`` to every
    timed line; ``created_utc`` is left alone.
    """
    clocks = file_clocks(parsed, order, CLOCK_FIELDS)
    usable = F.col("first_ts").isNotNull() & F.col("all_json")
    delta = F.unix_micros(anchor.select("anchor").scalar()) - F.unix_micros("first_ts")
    clocks = clocks.select("file", F.when(usable, delta).alias("delta_us"))
    moved = {f: _shifted(_field_ts(f), F.col("delta_us")) for f in fields}
    local = iso_local(F.coalesce(*(moved[f] for f in LOCAL_FIELDS)), tz)
    texts = {f: iso_utc_micros(ts, "Z") if f.endswith("_utc") else iso_local(ts, tz) for f, ts in moved.items()}

    def aligned(lines: DataFrame, put: Callable) -> DataFrame:
        line = put(F.col("line"), texts | {"loc_ts": local})
        appended = F.regexp_replace(line, F.lit(r"\s*\}\s*$"), F.concat(F.lit(', "loc_ts": "'), local, F.lit('"}')))
        line = F.when(local.isNull() | F.col("obj.loc_ts").isNotNull(), line).otherwise(appended)
        return lines.join(clocks, "file", "left").withColumn("line", line)

    return _by_shape(parsed, aligned).withColumn("retimed", F.col("delta_us").isNotNull()).drop("obj")


def first_event_time(parsed: DataFrame, order: list[str]) -> DataFrame:
    """One row ``anchor``: time of the first timed line; NULL when there is none."""
    ts = _field_ts("ts")
    return parsed.agg(F.min_by(ts, F.when(ts.isNotNull(), F.struct(*order))).alias("anchor"))


def anchor_or_previous_hour(anchor: DataFrame, run_start: Column) -> DataFrame:
    """The anchor, or the full hour before ``run_start`` when there is none."""
    before = F.date_trunc("hour", run_start) - F.expr("INTERVAL '1' HOUR")
    return anchor.select(F.coalesce("anchor", before).alias("anchor"))


def companion_targets(spark, files: dict[str, int], run_start: Column) -> DataFrame:
    """Target hours of companion shards: run hour plus an offset in hours per file."""
    base = spark.createDataFrame(list(files.items()), "file string, _h int")
    return base.select("file", (F.date_trunc("hour", run_start) + F.make_dt_interval(hours=F.col("_h"))).alias("target"))


def companions(
    before: DataFrame, after: DataFrame, transcript: DataFrame | None, order: list[str], run_start: Column, tz: str = "UTC"
) -> DataFrame:
    """Shards placed around a run: before and after in the hours next to it, a transcript at the first event.

    Inputs are parsed lines.  Returns ``file, ts, line, retimed``, ready for
    ``jsonl.write_shards``; a line without a time goes to the hour of its shard.
    """
    base = F.date_trunc("hour", run_start)
    parts = []
    for parsed, hours in ((before, -1), (after, 1)):
        at = base + F.make_dt_interval(hours=F.lit(hours))
        targets = parsed.select("file").distinct().withColumn("target", at)
        parts.append(retime(parsed, targets, order, tz).withColumn("_at", at))
    if transcript is not None:
        shifted = parse_lines(parts[0].select("file", "line", *order))
        anchor = anchor_or_previous_hour(first_event_time(shifted, order), run_start)
        at = base - F.expr("INTERVAL '1' HOUR")
        parts.append(align_transcript(transcript, anchor, order, tz).withColumn("_at", at))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    own = F.coalesce(*(parse_ts(F.get_json_object("line", f"$.{k}")) for k in ("ts", "loc_ts")))
    return out.select("file", F.coalesce(own, "_at").alias("ts"), "line", "retimed")
