"""Event lines from tracks and bursts.

Each function turns a state table into rows ``camera, ts, type, line`` where
``line`` is the JSON event.  All lines of one state row come from one pass: an
array of structs that is exploded, not a union of scans.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from eventide.functions.geometry import side_phrase
from eventide.functions.times import iso_local, iso_utc_micros
from eventide.params import PerceptionParams

# The message texts below follow the event format that readers of these lines know.
KEEP_NULLS = {"ignoreNullFields": "false"}


def _line(**fields: Column) -> Column:
    return F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())), KEEP_NULLS)


def _event(ts: Column, type_: Column, line: Column) -> Column:
    return F.struct(ts.alias("ts"), type_.alias("type"), line.alias("line"))


def _emit(df: DataFrame, *events: Column) -> DataFrame:
    """Rows of the events that are not NULL, in argument order."""
    every = F.filter(F.array(*events), lambda e: e.isNotNull())
    return df.select("camera", F.posexplode(every).alias("_seq", "_e")).select(
        "camera", "_e.ts", "_e.type", F.col("_seq").alias("seq"), "_e.line"
    )


def _tenths(box: Column) -> Column:
    return F.transform(box, lambda v: F.round(v, 1))


def track_events(track_table: DataFrame, p: PerceptionParams, enters: Column | None = None) -> DataFrame:
    """track.enter.*, track.exit and object.summary lines.  ``enters`` says which rows report an enter; all do by default."""
    c = F.col
    local = lambda t: iso_local(t, p.local_tz)
    source = F.lit(p.source)
    tid = c("tid").cast("int")
    who = F.format_string("%s[tid=%d]", c("cls"), c("tid"))

    enter_type = F.concat(F.lit("track.enter."), c("first_side"))
    enter = F.when(
        c("enter_ts").isNotNull() & (F.lit(True) if enters is None else enters),
        _event(c("enter_ts"), enter_type, _line(
            type=enter_type, ts=local(c("enter_ts")), source=source, tid=tid, cls=c("cls"),
            confidence=F.round("enter_conf", 3), bbox_pxls=_tenths(c("enter_bbox")),
            msg=F.format_string("%s entered via %s side", who, c("first_side")),
        )),
    )
    lost = c("exit_reason") == "lost_in_center"
    exit_msg = F.when(lost, F.format_string(
        "%s lost near center; exit_side=center, exit_reason=lost_in_center (not literally, the detector lost it)", who,
    )).otherwise(F.format_string("%s exited toward %s side (exit_reason=%s)", who, c("exit_side"), c("exit_reason")))
    left = F.when(
        c("exit_ts").isNotNull(),
        _event(c("exit_ts"), F.lit("track.exit"), _line(
            type=F.lit("track.exit"), ts=local(c("exit_ts")), source=source, tid=tid, cls=c("cls"),
            bbox_pxls=_tenths(c("last_bbox")), last_side=c("last_side"), exit_side=c("exit_side"),
            exit_reason=c("exit_reason"), msg=exit_msg,
        )),
    )
    begin, end = local(c("enter_ts")), local(c("exit_ts"))
    seen = F.format_string(
        "%s seen%s for %.1fs (%s → %s)", who, side_phrase(c("first_side"), c("exit_side")), c("duration_s"), begin, end,
    )
    summary = F.when(
        c("exit_ts").isNotNull() & c("enter_ts").isNotNull(),
        _event(c("exit_ts"), F.lit("object.summary"), _line(
            type=F.lit("object.summary"), ts=end, source=source, tid=tid, cls=c("cls"), start_ts=begin, end_ts=end,
            duration_s=F.round("duration_s", 3), first_side=c("first_side"), last_side=c("last_side"),
            exit_side=c("exit_side"), exit_reason=c("exit_reason"),
            msg=F.when(lost, F.concat(seen, F.lit(" – track lost near center; not always exited"))).otherwise(seen),
        )),
    )
    return _emit(track_table, enter, left, summary)


def burst_events(burst_table: DataFrame, p: PerceptionParams, starts: Column | None = None) -> DataFrame:
    """burst.start for every burst; motion.summary and burst.end for those long enough.

    An open burst at the end of input is reported at its camera's last frame.
    ``starts`` says which rows report a start; all do by default.
    """
    c = F.col
    local = lambda t: iso_local(t, p.local_tz)
    source = F.lit(p.source)
    name = lambda objs, none: F.when(F.size(objs) > 0, F.array_join(objs, "/")).otherwise(none)

    begins = F.lit(True) if starts is None else starts
    start = F.when(begins, _event(c("start_ts"), F.lit("burst.start"), _line(
        type=F.lit("burst.start"), ts=local(c("start_ts")), source=source, objects=c("first_objects"),
        motion_score=F.round("first_motion", 3),
        msg=F.format_string(
            "burst started when %s seen; motion_score=%.2f", name(c("first_objects"), "-"), c("first_motion")),
    )))
    at = F.coalesce("close_ts", "last_row_ts")
    begin, last = iso_utc_micros(c("start_ts")), iso_utc_micros(c("last_live_ts"))
    label = name(c("objects"), "motion")
    dur = c("duration_s")
    flushed = lambda text: F.when(c("flushed"), text).otherwise("")
    # stable id: derived from what identifies the burst, not from a clock
    ident = F.sha1(F.concat_ws("|", c("camera"), begin))
    summary = F.when(c("kept"), _event(at, F.lit("motion.summary"), _line(
        type=F.lit("motion.summary"), event_id=F.concat(F.lit("ev_"), ident), ts=local(at), source=source,
        motion_score=F.round("peak_motion", 3), novelty=F.lit(None).cast("string"), objects=c("objects"),
        frames=F.create_map().cast("map<string,string>"), clip=F.lit(""),
        notes=F.format_string(
            "%s start=%s last=%s dur=%.1fs", F.when(c("flushed"), "flush_on_exit").otherwise("burst"), begin, last, dur),
        msg=F.concat(
            F.format_string("%s from %s to %s (~%.1fs), peak motion_score=%.2f", label, begin, last, dur, c("peak_motion")),
            flushed(" (flush)")),
    )))
    end = F.when(c("kept"), _event(at, F.lit("burst.end"), _line(
        type=F.lit("burst.end"), ts=local(at), source=source, objects=c("objects"), start_ts=begin, end_ts=last,
        duration_s=F.round(dur, 3),
        msg=F.concat(
            F.format_string("burst ended for %s", label), flushed(" on flush"),
            F.format_string("; duration %.1fs (%s → %s)", dur, begin, last)),
    )))
    return _emit(burst_table, start, summary, end)
