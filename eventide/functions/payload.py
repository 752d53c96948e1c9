"""JSON payload handling, content ids, paths and offsets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from eventide.functions.times import hour_start, parse_ts, quarter_start, strip

# A string literal (kept) or a run of white space (dropped).  Possessive, so
# long strings need no backtracking stack.
_COMPACT = r'("[^"\\]*+(?:\\.[^"\\]*+)*+")|\s+'

SPEECH_KINDS = ("speech", "speech.suppressed")  # fixed values
MOTION_KIND = "motion.summary"
SEGMENT_NAME = r"(?i)_(\d{2})-(\d{2})\.(?:mkv|mp4|avi|mov)$"


# What ingest reads of a line.  VARIANT keeps "there but null" and the JSON type.
RECORD = (
    "struct<type:variant,motion_score:variant,objects:variant,clip:variant,loc_ts:string,source:string,"
    "ts:string,start_ts:string,end_ts:string,start_utc:string,end_utc:string,created_utc:string,"
    "t0_ms:bigint,t1_ms:bigint,start_ms:bigint,end_ms:bigint,novelty:string,confidence:double,"
    "text:string,model:string,wav:string,sr:int,lang:string>"
)


def text_of(v: Column) -> Column:
    """A VARIANT's text when it is a JSON string, else NULL."""
    return F.when(F.schema_of_variant(v) == "STRING", v.cast("string"))


def kind_of(r: Column) -> Column:
    """Kind of a record: its type, or by the keys it has (a null value counts)."""
    return F.coalesce(
        text_of(r["type"]),
        F.when(r["motion_score"].isNotNull(), "motion").when(r["objects"].isNotNull(), "objects").otherwise("event"),
    )


def source_of(r: Column, default: str) -> Column:
    return F.coalesce(r["source"], F.lit(default))


def event_time(r: Column) -> Column:
    """First usable of ts, loc_ts, start_utc, start_ts: never the wall clock."""
    return F.coalesce(*(parse_ts(r[k]) for k in ("ts", "loc_ts", "start_utc", "start_ts")))


def compact(line: Column) -> Column:
    """Drop white space outside strings; key order and text stay."""
    return F.regexp_replace(line, _COMPACT, "$1")


def sha1_short(text: Column, n: int = 10) -> Column:
    return F.left(F.sha1(text), F.lit(n))


def event_id(source: Column, kind: Column, clip_id: Column, t0_ms: Column, payload: Column) -> Column:
    clip = F.when(clip_id == "", "-").otherwise(F.coalesce(clip_id, F.lit("-")))
    return F.sha1(F.concat_ws("|", source, kind, clip, t0_ms.cast("string"), sha1_short(payload, 16)))


def clip_id(path: Column, start: Column, end: Column) -> Column:
    """Content id of a media segment; missing bounds count as empty text."""
    return F.sha1(F.concat_ws("|", *(F.coalesce(c, F.lit("")) for c in (path, start, end))))


def segment_path(root: str, camera: Column, ts: Column, ext: str) -> Column:
    """Where the 15-minute recording holding ``ts`` would be."""
    q = quarter_start(ts)
    return F.concat(
        F.lit(root.rstrip("/") + "/"), F.date_format(q, "yyyy-MM-dd"), F.lit("/"), camera,
        F.date_format(q, "_HH-mm"), F.lit(f".{ext}"),
    )


def segment_bounds(path: Column) -> tuple[Column, Column]:
    """(start, end) of a recording from its day folder and name; NULLs if neither form fits."""
    name = F.regexp_extract(path, r"([^/]+)$", 1)
    day = F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)
    hh, mm = F.regexp_extract(name, SEGMENT_NAME, 1), F.regexp_extract(name, SEGMENT_NAME, 2)
    exact = F.concat_ws(" ", day, F.concat(hh, F.lit(":"), mm))
    quarter = F.when(name.rlike(SEGMENT_NAME), quarter_start(F.try_to_timestamp(exact, F.lit("yyyy-MM-dd HH:mm"))))
    # otherwise the number after the last underscore, up to a dash, is an hour
    hour_text = F.regexp_extract(name, r"(?:^|_)(\d{1,2})(?:-[^_]*)?$", 1)
    hour = F.when(
        ~name.rlike(SEGMENT_NAME) & (hour_text != ""),
        F.try_to_timestamp(F.concat_ws(" ", day, F.lpad(hour_text, 2, "0")), F.lit("yyyy-MM-dd HH")),
    )
    start = F.coalesce(quarter, hour)
    end = F.when(quarter.isNotNull(), quarter + F.expr("INTERVAL '15' MINUTE")).otherwise(
        hour + F.expr("INTERVAL '1' HOUR")
    )
    return start, end


def media_path(clip: Column, shard_file: Column, clips_dir: str) -> Column:
    """Absolute path of a line's (stripped) ``clip`` text; NULL when blank."""
    norm = F.regexp_replace(F.nullif(clip, F.lit("")), r"\\", "/")
    parent = clips_dir.rstrip("/").rsplit("/", 1)[0]
    base = (
        F.when(norm.startswith("/"), "")
        .when(norm.startswith("record/"), f"{parent}/")
        .otherwise(F.regexp_replace(shard_file, r"[^/]*$", ""))
    )
    return F.concat(base, norm)


def explicit_offsets(r: Column) -> tuple[Column, Column]:
    """(t0, t1) given in the line: t0_ms/t1_ms first, then start_ms/end_ms; both or neither."""
    a, b, c, d = r["t0_ms"], r["t1_ms"], r["start_ms"], r["end_ms"]
    first, second = a.isNotNull() & b.isNotNull(), c.isNotNull() & d.isNotNull()
    return F.when(first, a).when(second, c), F.when(first, b).when(second, d)


def offsets(
    ts: Column, segment_start: Column, x0: Column, x1: Column, pre_ms: int, post_ms: int
) -> tuple[Column, Column, Column]:
    """(t0_ms, t1_ms, basis) around an event.

    Explicit offsets win; else milliseconds from the segment start or, without
    one, from the full hour.  With a segment its epoch start is added, also to
    explicit offsets.
    """
    base = F.coalesce(segment_start, hour_start(ts))
    delta = F.floor((F.unix_micros(ts) - F.unix_micros(base)) / 1000).cast("bigint")
    near0 = F.greatest(F.lit(0).cast("bigint"), delta - pre_ms)
    t0 = F.coalesce(x0, near0, F.lit(0).cast("bigint"))
    t1 = F.coalesce(x1, delta + post_ms, F.lit(pre_ms + post_ms).cast("bigint"))
    shift = F.coalesce(F.unix_millis(segment_start), F.lit(0).cast("bigint"))
    basis = (
        F.when(segment_start.isNotNull(), "epoch")
        .when(x0.isNotNull(), "explicit")
        .when(ts.isNotNull(), "hour")
        .otherwise("none")
    )
    return t0 + shift, t1 + shift, basis


def is_speech(kind: Column) -> Column:
    return kind.isin(*SPEECH_KINDS)


def is_motion(kind: Column, payload_type: Column) -> Column:
    return F.coalesce(kind == MOTION_KIND, F.lit(False)) | F.coalesce(payload_type == MOTION_KIND, F.lit(False))


def speech_seconds(start: Column, end: Column, t0_ms: Column, t1_ms: Column) -> Column:
    """Utterance length; offsets stand in for missing times, but not when either is 0."""
    spoken = (F.unix_micros(end) - F.unix_micros(start)) / F.lit(1e6)
    fallback = F.greatest(F.lit(0.0), (t1_ms - t0_ms) / F.lit(1000.0))
    return (
        F.when(start.isNotNull() & end.isNotNull() & (end >= start), spoken)
        .when((t0_ms != 0) & (t1_ms != 0), fallback)
        .otherwise(F.lit(0.0))
    )
