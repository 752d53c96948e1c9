"""Table schemas."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _L, _I, _D, _TS = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


EVENTS = _struct(
    event_id=_S, source=_S, kind=_S, t0_ms=_L, t1_ms=_L, offset_basis=_S, clip_id=_S,
    novelty=_S, confidence=_D, payload=_S, created_utc=_TS,
)
# columns the rollup needs; a missing one degrades to NULL with a warning
ROLLUP_COLUMNS = ("event_id", "source", "kind", "t0_ms", "t1_ms", "clip_id", "created_utc", "payload")

CLIPS = _struct(clip_id=_S, path=_S, start_utc=_TS, end_utc=_TS)

CAPTIONS = _struct(
    event_id=_S, text=_S, model=_S, tokens=_I, wav=_S, start_utc=_TS, end_utc=_TS,
    sr=_I, lang=_S, created_utc=_TS,
)

QUARANTINE = _struct(quarantine_id=_S, file=_S, line_no=_L, reason=_S, copies=_L, line=_S)

FRAMES = _struct(
    camera=_S, frame_idx=_L, ts=_TS, img_w=_I, motion=_D, phash=_L, objects=T.ArrayType(_S),
)

DETECTIONS = _struct(
    camera=_S, frame_idx=_L, ts=_TS, img_w=_I, det_idx=_I, cls=_S, conf=_D, x1=_D, y1=_D, x2=_D, y2=_D,
)

# union of every event line shape, for from_json
PAYLOAD = _struct(
    type=_S, ts=_S, source=_S, msg=_S, tid=_I, cls=_S, confidence=_D, bbox_pxls=T.ArrayType(_D),
    first_side=_S, last_side=_S, exit_side=_S, exit_reason=_S, start_ts=_S, end_ts=_S, duration_s=_D,
    objects=T.ArrayType(_S), motion_score=_D, event_id=_S, novelty=_S,
    frames=T.MapType(_S, _S), clip=_S, notes=_S, wav=_S, start_utc=_S, end_utc=_S, lang=_S, model=_S,
    text=_S, created_utc=_S, sr=_I, loc_ts=_S, t0_ms=_L, t1_ms=_L, start_ms=_L, end_ms=_L,
)
