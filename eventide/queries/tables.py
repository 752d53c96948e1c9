"""The driver's tables as inputs of the library.

Each adapter has a SQL twin in :mod:`eventide.queries.sql` that gives the same
rows in DuckDB.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventide.functions import payload as P
from eventide.functions.times import iso_local, iso_z, quarter_start

CAMERAS = 8
EPOCH = "2024-01-01 00:00:00"
KINDS_WITH_OBJECTS = ("click", "purchase")
CLASS_OF = {"click": "person", "view": "dog", "purchase": "cat", "error": "bird", "signup": "car"}


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def events(spark: SparkSession, sf: str) -> DataFrame:
    """Driver events with ``ts`` as an instant, a camera and a motion score in [0, 1]."""
    motion = F.col("value").cast("decimal(10,2)") * F.lit("0.002").cast("decimal(4,3)")
    return (
        read(spark, sf, "events")
        .withColumn("ts", F.col("ts").cast("timestamp"))
        .withColumn("camera", F.concat(F.lit("cam_"), (F.col("user_id") % CAMERAS).cast("string")))
        .withColumn("motion_dec", motion.cast("decimal(12,5)"))
        .withColumn("motion", F.col("motion_dec").cast("double"))
    )


def _offsets(ts: Column) -> tuple[Column, Column]:
    none = F.lit(None)
    t0, t1, _ = P.offsets(ts, none.cast("timestamp"), none.cast("bigint"), none.cast("bigint"), 2000, 3000)
    return t0, t1


def sensor_journal(spark: SparkSession, sf: str) -> DataFrame:
    """Journal rows of the events table; ``view`` events are motion summaries."""
    e = events(spark, sf)
    c = F.col
    t0, t1 = _offsets(c("ts"))
    motion = c("event_type") == "view"
    quarter = F.unix_seconds(quarter_start(c("ts")))
    body = F.concat(F.lit('{"type":"motion.summary","motion_score":'), c("motion_dec").cast("string"), F.lit("}"))
    return e.select(
        F.concat(F.lit("e"), c("event_id").cast("string")).alias("event_id"),
        c("camera").alias("source"),
        F.when(motion, "motion.summary").otherwise(c("event_type")).alias("kind"),
        t0.alias("t0_ms"), t1.alias("t1_ms"),
        F.when((quarter / 900).cast("bigint") % 3 == 0, "")
        .otherwise(F.concat_ws("/", c("camera"), quarter.cast("string"))).alias("clip_id"),
        F.when(motion, body).otherwise(c("props")).alias("payload"),
        F.date_trunc("second", "ts").alias("created_utc"),
    )


def turns(spark: SparkSession, sf: str) -> DataFrame:
    """Conversation turns with a time, a kind and an utterance end for even conversations."""
    c = F.col
    ts = F.timestamp_seconds(F.unix_seconds(F.lit(EPOCH).cast("timestamp")) + c("conv_id") * 3600 + c("turn") * 60)
    kind = F.when(c("role") == "system", "speech.suppressed").otherwise("speech")
    length = F.char_length("text") % 20
    end = F.when(c("conv_id") % 2 == 0, F.timestamp_seconds(F.unix_seconds("ts") + length))
    return (
        read(spark, sf, "conversations")
        .withColumn("ts", ts)
        .withColumn("kind", kind)
        .withColumn("end_ts", end)
        .withColumn("event_id", F.concat_ws("_", F.concat(F.lit("c"), c("conv_id").cast("string")), "turn"))
    )


def speech_journal(spark: SparkSession, sf: str) -> DataFrame:
    c = F.col
    t = turns(spark, sf)
    t0, t1 = _offsets(c("ts"))
    body = F.to_json(F.struct(
        c("kind").alias("type"), "text", iso_z(c("ts")).alias("start_utc"), iso_z(c("end_ts")).alias("end_utc")))
    return t.select(
        "event_id", F.concat(F.lit("mic_"), (c("conv_id") % 4).cast("string")).alias("source"), "kind",
        t0.alias("t0_ms"), t1.alias("t1_ms"), F.lit("").alias("clip_id"), body.alias("payload"),
        c("ts").alias("created_utc"),
    )


def journal(spark: SparkSession, sf: str) -> DataFrame:
    return sensor_journal(spark, sf).unionByName(speech_journal(spark, sf))


def bounds(j: DataFrame) -> DataFrame:
    """One row: first day start to last day end of a journal."""
    day = F.expr("INTERVAL '23:59:59' HOUR TO SECOND")
    return j.agg(F.min("created_utc").alias("a"), F.max("created_utc").alias("z")).select(
        F.date_trunc("day", "a").alias("start"), (F.date_trunc("day", "z") + day).alias("end")
    )


def lines(spark: SparkSession, sf: str) -> DataFrame:
    """Events as loosely written JSON lines, one shard per camera and day.

    Shapes by event type: click and purchase carry a type, view has no type but
    a score, signup has a number as type and objects, error has neither.
    """
    e, c = events(spark, sf), F.col
    head = (
        F.when(c("event_type").isin(*KINDS_WITH_OBJECTS), F.concat(F.lit('"type": "'), c("event_type"), F.lit('", ')))
        .when(c("event_type") == "view", '"motion_score": null, ')
        .when(c("event_type") == "signup", '"type": 7, "objects": [], ')
        .otherwise("")
    )
    source = F.when(c("event_type") != "error", F.concat(F.lit('"source": "'), c("camera"), F.lit('", '))).otherwise("")
    explicit = F.when(
        c("user_id") % 5 == 0,
        F.concat(F.lit('"t0_ms": '), c("user_id").cast("string"), F.lit(', "t1_ms": "'),
                 (c("user_id") + 50).cast("string"), F.lit('", ')),
    ).otherwise("")
    line = F.concat(
        F.lit("  { "), head, F.lit('"ts": "'), iso_local(c("ts")), F.lit('", '), source, explicit,
        F.lit('"id":  '), c("event_id").cast("string"), F.lit(', "msg": "a  \\"b\\"\\t: é"}  '),
    )
    file = F.concat_ws("/", F.lit("/events"), F.date_format("ts", "yyyy-MM-dd"), F.concat(c("camera"), F.lit(".jsonl")))
    return e.select(file.alias("file"), c("event_id").alias("line_no"), line.alias("line"))


def segments(spark: SparkSession, sf: str) -> DataFrame:
    """Recordings ``path``: one per quarter hour with events, every third missing."""
    q = quarter_start(F.col("ts"))
    return (
        events(spark, sf)
        .select(q.alias("q"))
        .distinct()
        .where((F.unix_seconds("q") / 900).cast("bigint") % 3 != 0)
        .select(F.date_format("q", "'/record/'yyyy-MM-dd'/cam_sim_'HH-mm'.mkv'").alias("path"))
    )


def frames(spark: SparkSession, sf: str) -> DataFrame:
    """Events as frames: camera, ts, frame_idx, motion, objects, presence, bytes."""
    e, c = events(spark, sf), F.col
    present = c("event_type").isin(*KINDS_WITH_OBJECTS)
    return e.select(
        "camera", "ts", c("event_id").alias("frame_idx"), "motion", present.alias("presence"),
        F.when(present, F.array(class_of(c("event_type")))).otherwise(F.array().cast("array<string>")).alias("objects"),
        (c("value") * 100).cast("bigint").alias("bytes"), F.lit(1000).alias("img_w"),
    )


def class_of(event_type: Column) -> Column:
    out = F.lit(None).cast("string")
    for k, v in CLASS_OF.items():
        out = F.when(event_type == k, v).otherwise(out)
    return out


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """Events as detections: frames are 10-minute slots of a camera, boxes follow the ids."""
    e, c = events(spark, sf), F.col
    slot = F.floor(F.unix_seconds("ts") / 600)
    x1 = (c("user_id") * 7 % 700).cast("double")
    y1 = (c("user_id") * 11 % 400).cast("double")
    w = (c("event_id") % 5 * 30 + 240).cast("double")
    return e.select(
        "camera", slot.cast("bigint").alias("frame_idx"), F.timestamp_seconds(slot * 600).alias("ts"),
        F.lit(1000).alias("img_w"), c("event_id").cast("int").alias("det_idx"),
        class_of(c("event_type")).alias("cls"), c("motion").alias("conf"),
        x1.alias("x1"), y1.alias("y1"), (x1 + w).alias("x2"), (y1 + w).alias("y2"),
    )


def detection_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames of :func:`detections`: every slot of a camera with events of any class."""
    return detections(spark, sf).groupBy("camera", "frame_idx", "ts").agg(F.max("conf").alias("motion"))


LANES, LANE_PX = 64, 1500


def lane_detections(spark: SparkSession, sf: str) -> DataFrame:
    """Events as detections in lanes by user: boxes of one lane are equal, those of two lanes never touch.

    So a lane's tracks are its runs without a long gap, which SQL can say too.
    """
    e, c = events(spark, sf), F.col
    slot = F.floor(F.unix_seconds("ts") / 600).cast("bigint")
    d = e.groupBy("camera", slot.alias("frame_idx"), class_of(c("event_type")).alias("cls"), (c("user_id") % LANES).alias("lane"))
    x = (c("lane") * LANE_PX).cast("double")
    return d.agg(F.min("event_id").cast("int").alias("det_idx")).select(
        "camera", "frame_idx", F.timestamp_seconds(c("frame_idx") * 600).alias("ts"), F.lit(LANES * LANE_PX).alias("img_w"),
        "det_idx", "cls", F.lit(0.5).alias("conf"), x.alias("x1"), F.lit(0.0).alias("y1"), (x + 300).alias("x2"),
        F.lit(300.0).alias("y2"),
    )


def hashed_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings as frames one second apart, with the sign bits as a 64-bit hash."""
    bits = F.aggregate(
        F.transform("embedding", lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("bigint"), i)).otherwise(F.lit(0).cast("bigint"))),
        F.lit(0).cast("bigint"),
        lambda a, b: a.bitwiseOR(b),
    )
    c = F.col
    return read(spark, sf, "embeddings").select(
        F.concat(F.lit("cam_"), (c("label") % 3).cast("string")).alias("camera"),
        F.timestamp_seconds(F.unix_seconds(F.lit(EPOCH).cast("timestamp")) + c("vec_id")).alias("ts"),
        c("vec_id").alias("frame_idx"), bits.alias("phash"),
    )
