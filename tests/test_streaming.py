"""Streams give the batch results for rows that are not late."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from eventide.operators import asof, bursts, gate, perception_events, tracks, trailing
from eventide.params import PerceptionParams
from eventide.streaming import lifecycle, lookups, stateful, windows

P = PerceptionParams(block_s=60.0, novelty_window_s=5.0, phash_distance_max=10)
END = 10_000_000  # seconds: a last row that moves the watermark past all others


def run(spark, tmp_path, df, make, name):
    """Land rows as three files, newest file first in no order, and run the stream to its end."""
    src = str(tmp_path / "in")
    df.repartition(3, "frame_idx").write.parquet(src)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 3).parquet(src)
    q = make(stream).writeStream.format("memory").queryName(name).option(
        "checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


def frames(spark, n, rng):
    rows = []
    for cam in ("a", "b"):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.5, 1.0, 2.0, 4.0, 7.0])
            rows.append((cam, t, i, rng.random(), rng.random() < 0.2, rng.getrandbits(63) if rng.random() < .5 else 7))
        rows.append((cam, float(END), n, 0.0, False, 0))
    df = spark.createDataFrame(rows, "camera string, t double, frame_idx long, motion double, presence boolean, phash long")
    objs = F.when(F.col("presence"), F.array(F.lit("cat"))).otherwise(F.array().cast("array<string>"))
    return df.withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t").withColumn("objects", objs)


def test_bursts(spark, tmp_path):
    df = gate.live_frames(frames(spark, 60, random.Random(1)), PerceptionParams(motion_threshold=0.8))
    got = run(spark, tmp_path, df, lambda s: stateful.burst_stream(s, P), "burst_out")
    want = bursts.bursts(df, P).where("not flushed and close_ts < timestamp_seconds(9999999)")
    cols = ["camera", "start_ts", "last_live_ts", "close_ts", "peak_motion", "live_frames"]
    a, b = got.where("close_ts < timestamp_seconds(9999999)").select(cols).collect(), want.select(cols).collect()
    assert sorted(a) == sorted(b) and len(a) > 3


def test_burst_lines(spark, tmp_path):
    """A stream reports starts, summaries and ends with the lines that the batch writes."""
    df = gate.live_frames(frames(spark, 60, random.Random(7)), PerceptionParams(motion_threshold=0.8))
    got = run(spark, tmp_path, df, lambda s: stateful.burst_line_stream(s, P), "burst_lines_out")
    closed = bursts.bursts(df, P).where("not flushed and close_ts < timestamp_seconds(9999999)")
    want = sorted(map(tuple, perception_events.burst_events(closed, P).select("camera", "type", "ts", "line").collect()))
    rows = sorted(map(tuple, got.select("camera", "type", "ts", "line").where("ts < timestamp_seconds(9999999)").collect()))
    assert [r for r in rows if r[1] != "burst.start"] == [r for r in want if r[1] != "burst.start"] and len(want) > 9
    assert set(r for r in want if r[1] == "burst.start") <= set(rows)


def test_novelty(spark, tmp_path):
    df = frames(spark, 50, random.Random(2))
    got = run(spark, tmp_path, df, lambda s: stateful.novelty_stream(s, P), "novelty_out")
    want = trailing.novelty(df, P).where(f"ts < timestamp_seconds({END})")
    cols = ["camera", "frame_idx", "hash_distance", "novelty"]
    assert sorted(map(tuple, got.select(cols).where(F.col("frame_idx") < 50).collect()), key=repr) == sorted(
        map(tuple, want.select(cols).collect()), key=repr)


def test_tracks(spark, tmp_path):
    rng = random.Random(3)
    rows = [("a", rng.choice(["cat", "dog"]), float(i // 2 + 1), i // 2, i % 2, 1000, 0.9, x := rng.randrange(60) * 1.0, 0.0, x + 50, 50.0)
            for i in range(80)]
    rows += [("a", c, float(END), 10**6, i, 1000, 0.9, 0.0, 0.0, 1.0, 1.0) for i, c in enumerate(["cat", "dog"])]
    df = spark.createDataFrame(
        rows, "camera string, cls string, t double, frame_idx long, det_idx int, img_w int, conf double, "
        "x1 double, y1 double, x2 double, y2 double"
    ).withColumn("ts", F.timestamp_micros((F.col("t") * 1e6).cast("long"))).drop("t")
    got = run(spark, tmp_path, df, lambda s: stateful.track_stream(s, P), "track_out")
    cols = ["cls", "frame_idx", "det_idx", "birth_frame", "birth_det", "match_no"]
    want = tracks.match_detections(df, P).where(F.col("frame_idx") < 1000)
    assert sorted(map(tuple, got.select(cols).collect())) == sorted(map(tuple, want.select(cols).collect()))


@pytest.mark.parametrize("make", [
    lambda s: windows.tumbling_counts(s, "1 minute", "1 second", "ts", ("camera",)),
    lambda s: windows.session_counts(s, "3 seconds", "1 second"),
])
def test_windows(spark, tmp_path, make):
    df = frames(spark, 40, random.Random(4))
    got = run(spark, tmp_path, df, make, f"win_{abs(hash(str(tmp_path)))}")
    assert got.agg(F.sum("n")).first()[0] == 80


def scene(spark, seed, n=70):
    """Frames and detections of two cameras that move, rest and vanish; camera z only moves the watermark."""
    rng = random.Random(seed)
    fr, dets = [], []
    for cam in ("a", "b"):
        t = 0.0
        for i in range(n):
            t += rng.choice([0.5, 0.5, 1.0, 1.5, 3.0, 30.0 if i % 11 == 0 else 1.0])
            fr.append((cam, t, i))
            for k in range(rng.choice([0, 1, 2, 3])):
                x = rng.choice([0.0, 300.0, 700.0]) + rng.randrange(40)
                dets.append((cam, rng.choice(["cat", "dog"]), t, i, k, 1000, rng.random(), x, 0.0, x + 60, rng.choice([20.0, 60.0])))
    fr.append(("z", float(END), 0))
    ts = F.timestamp_micros((F.col("t") * 1e6).cast("long"))
    f = spark.createDataFrame(fr, "camera string, t double, frame_idx long").withColumn("ts", ts).drop("t")
    d = spark.createDataFrame(
        dets, "camera string, cls string, t double, frame_idx long, det_idx int, img_w int, conf double, x1 double, y1 double, "
        "x2 double, y2 double").withColumn("ts", ts).drop("t")
    return f, d


def in_parts(spark, tmp_path, tables, make, name, parts):
    """The tables land in so many time slices, and the query is started anew, from its checkpoint, for each."""
    got = None
    for k, df in enumerate(tables):
        df.limit(0).write.mode("append").parquet(str(tmp_path / f"in{k}"))
    times = sorted(r.ts for r in tables[0].select("ts").distinct().collect())
    edges = [times[len(times) * k // parts] for k in range(1, parts)]
    for part in range(parts):
        for k, df in enumerate(tables):
            after = sum((F.col("ts") >= e).cast("int") for e in edges) if edges else F.lit(0)
            df.where(after == part).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in{k}"))
        streams = [spark.readStream.schema(df.schema).parquet(str(tmp_path / f"in{k}")) for k, df in enumerate(tables)]
        q = make(*streams).writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).format("parquet").start(
            str(tmp_path / "out"))
        q.awaitTermination(300)
        assert q.exception() is None
    return spark.read.parquet(str(tmp_path / "out"))


@pytest.mark.parametrize("parts,idle", [(1, None), (3, None), (3, 12.0)])
def test_track_lines(spark, tmp_path, parts, idle):
    """Enter, exit and summary lines of a stream are those of the batch, over restarts; silence ends tracks without a later row."""
    f, d = scene(spark, parts + int(idle or 0))
    make = lambda fs, ds: lifecycle.track_line_stream(fs, ds, P, "1 second", idle)
    got = in_parts(spark, tmp_path, (f, d), make, "lines", parts)
    table = tracks.tracks(d, lifecycle.with_silence(f, idle) if idle else f, P)
    want = perception_events.track_events(table, P)
    cols = ["camera", "ts", "type", "line"]
    a, b = sorted(map(tuple, got.select(cols).collect())), sorted(map(tuple, want.select(cols).collect()))
    assert a == b and {x[2].split(".")[1] for x in a} == {"enter", "exit", "summary"}
    if idle:  # the last tracks of a and b exit, though neither camera has a frame after them
        assert table.where("exit_ts IS NULL").isEmpty()


def test_idle_bursts_are_flushed(spark, tmp_path):
    """A burst left open by a silent camera ends as at the end of the camera's input, also when the camera comes back."""
    idle = 30.0
    df = frames(spark, 60, random.Random(11))
    us, camera = F.unix_micros("ts"), Window.partitionBy("camera")
    pause = (F.col("frame_idx") % 13 == 12) & (F.col("frame_idx") < 60)
    shift = F.sum(F.when(pause, F.lit(100_000_000)).otherwise(0)).over(camera.orderBy("frame_idx").rowsBetween(Window.unboundedPreceding, -1))
    df = df.where("frame_idx < 60").withColumn("ts", F.timestamp_micros(us + F.coalesce(shift, F.lit(0))))
    end = spark.createDataFrame([("z", 0, 0.0, False, 0)], "camera string, frame_idx long, motion double, presence boolean, phash long")
    end = end.selectExpr("*", f"timestamp_seconds({END}) AS ts", "CAST(array() AS array<string>) AS objects")
    live = gate.live_frames(df.unionByName(end), PerceptionParams(motion_threshold=0.5))
    got = in_parts(spark, tmp_path, (live,), lambda s: stateful.burst_line_stream(s, P, "1 second", idle), "flush", 3)
    pieces = F.sum(F.when(us - F.unix_micros(F.lag("ts").over(camera.orderBy("ts"))) > idle * 1e6, 1).otherwise(0)).over(
        camera.orderBy("ts"))
    cut = live.where("camera <> 'z'").withColumn("camera", F.concat_ws("#", "camera", pieces))
    want = perception_events.burst_events(bursts.bursts(cut, P), P).withColumn("camera", F.substring_index("camera", "#", 1))
    # ids of lines are made from the camera's name
    cols = ["camera", "ts", "type", F.regexp_replace("line", '"event_id":"[^"]*"', "").alias("line")]
    a = sorted(map(tuple, got.where("camera <> 'z'").select(cols).collect()))
    b = sorted(map(tuple, want.select(cols).collect()))
    assert a == b and sum("(flush)" in x[3] for x in a) >= 2


@pytest.mark.parametrize("gap", [2.0, 40.0])
def test_lookups(spark, tmp_path, gap):
    """Targets get the frames that the batch operators give them, over restarts; the last ones without a later frame."""
    rng = random.Random(int(gap))
    times = [(cam, i, rng.choice([0.5, 0.5, 3.0, 9.0])) for cam in "ab" for i in range(60)]
    fr, t = [], 0.0
    for cam, i, step in times:
        t = step if i == 0 else t + step
        fr.append((cam, t, i))
        if rng.random() < 0.2:
            fr.append((cam, t, i + 1000))
    targets = [(cam, float(rng.randrange(2, 500)) / 2, k) for k in range(80) for cam in "abc"]
    targets += [("z", float(END), 0)]
    ts = F.timestamp_micros((F.col("t") * 1e6).cast("long"))
    f = spark.createDataFrame(fr, "camera string, t double, frame_idx long").withColumn("ts", ts).drop("t")
    d = spark.createDataFrame(targets, "camera string, t double, pid long").withColumn("ts", ts).drop("t")
    both = lambda fs, ts_: lookups.nearest_frame_stream(ts_, fs, "ts", "pid", gap, "1 second").withColumn("rule", F.lit("near"))
    after = lambda fs, ts_: lookups.next_frame_stream(ts_, fs, "ts", "pid", gap, "1 second").withColumn("rule", F.lit("next"))
    near = in_parts(spark, tmp_path / "near", (f, d), both, "n", 3).where("camera <> 'z'")
    following = in_parts(spark, tmp_path / "next", (f, d), after, "a", 2).where("camera <> 'z'")
    mine = d.where("camera <> 'z'").withColumnRenamed("ts", "at")
    want = asof.nearest_frame(mine, f, "at", 30.0, gap).select("camera", "pid", "frame_ts", "frame_idx").collect()
    cols = ["camera", "pid", "frame_ts", "frame_idx"]
    assert sorted(map(tuple, near.select(cols).collect()), key=repr) == sorted(map(tuple, want), key=repr)
    limit = F.col("at") + F.expr(f"INTERVAL '{int(gap)}' SECOND")
    want = asof.next_frame_after(mine, f, "at", "frame_ts", 30.0).withColumn("frame_ts", F.when(F.col("frame_ts") <= limit, F.col("frame_ts")))
    got = following.select("camera", "pid", "frame_ts").collect()
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want.select("camera", "pid", "frame_ts").collect()), key=repr)
