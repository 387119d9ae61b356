"""Streams from files: late and repeated events, and a restart from the checkpoint, against a plain batch version."""

import datetime as dt
import json

import numpy as np
from pyspark.sql import functions as F

from loomtide.operators import commits, groups, store
from loomtide.streaming import live, views

EVENTS = "session string, seq long, kind string, text string, at timestamp"
PIECES = "session string, seq long, seconds double, text string, at timestamp"


def stream(spark, folder, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(f"file://{folder}").withWatermark("at", "20 seconds")


def put(folder, name, rows):
    folder.mkdir(exist_ok=True)
    (folder / f"{name}.json").write_text("\n".join(json.dumps(r) for r in rows))


def run(out, tmp_path):
    query = out.writeStream.format("parquet").option("path", f"file://{tmp_path}/out").option("checkpointLocation", f"file://{tmp_path}/checkpoint").trigger(availableNow=True).start()
    assert query.awaitTermination(120)
    assert query.exception() is None


def at(second):
    return f"2030-01-01T10:{second // 60:02d}:{second % 60:02d}"


def test_sessions_end_as_a_batch_says(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    event = lambda s, n, kind, text, t: {"session": s, "seq": n, "kind": kind, "text": text, "at": at(t)}
    put(tmp_path / "in", "1", [event("a", 0, "partial", "call", 0), event("a", 2, "done", None, 2), event("b", 0, "partial", "buy", 1), event("c", 0, "partial", "old", 1), event("c", 1, "partial", None, 2), event("d", 0, "partial", "x", 1), event("d", 1, "done", None, 2)])
    run(live.final_transcripts(stream(spark, tmp_path / "in", EVENTS)), tmp_path)
    # The final arrives after the done behind it; repeats; the stream is started again from its checkpoint.
    put(tmp_path / "in", "2", [event("a", 1, "final", "call Anna", 1), event("b", 0, "partial", "other", 3), event("b", 1, "final", "buy milk", 4), event("b", 1, "final", "buy milk", 4), event("d", 2, "final", "too late", 5)])
    run(live.final_transcripts(stream(spark, tmp_path / "in", EVENTS)), tmp_path)
    put(tmp_path / "in", "3", [event("e", 0, "final", "later", 300)])
    put(tmp_path / "in", "4", [event("e", 0, "final", "later", 302)])
    run(live.final_transcripts(stream(spark, tmp_path / "in", EVENTS)), tmp_path)
    got = sorted((r.session, r.text, r.outcome) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == [("a", "call Anna", "final"), ("b", "buy milk", "final"), ("c", "", "timeout"), ("d", "x", "partial"), ("e", "later", "final")]


def plain_windows(pieces, seconds):
    out = []
    by_session = {}
    for p in pieces:
        by_session.setdefault(p["session"], {}).setdefault(p["seq"], p)
    for s, some in by_session.items():
        window, length, text = 0, 0.0, ""
        for n in sorted(some):
            length, text = length + some[n]["seconds"], f"{text} {some[n]['text'] or ''}".strip()
            if length > seconds:
                out.append((s, window, text))
                window, length, text = window + 1, 0.0, ""
        if text:
            out.append((s, window, text))
    return sorted(out)


def test_windows_are_committed_in_order(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    pieces = [{"session": s, "seq": n, "seconds": 7.0 + n % 3, "text": f"{s}{n}" if n % 5 else None, "at": at(n)} for s in "xy" for n in range(14)]
    late = [p for p in pieces if p["seq"] in (2, 3)]
    first = [p for p in pieces if p["seq"] not in (2, 3)]
    put(tmp_path / "in", "1", first[::-1])
    run(live.committed_windows(stream(spark, tmp_path / "in", PIECES)), tmp_path)
    put(tmp_path / "in", "2", [*late, *late, first[0]])
    put(tmp_path / "in", "3", [{"session": "z", "seq": 0, "seconds": 1.0, "text": "end", "at": at(400)}])
    run(live.committed_windows(stream(spark, tmp_path / "in", PIECES)), tmp_path)
    got = sorted((r.session, r.window, r.text) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == plain_windows(pieces, 25.0)


def snapshot(spark, step):
    rows = [(f"t{k}", k % 3 == step % 3, None if k % 7 == 0 else dt.date(2030, 1, 1) + dt.timedelta(days=(k * 5 + step) % 40), dt.datetime(2030, 1, 10, 23, 30) - dt.timedelta(days=(k + step) % 6) if k % 3 == step % 3 else None) for k in range(step, 60 + 5 * step)]
    return spark.createDataFrame(rows, "id string, completed boolean, due_date date, completed_at timestamp")


def test_views_equal_the_batch_version_after_every_batch(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    today, path = dt.date(2030, 1, 11), f"file://{tmp_path}/views"
    before = snapshot(spark, 0).limit(0)
    for step in range(3):
        after = snapshot(spark, step)
        views.changes_between(before, after).coalesce(1).write.mode("append").json(f"file://{tmp_path}/feed")
        query = views.keep_views(spark.readStream.schema(views.CHANGE).json(f"file://{tmp_path}/feed"), path, f"file://{tmp_path}/checkpoint", "Asia/Tashkent")
        assert query.awaitTermination(120) and query.exception() is None
        assert views.live_totals(spark, path).first() == store.totals(after).first()
        want = groups.group_headers(after.where(~F.col("completed") & (F.col("due_date") > F.lit(today))), today)
        assert sorted(map(tuple, views.live_headers(spark, path, today).collect())) == sorted(map(tuple, want.collect()))
        by_day = groups.completions_by_day(after.where("completed").withColumn("owner", F.lit("all")), "Asia/Tashkent")
        assert views.live_streak(spark, path, today).first() == groups.owner_stats(by_day, today).select("done_last_7", "streak_days").first()
        before = after
    # A batch that comes again changes nothing.
    old = sorted(map(tuple, commits.read_version(spark, path).collect()), key=str)
    assert not views.apply_changes(views.changes_between(before.limit(0), before), path, 1)
    assert sorted(map(tuple, commits.read_version(spark, path).collect()), key=str) == old


def test_a_new_day_is_told_once(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    put(tmp_path / "in", "1", [{"at": f"2030-01-0{d}T{h:02d}:00:00"} for d in (1, 2) for h in (1, 12, 20)])
    put(tmp_path / "in", "2", [{"at": "2030-01-02T18:30:00"}, {"at": "2030-01-03T01:00:00"}])
    ticks = spark.readStream.schema("at timestamp").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in").withWatermark("at", "2 days")
    run(views.day_changes(ticks, "Asia/Tashkent"), tmp_path)
    got = sorted(str(r.day) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    assert got == ["2030-01-01", "2030-01-02", "2030-01-03"]


def test_gate_keeps_its_floor_over_batches_and_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    rng = np.random.default_rng(2)
    loud = [0.002, 0.0005, 0.2, 0.25, 0.0006, 0.3, 0.0004, 0.0005, 0.1, 0.004]
    frames = [(s, n, (rng.choice([-1, 1], 320) * level * 32767).astype("<i2").tobytes(), dt.datetime(2030, 1, 1, 0, 0, n)) for s in "ab" for n, level in enumerate(loud)]
    schema = "stream string, seq long, pcm binary, at timestamp"
    write = lambda rows, name: spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"file://{tmp_path}/in/{name}")
    start = lambda: run(live.voice_gate(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in/*").withWatermark("at", "20 seconds")), tmp_path)
    write([f for f in frames if f[1] < 5][::-1], "1")
    start()
    write([*(f for f in frames if f[1] >= 5), frames[0], frames[6]], "2")
    start()
    got = sorted((r.stream, r.seq, r.voiced) for r in spark.read.parquet(f"file://{tmp_path}/out").collect())
    want = []
    for s in "ab":
        levels = np.array([np.sqrt(np.mean((np.frombuffer(p, "<i2") / 32768.0) ** 2)) for k, _, p, _ in frames if k == s])
        want += [(s, n, bool(v)) for n, v in enumerate(live.gate_frames(levels, live.FLOOR_CAP)[0])]
    assert got == want


def test_watch_tells_of_batches_that_moved_the_table(spark, tmp_path):
    seen, tables = [], [snapshot(spark, 0), snapshot(spark, 0), snapshot(spark, 1)]
    marked = [t.withColumn("updated_at", F.lit(dt.datetime(2030, 1, 1, 0, k // 2))) for k, t in enumerate(tables)]
    for k in range(3):
        put(tmp_path / "in", str(k), [{"id": k}])
    feed = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).json(f"file://{tmp_path}/in")
    query = live.watch(feed, lambda: marked.pop(0), lambda rows, number: seen.append((number, rows.count())), f"file://{tmp_path}/checkpoint")
    assert query.awaitTermination(120) and query.exception() is None
    assert seen == [(0, 60), (2, 64)]
