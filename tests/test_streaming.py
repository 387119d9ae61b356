"""Recordings, sources, updates and words."""

import datetime as dt
import json
import struct

import numpy as np
from pyspark.sql import functions as F

from loomtide.functions import numerals, text
from loomtide.operators import entities, store
from loomtide.sources import readers
from loomtide.streaming import live


def test_recordings(spark):
    table = spark.createDataFrame([("a", 0.5), ("b", 0.9), ("c", 75.0), ("d", None)], "session string, seconds double")
    assert sorted(tuple(r) for r in live.recordings(table).collect()) == [("b", 0.9, False), ("c", 60.0, True)]


def test_sources(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"now": "2026-09-21T10:00", "cases": [{"note": "x", "tasks": [{"title": "X", "date": None, "time": None}]}, {"note": "y", "tasks": []}]}))
    rows = readers.read_corpus(spark, f"file://{tmp_path}/c.json").collect()
    assert [(r.corpus, r.number, r.now, r.note, len(r.expected)) for r in rows] == [("c", 0, dt.datetime(2026, 9, 21, 10), "x", 1), ("c", 1, dt.datetime(2026, 9, 21, 10), "y", 0)]
    pcm = np.full(100, 8192, "<i2").tobytes()
    wav = lambda rate: b"RIFF" + struct.pack("<I", 36 + len(pcm)) + b"WAVE" + b"LIST" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<IHHIIHH", 16, 1, 1, rate, rate * 2, 2, 16) + b"data" + struct.pack("<I", len(pcm)) + pcm
    (tmp_path / "a.wav").write_bytes(wav(16000))
    (tmp_path / "b.wav").write_bytes(wav(8000))
    got = sorted((r.path[-5:], r.n_samples, r.rms) for r in readers.read_wav(spark, f"file://{tmp_path}").collect())
    assert got[0] == ("a.wav", 100, 0.25) and got[1][0] == "b.wav" and got[1][2] is None or np.isnan(got[1][2])
    (tmp_path / "x.info").write_text("SF:a.dart\nDA:1,0\nDA:2,3\nDA:1,2\nend_of_record\nSF:b.dart\nDA:1,0\nend_of_record\n")
    assert sorted(tuple(r) for r in readers.read_lcov(spark, f"file://{tmp_path}/x.info").collect()) == [("a.dart", 2, 2), ("b.dart", 1, 0)]


def test_updates_and_slots(spark):
    now = spark.createDataFrame([(1, "a"), (2, None), (3, "c")], "id int, title string")
    changes = spark.createDataFrame([(1, 1, "x"), (1, 2, None), (9, 1, "y"), (None, 1, "z")], "id int, turn int, title string")
    assert sorted((r.id, r.title) for r in store.update_tasks(now, changes, order_by="turn").collect()) == [(1, None), (2, None), (3, "c")]
    assert store.delete_all(now).count() == 0 and store.delete_all(now).columns == now.columns
    assert sorted(r.notification_id for r in store.assign_slots(now, 0x7FFFFFFE).collect()) == [1, 2, 0x7FFFFFFF]
    assert entities.read_settings(spark.createDataFrame([("theme", "7"), ("all_day_minute", "x")], "key string, value string")).first() == ("system", True, 540, True, False)


def test_words_and_tokens(spark):
    row = spark.range(1).select(numerals.wer_tokens(F.lit("Call at 3 p.m., three PM; at 3:00.")).alias("t"), text.word_before(F.lit("buy the 3rd, edition"), F.lit(12)).alias("b"), text.word_after(F.lit("buy the 3rd, edition"), F.lit(11)).alias("a")).first()
    assert row.t == ["call", "at", "3", "pm", "3", "pm", "at", "3"] and (row.b, row.a) == ("3rd", "edition")
