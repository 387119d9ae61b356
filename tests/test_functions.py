import datetime as dt

from pyspark.sql import functions as F

from loomtide.functions import civil, text
from loomtide.operators import extract, reminders


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_text(spark):
    assert one(spark, text.fold_for_search(F.lit("  Crème   BRÛLÉE_100% Straße æ "))) == ("creme brulee100 strasse ae",)
    assert one(spark, F.length(text.normalise_title(F.lit("😀" * 150)))) == (100,)
    assert one(spark, text.strip_non_speech(F.lit("a [music] b (x) c"))) == ("a b c",)
    words = lambda s: F.array(*(F.lit(w) for w in s.split()))
    assert one(spark, text.word_edits(words("a b c d"), words("a x c"))) == (2,)
    assert one(spark, text.title_similarity(F.lit("the"), F.lit("my"))) == (1.0,)


def test_civil(spark):
    day = F.lit(dt.date(2026, 1, 31))
    assert one(spark, civil.parse_date(F.lit("2026-9-1")), civil.parse_date(F.lit("2026-02-28"))) == (None, dt.date(2026, 2, 28))
    assert one(spark, civil.yearless_date(day, F.lit(2), F.lit(29))) == (dt.date(2028, 2, 29),)
    assert one(spark, civil.parse_minute(F.lit("24:00")), civil.parse_minute(F.lit("23:59"))) == (None, 1439)


def test_extraction(spark):
    rows = [(1, dt.datetime(2026, 9, 21, 10, 0), "Call Anna tomorrow at 3 pm and then buy milk on Friday."), (2, dt.datetime(2026, 9, 21, 10, 0), ""), (3, dt.datetime(2026, 9, 21, 10, 0), None)]
    notes = spark.createDataFrame(rows, "id int, now timestamp_ntz, note string")
    found = [tuple(r) for r in extract.extract_tasks(notes).select("id", "title", "date", "minute").orderBy("id", "position").collect()]
    assert found == [(1, "Call Anna", dt.date(2026, 9, 22), 900), (1, "Buy milk", dt.date(2026, 9, 25), None)]


def test_kill_switch(spark):
    tasks = spark.createDataFrame([("a", dt.datetime(2030, 1, 1), 1, True, False)], "id string, reminder_at_local timestamp_ntz, notification_id int, reminder_enabled boolean, completed boolean")
    held = spark.createDataFrame([(1,), (9,)], "notification_id int")
    plan = lambda **k: sorted(tuple(r)[:2] for r in reminders.reminder_plan(tasks, held, dt.datetime(2029, 1, 1), **k).collect())
    assert plan() == [("cancel", 9), ("schedule", 1)]
    assert plan(enabled=False) == [("cancel", 1), ("cancel", 9)]
