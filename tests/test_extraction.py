"""Note extraction: edge rows, and floors on labelled corpora where their folder is named."""

import datetime as dt
import os
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from loomtide.operators import extract, scoring
from loomtide.sources.readers import read_corpus

NOW = dt.datetime(2026, 9, 23, 15, 0)
CORPORA = os.environ.get("LABELLED_NOTES", "")
#: Exact notes, at least, by corpus; the sets that rules may be tuned on.
FLOORS = {"extraction_dev_corpus": 0.95, "extraction_complex_dev_corpus": 0.95, "extraction_correct_input_guard": 0.9, "extraction_device_transcripts": 0.9}
OWN = Path(__file__).parent / "notes" / "spoken_notes.txt"


def own_notes():
    """(note, [(title, date, time)]) of each line of the labelled notes of this repository."""
    out = []
    for line in OWN.read_text().splitlines():
        if line and not line.startswith("#"):
            note, tasks = line.split("|")
            parts = [re.fullmatch(r"\s*(.*?) @ (\S+) (\S+)\s*", t).groups() for t in tasks.split(";") if t.strip()]
            out.append((note.strip(), [(t, None if d == "-" else d, None if c == "-" else c) for t, d, c in parts]))
    return out


def found(spark, *notes):
    table = spark.createDataFrame([(k, NOW, n) for k, n in enumerate(notes)], "id int, now timestamp_ntz, note string")
    return [tuple(r) for r in extract.extract_tasks(table).orderBy("id", "position").select("id", "title", "date", "minute").collect()]


def test_notes_without_tasks(spark):
    assert found(spark, None, "", "   ", "...", "Thank you.", "\0") == []


def test_repeated_rows_and_clashing_columns(spark):
    rows = [(1, NOW, "Buy milk tomorrow.", "a", 5)] * 2
    table = spark.createDataFrame(rows, "id int, now timestamp_ntz, note string, title string, position int")
    out = extract.extract_tasks(table)
    assert out.columns == ["id", "now", "note", *extract.RESULT]
    assert [(r.title, r.date, r.position) for r in out.collect()] == [("Buy milk", dt.date(2026, 9, 24), 1)] * 2
    assert extract.extract_tasks(table.limit(0)).count() == 0


def test_cap_counts_tasks(spark):
    note = "Hmm. " + " ".join(f"Um. Call customer {k}." for k in range(30))
    assert [t for _, t, _, _ in found(spark, note)] == [f"Call customer {k}" for k in range(20)]


def test_long_notes_keep_their_last_task(spark):
    talk = "The weather was nice and it was warm. " * 2800  # over 100,000 characters
    assert found(spark, f"{talk}Call the bank tomorrow at 4 pm.")[-1][1:] == ("Call the bank", dt.date(2026, 9, 24), 960)
    stuttered = "um " * 3000 + "call the bank tomorrow" + " and so on" * 200
    assert found(spark, stuttered)[0][1].startswith("Call the bank")
    assert found(spark, "at 4, no wait, " * 300 + "at 5 call Anna") == [(0, "Call Anna", dt.date(2026, 9, 23), 1020)]


def test_drafts_hold_whole_notes(spark):
    rows = [(k, NOW, "Thank you." if k % 3 == 0 else "Buy milk" if k % 3 == 1 else None) for k in range(3000)]
    many = extract.drafts(spark.createDataFrame(rows, "id int, now timestamp_ntz, note string").repartition(16)).groupBy("id").count()
    assert sorted((r.id, r["count"]) for r in many.collect()) == [(k, 1) for k in range(3000) if k % 3 < 2]
    table = spark.createDataFrame([(1, NOW, "Thank you."), (2, NOW, "Buy milk"), (3, NOW, None)], "id int, now timestamp_ntz, note string")
    assert sorted((r.id, r.title, r.low_confidence_date) for r in extract.drafts(table).collect()) == [(1, "Thank you.", False), (2, "Buy milk", False)]


def exact_rate(notes):
    """Share of notes (corpus, number, now, note, expected) whose tasks are all as labelled."""
    clock = F.when(F.col("minute").isNotNull(), F.format_string("%02d:%02d", F.floor(F.col("minute") / 60).cast("int"), F.col("minute") % 60))
    got = extract.extract_tasks(notes).groupBy("number").agg(F.array_sort(F.collect_list(F.struct("position", "title", F.col("date").cast("string").alias("date"), clock.alias("time")))).alias("a"))
    pick = lambda c: F.transform(c, lambda x: F.struct(x["title"].alias("title"), x["date"].alias("date"), x["time"].alias("time")))
    both = notes.join(got, "number", "left").select("corpus", "number", "note", pick("expected").alias("expected"), pick(F.coalesce("a", F.array())).alias("actual"))
    scored = scoring.score_notes(both)
    print([r.note for r in scored.where("not exact").collect()])
    return scoring.scorecard(scored, "corpus").first().exact_rate


def test_notes_of_our_own(spark):
    rows = [("own", k, NOW, note, tasks) for k, (note, tasks) in enumerate(own_notes())]
    assert len(rows) >= 60
    notes = spark.createDataFrame(rows, "corpus string, number int, now timestamp_ntz, note string, expected array<struct<title: string, date: string, time: string>>")
    assert exact_rate(notes.repartition(8)) >= 0.9


@pytest.mark.skipif(not CORPORA, reason="LABELLED_NOTES names no folder of labelled notes")
@pytest.mark.parametrize("corpus", FLOORS)
def test_floors(spark, corpus):
    notes = read_corpus(spark, Path(CORPORA, f"{corpus}.json").as_uri()).repartition(8)
    assert exact_rate(notes) >= FLOORS[corpus]
