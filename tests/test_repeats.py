"""Values that repeat are worked on once, and every row gets its answer."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomtide.functions import when
from loomtide.operators import extract
from loomtide.plans.registry import QUERIES

NOW = dt.datetime(2026, 9, 23, 15, 0)
NOTE_QUERIES = "carried_days extraction_round_trip note_drafts note_tasks topic_notes note_clauses clause_kinds normal_notes corrected_notes guarded_notes when_phrases when_spans".split()


def test_every_row_gets_its_value(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.concat(F.lit("n"), (F.col("id") % 30).cast("string"))).alias("note"))
    out = when.once_each(rows.repartition(16), ["note"], n=F.coalesce(F.length("note"), F.lit(0)))
    assert out.columns == ["id", "note", "n"]
    assert sorted((r.id, r.n) for r in out.collect()) == [(k, len(f"n{k % 30}") if k % 3 else 0) for k in range(3000)]


def test_repeated_notes_of_several_days(spark):
    days = F.make_dt_interval(days=(F.col("id") % 5).cast("int"), secs=(F.col("id") % 50).cast("decimal(18,6)"))
    rows = spark.range(2000).select("id", (F.lit(NOW).cast("timestamp_ntz") + days).alias("now"), F.when(F.col("id") % 4 > 0, "Call Anna tomorrow, also buy milk").alias("note"))
    got = sorted((r.id, r.title, r.date) for r in extract.extract_tasks(rows).collect())
    tomorrow = lambda k: NOW.date() + dt.timedelta(k % 5 + 1)
    assert got == sorted(x for k in range(2000) if k % 4 for x in ((k, "Call Anna", tomorrow(k)), (k, "Buy milk", None)))


def _nodes(plan: str) -> list[str]:
    return [line.lstrip(" :+-") for line in plan.splitlines()]


@pytest.mark.parametrize("name", NOTE_QUERIES)
def test_notes_are_read_by_value(spark, name):
    nodes = _nodes(QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().analyzed().toString())
    assert any(n.startswith("Join LeftOuter") for n in nodes) and any(n.startswith(("Deduplicate", "Distinct", "Aggregate")) for n in nodes)
