"""Scores of extracted tasks against labelled ones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import content_words, set_similarity, word_edits
from ..functions.when import _once, let


def score_notes(notes: DataFrame, threshold: float = 0.5) -> DataFrame:
    """One row per note with ``expected`` and ``actual`` arrays of (title, date, time) strings.

    Expected tasks take, in their order, the best actual task not yet taken
    (the first of equals) with a similarity of at least ``threshold``; "*" fits any date or time.
    """
    # The words of a title are found once, and a task that is taken leaves the ones to compare with.
    left = "array<struct<o: int, words: array<string>>>"
    blank = F.struct(*(F.lit(0).alias(x) for x in ("matched", "dates_checked", "dates_right", "times_checked", "times_right")), F.col("__got").cast(left).alias("left"))

    def step(acc: Column, want: Column) -> Column:
        ranked = F.transform(acc["left"], lambda got: F.struct(set_similarity(want["words"], got["words"]).alias("s"), got["o"].alias("o")))
        return let(F.array_max(ranked), lambda best: taken(acc, want, best))

    def taken(acc: Column, want: Column, best: Column) -> Column:
        at = -best["o"]
        ok = F.coalesce((best["s"] >= threshold) & (best["s"] > 0), F.lit(False))
        got = F.get(F.col("actual"), F.when(ok, at).otherwise(0))
        date, time = ok & ~want["task"]["date"].eqNullSafe(F.lit("*")), ok & ~want["task"]["time"].eqNullSafe(F.lit("*"))
        add = lambda name, flag: (acc[name] + flag.cast("int")).alias(name)
        return F.struct(
            add("matched", ok), add("dates_checked", date), add("dates_right", date & want["task"]["date"].eqNullSafe(got["date"])), add("times_checked", time), add("times_right", time & want["task"]["time"].eqNullSafe(got["time"])),
            F.when(ok, F.filter(acc["left"], lambda x: x["o"] != best["o"])).otherwise(acc["left"]).alias("left"),
        )

    read = _once(
        notes, __want=F.transform("expected", lambda t: F.struct(t.alias("task"), content_words(t["title"]).alias("words"))),
        __got=F.transform("actual", lambda t, i: F.struct((-i).alias("o"), content_words(t["title"]).alias("words"))),
    )
    scored = _once(read, x=F.aggregate("__want", blank, step, lambda acc: acc.dropFields("left")))
    sizes = [F.size("expected").alias("n_expected"), F.size("actual").alias("n_actual")]
    exact = (F.col("x.matched") == F.size("expected")) & (F.size("actual") == F.size("expected")) & (F.col("x.dates_right") == F.col("x.dates_checked")) & (F.col("x.times_right") == F.col("x.times_checked"))
    return scored.select(*(c for c in notes.columns if c not in ("expected", "actual")), *sizes, "x.matched", "x.dates_checked", "x.dates_right", "x.times_checked", "x.times_right", exact.alias("exact"))


def scorecard(scored: DataFrame, *keys: str) -> DataFrame:
    """Recall, precision, date and time accuracy and exact rate; an empty denominator gives 1."""
    rate = lambda a, b: F.when(F.sum(b) == 0, 1.0).otherwise(F.sum(a) / F.sum(b))
    return scored.groupBy(*keys).agg(
        F.count("*").alias("notes"), rate("matched", "n_expected").alias("recall"), rate("matched", "n_actual").alias("precision"),
        rate("dates_right", "dates_checked").alias("date_accuracy"), rate("times_right", "times_checked").alias("time_accuracy"), F.avg(F.col("exact").cast("int")).alias("exact_rate"),
    )


def error_summary(clips: DataFrame, *keys: str) -> DataFrame:
    """Word errors of transcripts by ``keys`` and over all (null keys), from ``reference`` and ``heard`` arrays of words.

    ``mean_wer`` averages clips (an empty reference counts 0 or 1), ``pooled_wer`` is all edits by all words,
    ``lost`` and ``gained`` count clips with fewer and with more words than were said.
    """
    n, m = F.size("reference"), F.size("heard")
    edits = clips.select(*keys, n.alias("n"), m.alias("m"), word_edits(F.col("reference"), F.col("heard")).alias("edits"))
    rate = F.when(F.col("n") == 0, F.when(F.col("m") == 0, 0.0).otherwise(1.0)).otherwise(F.col("edits") / F.when(F.col("n") == 0, 1).otherwise(F.col("n")))
    return edits.rollup(*keys).agg(
        F.count("*").alias("clips"), F.avg(rate).alias("mean_wer"), (F.sum("edits") / F.when(F.sum("n") == 0, 1).otherwise(F.sum("n"))).alias("pooled_wer"),
        F.count_if(F.col("m") < F.col("n")).alias("lost"), F.count_if(F.col("m") > F.col("n")).alias("gained"),
    )
