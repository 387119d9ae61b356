"""Rows, entities and labels of the task store: what the app shows of a row, and the rows it writes."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import civil
from ..functions.text import fold_for_search, normalise_title

# Settings and what they are without a row, and states that unlock everything.
SETTING_DEFAULTS = {"theme": '"system"', "reminders_enabled": "true", "all_day_minute": "540", "haptics": "true", "onboarded": "false"}
PRO_STATES = ("proActive", "proGrace")
WEEKDAY_NAMES = "EEEE"


def to_entity(tasks: DataFrame) -> DataFrame:
    """Rows with nested ``due`` (null without a date; a minute outside the day is none) and ``reminder``."""
    minute = F.when(F.col("due_minute_of_day").between(0, 1439), F.col("due_minute_of_day"))
    due = F.when(F.col("due_date").isNotNull(), F.struct(F.col("due_date").alias("date"), minute.alias("minute")))
    reminder = F.struct(F.col("reminder_enabled").alias("enabled"), F.col("reminder_lead_minutes").alias("lead_minutes"), F.col("reminder_at_local").alias("at"), F.col("notification_id").alias("slot"))
    flat = [c for c in tasks.columns if c not in ("due_date", "due_minute_of_day", "reminder_enabled", "reminder_lead_minutes", "reminder_at_local", "notification_id", "title_folded")]
    return tasks.select(*flat, due.alias("due"), reminder.alias("reminder"))


def to_row(entities: DataFrame) -> DataFrame:
    """Entities as rows again; the folded title is made anew on every write, so that searching reads one column."""
    flat = [c for c in entities.columns if c not in ("due", "reminder")]
    return entities.select(
        *flat, F.col("due.date").alias("due_date"), F.col("due.minute").alias("due_minute_of_day"), F.col("reminder.enabled").alias("reminder_enabled"), F.col("reminder.lead_minutes").alias("reminder_lead_minutes"),
        F.col("reminder.at").alias("reminder_at_local"), F.col("reminder.slot").alias("notification_id"), fold_for_search(F.col("title")).alias("title_folded"),
    )


def drafts_to_tasks(drafts: DataFrame, now: Column, all_day_minute: int = 540) -> DataFrame:
    """Drafts (title, date, minute, has_reminder) as task columns.

    A reminder needs both the wish and a date; its lead is 0.  Titles are normalised, and a minute without a date is none.
    """
    wants = F.coalesce(F.col("has_reminder"), F.lit(False)) & F.col("date").isNotNull()
    minute = F.when(F.col("date").isNotNull(), F.col("minute"))
    title = normalise_title(F.col("title"))
    keep = [c for c in drafts.columns if c not in ("title", "date", "minute", "has_reminder")]
    return drafts.select(
        *keep, title.alias("title"), fold_for_search(title).alias("title_folded"), F.col("date").alias("due_date"), minute.alias("due_minute_of_day"), wants.alias("reminder_enabled"), F.lit(0).alias("reminder_lead_minutes"),
        F.when(wants, civil.reminder_at(F.col("date"), minute, all_day_minute, F.lit(0), now)).alias("reminder_at_local"),
    )


def flags(today: Column) -> dict[str, Column]:
    """Boolean columns of a row: overdue, due on the day, all-day, dated, schedulable."""
    due, minute = F.col("due_date"), F.col("due_minute_of_day")
    return {
        "is_overdue": ~F.col("completed") & F.coalesce(due < today, F.lit(False)), "is_due_on": F.coalesce(due == today, F.lit(False)), "is_all_day": due.isNotNull() & minute.isNull(), "has_date": due.isNotNull(),
        "is_schedulable": ~F.col("completed") & F.col("reminder_enabled") & F.col("reminder_at_local").isNotNull(),
    }


def day_label(day: Column, today: Column) -> Column:
    """Today, Tomorrow, Yesterday; the weekday of the next days up to the sixth; else month and day, with the year where it is another."""
    ahead = F.datediff(day, today)
    date = F.date_format(day, "MMM d")
    return (
        F.when(ahead == 0, "Today").when(ahead == 1, "Tomorrow").when(ahead == -1, "Yesterday").when(ahead.between(2, 6), F.date_format(day, WEEKDAY_NAMES))
        .when(F.year(day) == F.year(today), date).when(day.isNotNull(), F.concat(date, F.lit(", "), F.year(day).cast("string")))
    )


def clock_label(minute: Column) -> Column:
    """3:05 PM."""
    hour = F.floor(minute / 60).cast("int")
    return F.concat(((hour + 11) % 12 + 1).cast("string"), F.format_string(":%02d ", (minute % 60).cast("int")), F.when(hour < 12, "AM").otherwise("PM"))


def task_meta(day: Column, minute: Column, today: Column) -> Column:
    """The day and the clock of a task, as far as it has them."""
    return F.concat_ws(", ", day_label(day, today), F.when(day.isNotNull() & minute.isNotNull(), clock_label(minute)))


def tile_time(day: Column, minute: Column, today: Column) -> Column:
    """What stands beside a task in a group: its clock, or its day where it is late."""
    return F.when(day < today, task_meta(day, minute, today)).when(minute.isNotNull(), clock_label(minute)).otherwise("")


def group_header(label: Column, first_date: Column, today: Column) -> Column:
    """The title of a group of ``groups.group_headers``: Today, Tomorrow, a weekday, Next week, Later."""
    return (
        F.when(label == "today", "Today").when(label == "tomorrow", "Tomorrow").when(label == "weekday", F.date_format(first_date, WEEKDAY_NAMES)).when(label == "nextWeek", "Next week").when(label == "later", "Later")
    )


def greeting(minute: Column) -> Column:
    """Before noon, before 18:00, later."""
    return F.when(minute < 720, "Good morning").when(minute < 1080, "Good afternoon").otherwise("Good evening")


def read_settings(settings: DataFrame) -> DataFrame:
    """One row of typed settings; a missing key, bad JSON, a wrong type or a value out of range gives the default."""
    found = settings.where(F.col("key").isin(list(SETTING_DEFAULTS))).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("m"))
    raw = lambda key: F.try_element_at("m", F.lit(key))
    flag = lambda key: F.coalesce(F.when(raw(key) == "true", True).when(raw(key) == "false", False), F.lit(SETTING_DEFAULTS[key] == "true")).alias(key)
    text = F.regexp_extract(raw("theme"), r'^"(system|light|dark)"$', 1)
    minute = F.when(raw("all_day_minute").rlike(r"^\d{1,4}$"), raw("all_day_minute").try_cast("int"))
    return found.select(F.coalesce(F.nullif(text, F.lit("")), F.lit("system")).alias("theme"), flag("reminders_enabled"), F.coalesce(F.when(minute.between(0, 1439), minute), F.lit(540)).alias("all_day_minute"), flag("haptics"), flag("onboarded"))


def is_pro(state: Column) -> Column:
    """Active or in its grace period."""
    return F.coalesce(state.isin(*PRO_STATES), F.lit(False))


def find_task(tasks: DataFrame, task_id) -> DataFrame:
    """The row of an id, or none (S3)."""
    return tasks.where(F.col("id") == F.lit(task_id))


def follow_task(changes: DataFrame, task_id) -> DataFrame:
    """What a stream of changes (``streaming.views.CHANGE``) makes of one task: its new state after each change, null once it is gone."""
    return changes.where(F.col("id") == F.lit(str(task_id))).select("id", "new")


def usage_day(usage: DataFrame, day: dt.date) -> DataFrame:
    """The usage row of a day; zeros where there is none."""
    one = usage.where(F.col("day") == F.lit(day)).agg(F.coalesce(F.sum("capture_count"), F.lit(0)).cast("long").alias("capture_count"), F.coalesce(F.sum("task_count"), F.lit(0)).cast("long").alias("task_count"))
    return one.select(F.lit(day).alias("day"), "capture_count", "task_count")


def group_by_date(tasks: DataFrame) -> DataFrame:
    """Members of each due day in list order, as positions in the group; undated tasks have no group.

    A day may hold any number of tasks, so members stay rows.  The place of a row is the number of its day's rows with an earlier minute or spoken
    place, from counts by (day, minute, spoken place), and its place among those that share all three; so no task numbers a whole day.
    """
    dated = tasks.where(F.col("due_date").isNotNull()).withColumn("__minute", F.coalesce("due_minute_of_day", F.lit(-1)))
    keys = ["due_date", "__minute", "sort_order"]
    sizes = dated.groupBy(*keys).agg(F.count("*").alias("__n"))
    before = sizes.withColumn("__before", F.sum("__n").over(Window.partitionBy("due_date").orderBy("__minute", "sort_order")) - F.col("__n")).drop("__n")
    within = F.row_number().over(Window.partitionBy(*keys).orderBy("id"))
    return dated.join(before, keys).withColumn("place", (F.col("__before") + within).cast("int")).select(*tasks.columns, "place")


def unique_captures(tasks: DataFrame) -> DataFrame:
    """Tasks of one capture without repeats of title, date and minute; an undated task gives way to a dated one of its title."""
    key = F.lower("title")
    same = Window.partitionBy("capture_id", key, "due_date", "due_minute_of_day").orderBy("sort_order", "id")
    dated = Window.partitionBy("capture_id", key)
    marked = tasks.withColumns({"copy": F.row_number().over(same), "any_date": F.max(F.col("due_date").isNotNull()).over(dated)})
    return marked.where((F.col("copy") == 1) & (F.col("due_date").isNotNull() | ~F.col("any_date"))).drop("copy", "any_date")


def capture_batch(drafts: DataFrame, capture_key: Column) -> DataFrame:
    """Drafts of one note share a capture id made of its key; ``sort_order`` is their place in the note."""
    return drafts.withColumns({"capture_id": F.sha2(capture_key.cast("string"), 256), "sort_order": (F.col("position") - 1).cast("int")})
