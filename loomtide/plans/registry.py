"""Queries over the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import civil, numerals, text
from ..operators import entities, extract, groups, reminders, scoring, store
from ..streaming import views
from . import language, spoken
from .views import BY_DAY_SQL, EVENTS_TODAY, LABEL_SQL, NOW, ORDER_SQL, TASKS_SQL, TODAY, completions, table, tasks, usage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


_SHOWN = ["id", "due_date", "due_minute_of_day", "sort_order"]
_SHOWN_SQL = ", ".join(_SHOWN)


@register(f"WITH {TASKS_SQL} SELECT {LABEL_SQL} AS label, min(due_date) AS first_date, count(*) AS n_tasks FROM (SELECT * FROM tasks_v WHERE NOT completed AND due_date > DATE '1998-08-02' ORDER BY {ORDER_SQL} LIMIT 500) GROUP BY 1, CASE WHEN {LABEL_SQL} IN ('today', 'nextWeek', 'later') THEN NULL ELSE due_date END")
def upcoming_headers(spark, sf_dir):
    return groups.group_headers(store.upcoming_tasks(tasks(spark, sf_dir), TODAY), TODAY)


@register(f"WITH {TASKS_SQL} SELECT {_SHOWN_SQL} FROM tasks_v WHERE NOT completed AND (due_date IS NULL OR due_date <= DATE '1998-08-02')")
def today_list(spark, sf_dir):
    return store.today_tasks(tasks(spark, sf_dir), TODAY).select(*_SHOWN)


@register(f"WITH {TASKS_SQL} SELECT {_SHOWN_SQL} FROM tasks_v WHERE NOT completed AND due_date > DATE '1998-08-02' ORDER BY {ORDER_SQL} LIMIT 500")
def upcoming_list(spark, sf_dir):
    return store.upcoming_tasks(tasks(spark, sf_dir), TODAY).select(*_SHOWN)


@register(f"WITH {TASKS_SQL} SELECT id, sort_order FROM tasks_v WHERE NOT completed AND due_date IS NULL ORDER BY sort_order, created_at DESC, id LIMIT 500")
def someday_list(spark, sf_dir):
    return store.someday_tasks(tasks(spark, sf_dir)).select("id", "sort_order")


@register(f"WITH {TASKS_SQL} SELECT id FROM tasks_v WHERE completed ORDER BY completed_at DESC NULLS LAST, id LIMIT 200")
def completed_list(spark, sf_dir):
    return store.completed_tasks(tasks(spark, sf_dir)).select("id")


@register(f"WITH {TASKS_SQL} SELECT id, title FROM tasks_v WHERE contains(title_folded, 'order 1-urgent') ORDER BY completed, {ORDER_SQL} LIMIT 100")
def search_list(spark, sf_dir):
    return store.search_tasks(tasks(spark, sf_dir), "  ÖRDÉR   1-Urgent%").select("id", "title")


@register(f"WITH {TASKS_SQL} SELECT id, reminder_at_local FROM tasks_v WHERE NOT completed AND reminder_enabled AND reminder_at_local >= TIMESTAMP '1998-08-02 10:07:00' ORDER BY reminder_at_local, id LIMIT 64")
def due_reminder_list(spark, sf_dir):
    return store.due_reminders(tasks(spark, sf_dir), NOW).select("id", "reminder_at_local")


@register(f"WITH {TASKS_SQL} SELECT id FROM tasks_v WHERE NOT completed AND reminder_enabled AND reminder_at_local >= TIMESTAMP '1998-08-02 10:07:00'")
def schedulable_list(spark, sf_dir):
    return store.schedulable(tasks(spark, sf_dir), NOW).select("id")


@register(f"WITH {TASKS_SQL} SELECT count(*) FILTER (NOT completed) AS open_count, count(*) FILTER (completed) AS completed_count FROM tasks_v")
def task_totals(spark, sf_dir):
    return store.totals(tasks(spark, sf_dir))


@register(f"WITH {TASKS_SQL} SELECT id, completed_at FROM tasks_v WHERE completed AND completed_at >= TIMESTAMP '1997-06-28 00:00:00' ORDER BY completed_at DESC, id LIMIT 2000")
def recent_completion_list(spark, sf_dir):
    return store.recent_completions(tasks(spark, sf_dir), dt.datetime(1997, 6, 28)).select("id", F.col("completed_at").cast("timestamp_ntz").alias("completed_at"))


@register(f"WITH {TASKS_SQL} SELECT count(*) AS n, CAST(coalesce(sum(epoch_ms(updated_at)), 0) AS BIGINT) AS updated_sum FROM tasks_v")
def change_mark(spark, sf_dir):
    return store.change_ticker(tasks(spark, sf_dir))


@register("SELECT CAST(coalesce(sum(1), 0) AS BIGINT) AS used, greatest(0, 100000 - CAST(coalesce(sum(1), 0) AS BIGINT)) AS remaining, coalesce(sum(1), 0) < 100000 AS allowed FROM events WHERE CAST(ts AS DATE) = DATE '2024-01-30'")
def quota_check(spark, sf_dir):
    return store.quota(usage(spark, sf_dir), EVENTS_TODAY, is_pro=False, limit=100_000)


@register("SELECT CAST(ts AS DATE) AS day, count(*) AS capture_count, CAST(sum(event_id % 3) AS BIGINT) AS task_count FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-20' GROUP BY day")
def usage_days(spark, sf_dir):
    deltas = usage(spark, sf_dir)
    return store.prune_usage(store.add_usage(deltas.limit(0), deltas), dt.date(2024, 4, 19))


@register(f"WITH {BY_DAY_SQL} SELECT owner, day, n_done FROM by_day")
def completion_days(spark, sf_dir):
    return groups.completions_by_day(completions(spark, sf_dir))


@register(f"WITH {BY_DAY_SQL}, w AS (SELECT owner, CAST(d AS DATE) AS day FROM (SELECT DISTINCT owner FROM by_day), (SELECT unnest(generate_series(DATE '2024-01-24', DATE '2024-01-30', INTERVAL 1 DAY)) AS d)) SELECT owner, day, coalesce(n_done, 0) AS n_done FROM w LEFT JOIN by_day USING (owner, day)")
def completion_histogram(spark, sf_dir):
    return groups.week_histogram(groups.completions_by_day(completions(spark, sf_dir)), EVENTS_TODAY)


@register(f"""WITH {BY_DAY_SQL}, i AS (SELECT owner, day, day - CAST(row_number() OVER (PARTITION BY owner ORDER BY day) AS INTEGER) AS island FROM by_day WHERE day <= DATE '2024-01-30'),
    r AS (SELECT owner, count(*) AS n, max(day) AS last FROM i GROUP BY owner, island), s AS (SELECT owner, max(n) AS n FROM r WHERE last >= DATE '2024-01-29' GROUP BY owner),
    w AS (SELECT owner, sum(n_done) FILTER (day BETWEEN DATE '2024-01-24' AND DATE '2024-01-30') AS d FROM by_day GROUP BY owner)
    SELECT owner, CAST(coalesce(d, 0) AS BIGINT) AS done_last_7, CAST(least(coalesce(n, 0), 400) AS INTEGER) AS streak_days FROM w LEFT JOIN s USING (owner)""")
def completion_stats(spark, sf_dir):
    return groups.owner_stats(groups.completions_by_day(completions(spark, sf_dir)), EVENTS_TODAY)


@register(f"""WITH {TASKS_SQL}, fit AS (SELECT * FROM tasks_v WHERE reminder_at_local IS NOT NULL AND reminder_enabled AND NOT completed),
    wanted AS (SELECT * FROM fit WHERE reminder_at_local > TIMESTAMP '1998-08-02 10:07:00' ORDER BY reminder_at_local, id LIMIT 60),
    safe AS (SELECT notification_id FROM wanted UNION ALL SELECT notification_id FROM fit WHERE reminder_at_local <= TIMESTAMP '1998-08-02 10:07:00' AND reminder_at_local > TIMESTAMP '1998-08-02 09:07:00')
    SELECT 'schedule' AS action, notification_id, CAST(id AS VARCHAR) AS id, reminder_at_local AS at FROM wanted
    UNION ALL SELECT 'cancel', notification_id, NULL, NULL FROM tasks_v WHERE id % 5 = 0 AND notification_id NOT IN (SELECT notification_id FROM safe)""")
def reminder_sweep(spark, sf_dir):
    all_tasks = tasks(spark, sf_dir)
    return reminders.reminder_plan(all_tasks, all_tasks.where("id % 5 = 0").select("notification_id"), NOW)


@register(f"""WITH {TASKS_SQL}, b AS (SELECT id, due_date, due_minute_of_day AS m, CAST(due_date AS TIMESTAMP) + to_minutes(coalesce(due_minute_of_day, 540) - 15) AS r FROM tasks_v WHERE due_date IS NOT NULL)
    SELECT id, CASE WHEN m IS NULL AND due_date = DATE '1998-08-02' AND r <= TIMESTAMP '1998-08-02 10:07:00' THEN TIMESTAMP '1998-08-02 10:15:00' ELSE r END AS remind_at FROM b""")
def reminder_times(spark, sf_dir):
    due = tasks(spark, sf_dir).where("due_date IS NOT NULL")
    return due.select("id", civil.reminder_at(F.col("due_date"), F.col("due_minute_of_day"), 540, F.lit(15), F.lit(NOW).cast("timestamp_ntz")).alias("remind_at"))


@register("""SELECT o_orderkey AS id, CAST(d + CAST(CASE WHEN (2 - isodow(d) + 7) % 7 = 0 THEN 7 ELSE (2 - isodow(d) + 7) % 7 END AS INTEGER) AS DATE) AS next_tuesday, CAST(date_trunc('week', d) + INTERVAL 9 DAY AS DATE) AS wednesday_next_week,
    CAST(d - CAST(CASE WHEN (isodow(d) - 5 + 7) % 7 = 0 THEN 7 ELSE (isodow(d) - 5 + 7) % 7 END AS INTEGER) AS DATE) AS last_friday,
    CAST((SELECT min(x) FROM (SELECT make_date(y, m, 31) AS x FROM (SELECT year(d + to_months(k)) AS y, month(d + to_months(k)) AS m FROM (SELECT unnest([0, 1, 2, 3]) AS k)) WHERE m IN (1, 3, 5, 7, 8, 10, 12)) WHERE x >= d) AS DATE) AS next_31st
    FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)""")
def civil_dates(spark, sf_dir):
    d = F.to_date("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), civil.forward_weekday(d, F.lit(2)).alias("next_tuesday"), civil.next_week_weekday(d, F.lit(3)).alias("wednesday_next_week"),
        civil.last_weekday(d, F.lit(5)).alias("last_friday"), civil.day_of_month_on_or_after(d, F.lit(31)).alias("next_31st"),
    )


@register("SELECT p_partkey AS id, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) AS folded, trim(regexp_replace(p_name, '\\s+', ' ', 'g')) AS title FROM part")
def folded_titles(spark, sf_dir):
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), text.fold_for_search(F.col("p_name")).alias("folded"), text.normalise_title(F.col("p_name")).alias("title"))


_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_WORDS = f"list_distinct(list_transform(list_filter(list_transform(regexp_extract_all(lower({{}}), '[a-z0-9'']+'), lambda w: replace(replace(w, '''s', ''), '''', '')), lambda w: w <> '' AND w NOT IN ({_STOP})), lambda w: w[1:4]))"


@register(f"""WITH p AS (SELECT a.conv_id, a.turn, {_WORDS.format('a.text')} AS x, {_WORDS.format('b.text')} AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)
    SELECT conv_id, turn, CASE WHEN len(x) + len(y) = 0 THEN 1.0 ELSE round(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))), 9) END AS similarity FROM p""")
def turn_similarity(spark, sf_dir):
    # Each turn's words are found once, and each turn meets the next by one window over its conversation.
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.explode(F.array(text.content_words(F.col("text")))).alias("words"))
    order = Window.partitionBy("conv_id").orderBy("turn")
    paired = turns.withColumns({"reply": F.lead("words").over(order), "at": F.lead("turn").over(order)}).where(F.col("at") == F.col("turn") + 1)
    return paired.select("conv_id", "turn", F.round(text.set_similarity(F.col("words"), F.col("reply")), 9).alias("similarity"))


@register(f"""WITH n AS (SELECT o_orderkey AS id, o_orderkey % 900 + 1 AS customer, CAST(o_orderdate AS DATE) AS d, CAST(8 + o_orderkey % 12 AS INTEGER) AS h FROM orders)
    SELECT id, 'Call customer ' || customer AS title, CAST(CASE WHEN id % 4 = 0 THEN DATE '1998-08-03' WHEN id % 4 = 1 THEN DATE '1998-08-07' WHEN id % 4 = 2 THEN DATE '1998-08-05' WHEN d >= DATE '1998-08-02' THEN d WHEN h * 60 < {NOW.hour * 60 + NOW.minute} THEN DATE '1998-08-03' ELSE DATE '1998-08-02' END AS DATE) AS date, h * 60 AS minute FROM n""")
def extraction_round_trip(spark, sf_dir):
    """Notes built by templates, extracted again; of a day that is gone only the clock counts, the next time it comes round."""
    k, d = F.col("o_orderkey"), F.to_date("o_orderdate")
    h = (k % 12 + 8).cast("int")
    clock = F.concat(((h + 11) % 12 + 1).cast("string"), F.when(h < 12, " am").otherwise(" pm"))
    day = F.when(k % 4 == 0, "tomorrow").when(k % 4 == 1, "on Friday").when(k % 4 == 2, "in 3 days").otherwise(F.concat(F.lit("on "), F.date_format(d, "MMMM d, yyyy")))
    notes = table(spark, sf_dir, "orders").select(k.alias("id"), F.lit(NOW).cast("timestamp_ntz").alias("now"), F.concat(F.lit("I need to call customer "), (k % 900 + 1).cast("string"), F.lit(" "), day, F.lit(" at "), clock, F.lit(".")).alias("note"))
    return extract.extract_tasks(notes).select("id", "title", "date", "minute")


@register("""WITH n AS (SELECT conv_id, count(*) AS n, count(*) FILTER (turn % 2 = 0) AS hit FROM conversations GROUP BY conv_id)
    SELECT count(*) AS notes, 1.0 AS recall, round(CAST(sum(n) AS DOUBLE) / sum(n), 9) AS precision, round(CAST(sum(hit) AS DOUBLE) / sum(n), 9) AS date_accuracy, 1.0 AS time_accuracy, round(avg(CASE WHEN hit = n THEN 1.0 ELSE 0.0 END), 9) AS exact_rate FROM n""")
def label_scorecard(spark, sf_dir):
    """Turns scored against themselves under unique titles, with the dates of odd turns spoilt."""
    title = F.concat(F.lit("w"), F.lpad(F.col("turn").cast("string"), 3, "0"))
    task = lambda date: F.struct(F.col("turn"), title.alias("title"), date.alias("date"), F.lit(None).cast("string").alias("time"))
    pick = lambda c: F.transform(F.array_sort(F.collect_list(c)), lambda t: F.struct(t["title"].alias("title"), t["date"].alias("date"), t["time"].alias("time")))
    notes = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(pick(task(F.lit("2024-01-01"))).alias("expected"), pick(task(F.when(F.col("turn") % 2 == 0, "2024-01-01").otherwise("2024-01-02"))).alias("actual"))
    card = scoring.scorecard(scoring.score_notes(notes))
    return card.select("notes", *(F.round(c, 9).alias(c) for c in ("recall", "precision", "date_accuracy", "time_accuracy", "exact_rate")))


@register("""SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS p50, quantile_disc(l_quantity, 0.95) AS p95 FROM lineitem GROUP BY l_returnflag""")
def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles."""
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(*groups.nearest_rank("l_quantity", 0.5, 0.95))


@register(f"WITH {TASKS_SQL} SELECT id, CASE WHEN id % 10 = 0 THEN TRUE ELSE completed END AS completed, CASE WHEN id % 10 = 0 THEN NULL ELSE due_date END AS due_date FROM tasks_v WHERE id % 13 <> 0")
def snapshot_update(spark, sf_dir):
    """Keyed updates, two for a key and the last with a null, and a keyed delete of the snapshot."""
    all_tasks = tasks(spark, sf_dir).select("id", "completed", "due_date")
    hit = all_tasks.where("id % 10 = 0")
    first = hit.select("id", F.lit(1).alias("turn"), F.lit(False).alias("completed"), F.col("due_date"))
    last = hit.select("id", F.lit(2).alias("turn"), F.lit(True).alias("completed"), F.lit(None).cast("date").alias("due_date"))
    return store.delete_tasks(store.update_tasks(all_tasks, first.union(last), order_by="turn"), all_tasks.where("id % 13 = 0"))


@register("""WITH c AS (SELECT c_custkey AS owner, c_nationkey AS n, c_custkey % 3 AS k FROM customer)
    SELECT owner, 'next_notification_id' AS key, CAST(n + 7 AS VARCHAR) AS value FROM c UNION ALL SELECT owner, 'theme', CASE WHEN k = 0 THEN '"dark"' ELSE '"system"' END FROM c UNION ALL SELECT owner, 'limit', CASE WHEN k = 1 THEN '9' ELSE '3' END FROM c""")
def settings_reset(spark, sf_dir):
    """Every customer's settings are reset: the counter stays, old keys go, defaults are seeded; then some customers change one of them."""
    at = lambda day: F.lit(dt.datetime(2024, 1, day)).cast("timestamp")
    owners = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("owner"), F.col("c_nationkey").alias("n"))
    row = lambda key, value, day: F.struct(F.lit(key).alias("key"), value.alias("value"), at(day).alias("updated_at"))
    kept = lambda df, *rows: df.select("owner", F.explode(F.array(*rows)).alias("r")).select("owner", "r.*")
    now = kept(owners, row("next_notification_id", (F.col("n") + 7).cast("string"), 1), row("theme", F.lit('"light"'), 1), row("old", F.lit("1"), 1))
    defaults = kept(owners, row("next_notification_id", F.lit("1"), 2), row("theme", F.lit('"system"'), 2), row("limit", F.lit("3"), 2))
    dark = kept(owners.where("owner % 3 = 0"), row("theme", F.lit('"dark"'), 3))
    more = kept(owners.where("owner % 3 = 1"), row("limit", F.lit("9"), 3))
    reset = store.reset_settings(now, defaults, by=["owner"])
    return store.upsert_settings(reset, dark.union(more), by=["owner"]).select("owner", "key", "value")


@register("SELECT conv_id, CAST(turn AS INTEGER) AS sort_order, sha256(CAST(conv_id AS VARCHAR)) AS capture_id FROM conversations")
def capture_batches(spark, sf_dir):
    """Turns of one conversation as drafts of one capture."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", (F.col("turn") + 1).alias("position"))
    return entities.capture_batch(turns, F.col("conv_id")).select("conv_id", "sort_order", "capture_id")


_DUE_SQL = "CAST(due_date AS TIMESTAMP) + to_minutes(coalesce(due_minute_of_day, 540))"


@register(f"WITH {TASKS_SQL} SELECT id, title, title_folded, due_date, CASE WHEN due_date IS NOT NULL THEN due_minute_of_day END AS due_minute_of_day, reminder_enabled, 15 AS reminder_lead_minutes, reminder_at_local, notification_id FROM tasks_v")
def entity_round_trip(spark, sf_dir):
    """Rows to entities and back; the folded title is made anew."""
    rows = tasks(spark, sf_dir).withColumn("reminder_lead_minutes", F.lit(15))
    back = entities.to_row(entities.to_entity(rows))
    return back.select("id", "title", "title_folded", "due_date", "due_minute_of_day", "reminder_enabled", "reminder_lead_minutes", "reminder_at_local", "notification_id")


@register(f"""WITH {TASKS_SQL} SELECT id, title, due_date, CASE WHEN due_date IS NOT NULL THEN due_minute_of_day END AS due_minute_of_day, reminder_enabled AND due_date IS NOT NULL AS reminder_enabled,
    CASE WHEN reminder_enabled AND due_date IS NOT NULL THEN CASE WHEN due_minute_of_day IS NULL AND due_date = DATE '1998-08-02' AND {_DUE_SQL} <= TIMESTAMP '1998-08-02 10:07:00' THEN TIMESTAMP '1998-08-02 10:15:00' ELSE {_DUE_SQL} END END AS reminder_at_local FROM tasks_v""")
def draft_tasks(spark, sf_dir):
    """Drafts as tasks: a reminder needs the wish and a date."""
    drafts = tasks(spark, sf_dir).select("id", "title", F.col("due_date").alias("date"), F.col("due_minute_of_day").alias("minute"), F.col("reminder_enabled").alias("has_reminder"))
    return entities.drafts_to_tasks(drafts, F.lit(NOW).cast("timestamp_ntz")).select("id", "title", "due_date", "due_minute_of_day", "reminder_enabled", "reminder_at_local")


@register(f"""WITH {TASKS_SQL} SELECT id, NOT completed AND coalesce(due_date < DATE '1998-08-02', FALSE) AS is_overdue, coalesce(due_date = DATE '1998-08-02', FALSE) AS is_due_on, due_date IS NOT NULL AND due_minute_of_day IS NULL AS is_all_day,
    due_date IS NOT NULL AS has_date, NOT completed AND reminder_enabled AND reminder_at_local IS NOT NULL AS is_schedulable FROM tasks_v""")
def task_flags(spark, sf_dir):
    return tasks(spark, sf_dir).select("id", *(c.alias(n) for n, c in entities.flags(F.lit(TODAY)).items()))


_DAY_SQL = """CASE WHEN due_date = DATE '1998-08-02' THEN 'Today' WHEN due_date = DATE '1998-08-03' THEN 'Tomorrow' WHEN due_date = DATE '1998-08-01' THEN 'Yesterday' WHEN due_date BETWEEN DATE '1998-08-04' AND DATE '1998-08-08' THEN dayname(due_date)
    WHEN year(due_date) = 1998 THEN strftime(due_date, '%b %-d') ELSE strftime(due_date, '%b %-d, %Y') END"""


@register(f"""WITH {TASKS_SQL} SELECT id, {_DAY_SQL} AS day, {_DAY_SQL} || CASE WHEN due_minute_of_day IS NULL THEN '' ELSE ', ' || strftime(TIMESTAMP '2000-01-01' + to_minutes(due_minute_of_day), '%-I:%M %p') END AS meta,
    CASE WHEN due_minute_of_day < 720 THEN 'Good morning' WHEN due_minute_of_day < 1080 THEN 'Good afternoon' ELSE 'Good evening' END AS greeting FROM tasks_v WHERE due_date IS NOT NULL""")
def task_labels(spark, sf_dir):
    today, due, minute = F.lit(TODAY), F.col("due_date"), F.col("due_minute_of_day")
    return tasks(spark, sf_dir).where("due_date IS NOT NULL").select("id", entities.day_label(due, today).alias("day"), entities.task_meta(due, minute, today).alias("meta"), entities.greeting(minute).alias("greeting"))


_SETTING_ROWS = """s AS (SELECT CASE o_orderkey % 6 WHEN 0 THEN 'theme' WHEN 1 THEN 'reminders_enabled' WHEN 2 THEN 'all_day_minute' WHEN 3 THEN 'haptics' WHEN 4 THEN 'unknown' ELSE 'next_notification_id' END AS key,
    CASE o_orderkey % 5 WHEN 0 THEN '"dark"' WHEN 1 THEN 'false' WHEN 2 THEN '615' WHEN 3 THEN '9999' ELSE 'true' END AS value, o_orderdate AS moment FROM orders), w AS (SELECT key, last(value ORDER BY moment, value) AS value FROM s GROUP BY key)"""


@register(f"""WITH {_SETTING_ROWS} SELECT coalesce(max(CASE WHEN key = 'theme' AND value = '"dark"' THEN 'dark' END), 'system') AS theme, coalesce(bool_or(value = 'true') FILTER (key = 'reminders_enabled' AND value IN ('true', 'false')), TRUE) AS reminders_enabled,
    coalesce(max(CASE WHEN key = 'all_day_minute' AND value = '615' THEN 615 END), 540) AS all_day_minute, coalesce(bool_or(value = 'true') FILTER (key = 'haptics' AND value IN ('true', 'false')), TRUE) AS haptics, FALSE AS onboarded FROM w""")
def settings_values(spark, sf_dir):
    """The last write of each key over many writes, decoded with defaults for what does not fit."""
    k = F.col("o_orderkey")
    key = F.element_at(F.array(*(F.lit(x) for x in ("theme", "reminders_enabled", "all_day_minute", "haptics", "unknown", "next_notification_id"))), (k % 6 + 1).cast("int"))
    value = F.element_at(F.array(*(F.lit(x) for x in ('"dark"', "false", "615", "9999", "true"))), (k % 5 + 1).cast("int"))
    writes = table(spark, sf_dir, "orders").select(key.alias("key"), value.alias("value"), F.col("o_orderdate").cast("timestamp").alias("updated_at"))
    return entities.read_settings(store.upsert_settings(writes.limit(0), writes))


@register("SELECT c_custkey AS id, c_mktsegment IN ('BUILDING', 'MACHINERY') AS is_pro FROM customer")
def pro_owners(spark, sf_dir):
    state = F.when(F.col("c_mktsegment") == "BUILDING", "proActive").when(F.col("c_mktsegment") == "MACHINERY", "proGrace").when(F.col("c_mktsegment") == "FURNITURE", "free")
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), entities.is_pro(state).alias("is_pro"))


@register(f"WITH {TASKS_SQL} SELECT id, title, due_date FROM tasks_v WHERE id = 7")
def task_lookup(spark, sf_dir):
    return entities.find_task(tasks(spark, sf_dir), 7).select("id", "title", "due_date")


@register("""SELECT d AS day, CAST(count(event_id) AS BIGINT) AS capture_count, CAST(coalesce(sum(event_id % 3), 0) AS BIGINT) AS task_count FROM (VALUES (DATE '2024-01-30'), (DATE '2031-01-01')) AS t(d) LEFT JOIN events ON CAST(ts AS DATE) = d GROUP BY d""")
def usage_day_rows(spark, sf_dir):
    """A day with captures and one without."""
    deltas = usage(spark, sf_dir)
    return entities.usage_day(deltas, EVENTS_TODAY).union(entities.usage_day(deltas, dt.date(2031, 1, 1)))


@register(f"WITH {TASKS_SQL} SELECT id, CASE WHEN id % 7 = 0 THEN TRUE ELSE completed END AS completed, CASE WHEN id % 7 = 0 THEN TIMESTAMP '1998-08-02 10:07:00' ELSE completed_at END AS completed_at, CASE WHEN id % 7 = 0 THEN TIMESTAMP '1998-08-02 10:07:00' ELSE updated_at END AS updated_at FROM tasks_v")
def completion_toggle(spark, sf_dir):
    all_tasks = tasks(spark, sf_dir)
    out = store.set_completed(all_tasks, all_tasks.where("id % 7 = 0").select("id"), True, NOW)
    return out.select("id", "completed", F.col("completed_at").cast("timestamp_ntz").alias("completed_at"), F.col("updated_at").cast("timestamp_ntz").alias("updated_at"))


@register(f"WITH {TASKS_SQL} SELECT due_date, id, CAST(row_number() OVER (PARTITION BY due_date ORDER BY due_minute_of_day ASC NULLS FIRST, sort_order, id) AS INTEGER) AS place FROM tasks_v WHERE due_date IS NOT NULL")
def due_groups(spark, sf_dir):
    return entities.group_by_date(tasks(spark, sf_dir)).select("due_date", "id", "place")


@register(f"""WITH {TASKS_SQL}, h AS (SELECT {LABEL_SQL} AS label, min(due_date) AS first_date, count(*) AS n_tasks FROM tasks_v WHERE NOT completed AND due_date > DATE '1998-08-02' GROUP BY 1, CASE WHEN {LABEL_SQL} IN ('today', 'nextWeek', 'later') THEN NULL ELSE due_date END)
    SELECT CASE label WHEN 'today' THEN 'Today' WHEN 'tomorrow' THEN 'Tomorrow' WHEN 'weekday' THEN dayname(first_date) WHEN 'nextWeek' THEN 'Next week' ELSE 'Later' END AS header, n_tasks FROM h""")
def header_titles(spark, sf_dir):
    """The headers of all upcoming tasks as the app shows them."""
    found = groups.group_headers(tasks(spark, sf_dir).where(~F.col("completed") & (F.col("due_date") > F.lit(TODAY))), TODAY)
    return found.select(entities.group_header(F.col("label"), F.col("first_date"), F.lit(TODAY)).alias("header"), "n_tasks")


@register(f"""WITH {TASKS_SQL}, n AS (SELECT id, completed, due_date, CASE WHEN id % 5 = 0 THEN NOT completed ELSE completed END AS now_done, CASE WHEN id % 7 = 0 THEN due_date + 1 ELSE due_date END AS now_due FROM tasks_v WHERE id % 11 <> 0)
    SELECT count(*) FILTER (NOT now_done) AS open_count, count(*) FILTER (now_done) AS completed_count, count(DISTINCT now_due) FILTER (NOT now_done) AS due_days FROM n""")
def maintained_totals(spark, sf_dir):
    """Counts of the views after two batches of changes (the table, then updates and deletes), kept by deltas."""
    at = lambda df: df.withColumn("completed_at", F.lit(None).cast("timestamp"))
    first = at(tasks(spark, sf_dir).select("id", "completed", "due_date"))
    then = first.where("id % 11 <> 0").withColumns({"completed": F.when(F.col("id") % 5 == 0, ~F.col("completed")).otherwise(F.col("completed")), "due_date": F.when(F.col("id") % 7 == 0, F.date_add("due_date", 1)).otherwise(F.col("due_date"))})
    deltas = views.view_deltas(views.changes_between(first.limit(0), first)).unionAll(views.view_deltas(views.changes_between(first, then)))
    counts = deltas.groupBy("view", "day").agg(F.sum("n").alias("n")).where("n <> 0")
    some = lambda view: F.coalesce(F.sum(F.when(F.col("view") == view, F.col("n"))), F.lit(0)).cast("long")
    return counts.agg(some("open").alias("open_count"), some("done").alias("completed_count"), F.count_if(F.col("view") == "due").alias("due_days"))


@register("""WITH t AS (SELECT o_orderkey AS id, o_orderkey % 997 AS capture_id, o_orderpriority AS title, CASE WHEN o_orderkey % 3 > 0 THEN CAST(date_trunc('year', o_orderdate) AS DATE) END AS due_date FROM orders),
    m AS (SELECT *, row_number() OVER (PARTITION BY capture_id, lower(title), due_date ORDER BY id) AS copy, bool_or(due_date IS NOT NULL) OVER (PARTITION BY capture_id, lower(title)) AS any_date FROM t)
    SELECT id, capture_id, title, due_date FROM m WHERE copy = 1 AND (due_date IS NOT NULL OR NOT any_date)""")
def unique_captures(spark, sf_dir):
    """Repeats within a capture count once, and an undated task gives way to a dated one of its title."""
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), (k % 997).alias("capture_id"), F.col("o_orderpriority").alias("title"), F.when(k % 3 > 0, F.trunc("o_orderdate", "year")).alias("due_date"), F.lit(None).cast("int").alias("due_minute_of_day"), F.lit(0).alias("sort_order"))
    return entities.unique_captures(rows).select("id", "capture_id", "title", "due_date")


@register(f"""WITH {TASKS_SQL}, fit AS (SELECT * FROM tasks_v WHERE reminder_at_local IS NOT NULL AND reminder_enabled AND NOT completed), held AS (SELECT notification_id FROM tasks_v WHERE id % 5 = 0),
    wanted AS (SELECT notification_id FROM fit WHERE reminder_at_local > TIMESTAMP '1998-08-02 10:07:00' ORDER BY reminder_at_local, id LIMIT 60),
    safe AS (SELECT notification_id FROM wanted UNION SELECT notification_id FROM fit WHERE reminder_at_local <= TIMESTAMP '1998-08-02 10:07:00' AND reminder_at_local > TIMESTAMP '1998-08-02 09:07:00')
    SELECT (SELECT count(*) FROM wanted) AS scheduled, (SELECT count(*) FROM held WHERE notification_id NOT IN (SELECT notification_id FROM safe)) AS cancelled, 'done' AS outcome
    UNION ALL SELECT 0, (SELECT count(*) FROM held), 'disabled' UNION ALL SELECT 0, (SELECT count(*) FROM held), 'permission'""")
def sweep_outcomes(spark, sf_dir):
    """A sweep that runs, one with the switch off, and one without permission."""
    all_tasks = tasks(spark, sf_dir)
    held = all_tasks.where("id % 5 = 0").select("notification_id")
    out = lambda **k: reminders.sweep_outcome(reminders.reminder_plan(all_tasks, held, NOW, **k), **k)
    return out().union(out(enabled=False)).union(out(permitted=False))


@register("SELECT o_orderkey AS id, CAST((2147483646 - 100 + row_number() OVER (ORDER BY o_orderkey)) % 2147483647 + 1 AS INTEGER) AS notification_id FROM orders")
def alarm_slots(spark, sf_dir):
    """Consecutive slots that pass the largest one and begin again."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    return store.assign_slots(rows, 0x7FFFFFFF - 100).select("id", "notification_id")


@register(r"""WITH w AS (SELECT role, len(list_filter(string_split_regex(regexp_replace(lower(text), '[^a-z0-9'':\s]+', ' ', 'g'), '\s+'), lambda x: x <> '')) AS n FROM conversations), e AS (SELECT role, n, least(n, 2) AS edits FROM w)
    SELECT role, count(*) AS clips, round(avg(CASE WHEN n = 0 THEN 0.0 ELSE edits / n END), 9) AS mean_wer, round(sum(edits) / CASE WHEN sum(n) = 0 THEN 1 ELSE sum(n) END, 9) AS pooled_wer, count(*) FILTER (n > 0) AS lost, 0 AS gained FROM e GROUP BY ROLLUP (role)""")
def transcript_errors(spark, sf_dir):
    """Turns heard with the first word wrong and the last one lost, by role and over all."""
    # A turn costs milliseconds and few bytes: the few row groups of a file are dealt to more tasks than cores.
    turns = table(spark, sf_dir, "conversations").select("role", "text").repartition(4 * max(spark.sparkContext.defaultParallelism, 2))
    said = turns.select("role", F.explode(F.array(numerals.wer_tokens(F.col("text")))).alias("reference"))
    heard = F.when(F.size("reference") > 1, F.concat(F.array(F.lit("zzzz")), F.slice("reference", 2, F.greatest(F.lit(0), F.size("reference") - 2)))).otherwise(F.array().cast("array<string>"))
    card = scoring.error_summary(said.withColumn("heard", heard), "role")
    return card.select("role", "clips", F.round("mean_wer", 9).alias("mean_wer"), F.round("pooled_wer", 9).alias("pooled_wer"), "lost", F.col("gained").cast("int").alias("gained"))


@register("""WITH c AS (SELECT c_custkey AS k, c_nationkey AS n FROM customer), s AS (SELECT k, n, CASE WHEN k % 11 = 0 THEN 0 WHEN k % 7 = 0 THEN 450 ELSE k % 449 + 1 END AS days, CASE WHEN k % 7 = 0 THEN 999 ELSE k % 60 + 5 END AS gap, CASE WHEN k % 5 = 0 THEN 1 ELSE 0 END AS late FROM c)
    SELECT k AS owner, n AS open_count, CAST(days AS INTEGER) AS completed_count, CASE WHEN days = 0 THEN 0 ELSE least(greatest(7 - late, 0), days) - CASE WHEN gap + late < 7 AND gap < days THEN 1 ELSE 0 END END AS done_last_7,
        CAST(CASE WHEN days = 0 THEN 0 ELSE least(400, gap, days) END AS INTEGER) AS streak_days FROM s""")
def streak_cases(spark, sf_dir):
    """Streaks that meet their cap, a gap, their first day, or nothing, ending today or yesterday, with the totals of every owner."""
    k = F.col("c_custkey")
    days = F.when(k % 11 == 0, 0).when(k % 7 == 0, 450).otherwise(k % 449 + 1).cast("int")
    owners = table(spark, sf_dir, "customer").select(k.alias("owner"), F.col("c_nationkey").alias("open_count"), days.alias("completed_count"), F.when(k % 7 == 0, 999).otherwise(k % 60 + 5).alias("gap"), F.when(k % 5 == 0, 1).otherwise(0).alias("late"))
    back = owners.where("completed_count > 0").withColumn("back", F.explode(F.sequence(F.lit(0), F.col("completed_count") - 1))).where("back <> gap")
    by_day = back.select("owner", F.date_sub(F.lit(TODAY), (F.col("back") + F.col("late")).cast("int")).alias("day"), F.lit(1).alias("n_done"))
    return groups.owner_stats(by_day, TODAY, totals=owners.select("owner", "open_count", "completed_count"))


@register("""SELECT o_orderkey AS id, '{"taskId":"' || o_orderkey || '-' || o_orderpriority || '"}' AS payload, o_orderkey || '-' || o_orderpriority AS task_id,
    CAST(greatest(1, list_reduce(list_prepend(CAST(18652613 AS BIGINT), list_transform(string_split(o_orderkey || '-' || o_orderpriority, ''), lambda c: CAST(unicode(c) AS BIGINT))), lambda a, b: (xor(a, b) * 16777619) & 2147483647)) AS INTEGER) AS slot FROM orders""")
def payload_slots(spark, sf_dir):
    """Payloads of notifications, read again, and the slots that task ids hash to."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.concat_ws("-", F.col("o_orderkey").cast("string"), "o_orderpriority").alias("task"))
    payload = text.encode_payload(F.col("task"))
    return rows.select("id", payload.alias("payload"), text.decode_payload(payload).alias("task_id"), text.slot_hash(F.col("task")).alias("slot"))


@register("""WITH t AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN '  ' || repeat(' ', CAST(o_orderkey % 5 AS INTEGER)) WHEN 1 THEN 'a' || repeat('  b', CAST(o_orderkey % 120 AS INTEGER)) WHEN 2 THEN chr(160) || chr(9) ELSE o_orderpriority END AS x FROM orders)
    SELECT id, length(y) > 0 AS valid, CAST(length(rtrim(substr(y, 1, 200))) AS INTEGER) AS size FROM (SELECT id, trim(regexp_replace(x, '[\\s\\x{A0}]+', ' ', 'g')) AS y FROM t)""")
def valid_titles(spark, sf_dir):
    """Blank titles are none, blanks collapse, and long ones are cut to 200 units."""
    k = F.col("o_orderkey")
    title = F.when(k % 4 == 0, F.concat(F.lit("  "), F.repeat(F.lit(" "), (k % 5).cast("int")))).when(k % 4 == 1, F.concat(F.lit("a"), F.repeat(F.lit("  b"), (k % 120).cast("int")))).when(k % 4 == 2, "\xa0\t").otherwise(F.col("o_orderpriority"))
    rows = table(spark, sf_dir, "orders").select(k.alias("id"), title.alias("x"))
    return rows.select("id", text.is_valid_title(F.col("x")).alias("valid"), F.length(text.normalise_title(F.col("x"))).alias("size"))


QUERIES |= language.QUERIES | spoken.QUERIES
SQL |= language.SQL | spoken.SQL
