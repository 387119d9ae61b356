"""Queries of the grammar and of note extraction: phrases of every rule over all orders, and what SQL says they mean.

Every order is said in one of the phrases (by its key), with its own date as ``now``; the SQL computes the
expected date, minute and title by date arithmetic, without the grammar.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import notes as spoken
from ..functions import when
from ..operators import extract
from .views import table

#: now of an order: its date at 10:07.
_MINUTE_NOW = 607
_NOW_SQL = "CAST(o_orderdate AS DATE) AS d, o_orderkey AS id"


def _monday(days: int) -> str:
    return f"CAST(date_trunc('week', d) AS DATE) + {days}"


def _next(dow: int, today: bool = False) -> str:
    ahead = f"(({dow} - isodow(d)) % 7 + 7) % 7"
    return f"d + CAST({ahead} AS INTEGER)" if today else f"d + CAST(CASE WHEN {ahead} = 0 THEN 7 ELSE {ahead} END AS INTEGER)"


def _nth(day: int) -> str:
    return f"(SELECT min(x) FROM (SELECT CAST(date_trunc('month', d) AS DATE) + to_months(k) AS f FROM (SELECT unnest([0, 1, 2]) AS k)) m, LATERAL (SELECT CASE WHEN {day} <= day(last_day(f)) THEN CAST(f AS DATE) + {day - 1} END AS x) WHERE x >= d)"


def _md(month: int, day: int) -> str:
    return f"CASE WHEN make_date(year(d), {month}, {day}) >= d THEN make_date(year(d), {month}, {day}) ELSE make_date(year(d) + 1, {month}, {day}) END"


_LAST_FRIDAY = "d - CAST(CASE WHEN (isodow(d) - 5 + 7) % 7 = 0 THEN 7 ELSE (isodow(d) - 5 + 7) % 7 END AS INTEGER)"

_FIFTH = lambda k: f"(CAST(date_trunc('month', d) + INTERVAL {k} MONTH AS DATE) + 4)"
#: The 5th of this month or the next that is a Tuesday, else the next 5th.
_AGREED = f"CASE WHEN isodow({_FIFTH(0)}) = 2 AND {_FIFTH(0)} >= d THEN {_FIFTH(0)} WHEN isodow({_FIFTH(1)}) = 2 THEN {_FIFTH(1)} ELSE {_nth(5)} END"

#: (rule, phrase, date in SQL of the day d, minute or NULL)
DATE_PHRASES = [
    ("DT1", "the day after tomorrow", "d + 2", "NULL"), ("DT2", "the day before yesterday", "d - 2", "NULL"), ("DT3", "tomorrow", "d + 1", "NULL"), ("DT3", "tomorrow morning", "d + 1", "540"),
    ("DT4", "later today", "d", "NULL"), ("DT4", "today", "d", "NULL"), ("DT5", "tonight", "d", "1200"), ("DT6", "last night", "d - 1", "1200"), ("DT7", "yesterday evening", "d - 1", "1080"), ("DT8", "this afternoon", "d", "840"),
    ("DT9", "on Tuesday", _next(2), "NULL"), ("DT9", "this Tuesday", _next(2, True), "NULL"), ("DT9", "next Tuesday evening", _monday(8), "1080"), ("DT9", "last Friday", _LAST_FRIDAY, "NULL"), ("DT9", "on Tue", _next(2), "NULL"),
    ("DT10", "this weekend", _next(6, True), "NULL"), ("DT10", "next weekend", _monday(12), "NULL"), ("DT11", "next week on Thursday", _monday(10), "NULL"), ("DT11", "Thursday of next week", _monday(10), "NULL"), ("DT12", "next week", _monday(7), "NULL"),
    ("DT13", "by the end of the month", "last_day(d)", "NULL"), ("DT13", "on the last day of next month", "last_day(CAST(d + INTERVAL 1 MONTH AS DATE))", "NULL"), ("DT14", "next month", "CAST(date_trunc('month', d) + INTERVAL 1 MONTH AS DATE)", "NULL"),
    ("DT15", "in 3 days", "d + 3", "NULL"), ("DT15", "in two weeks", "d + 14", "NULL"), ("DT15", "in a month", "CAST(d + INTERVAL 1 MONTH AS DATE)", "NULL"), ("DT15", "in 45 minutes", "d", "652"), ("DT15", "in about twenty hours", "d + 1", "367"), ("DT15", "after two years", "CAST(d + INTERVAL 2 YEAR AS DATE)", "NULL"),
    ("DT16", "in half an hour", "d", "637"), ("DT17", "in an hour and a half", "d", "697"), ("DT17", "in two and a half hours", "d", "757"), ("DT18", "in 1.5 hours", "d", "697"),
    ("DT19", "2031-04-05", "DATE '2031-04-05'", "NULL"), ("DT20", "on 10/5", _md(10, 5), "NULL"), ("DT20", "on 10/5/31", "DATE '2031-10-05'", "NULL"), ("DT21", "October 5th", _md(10, 5), "NULL"), ("DT21", "on October 5, 2031", "DATE '2031-10-05'", "NULL"),
    ("DT22", "on the 5th of October", _md(10, 5), "NULL"), ("DT22", "5 October 2031", "DATE '2031-10-05'", "NULL"), ("DT23", "the first of October", _md(10, 1), "NULL"), ("DT23", "the fifth of October, 2031", "DATE '2031-10-05'", "NULL"),
    ("DT24", "on October twenty first", _md(10, 21), "NULL"), ("DT25", "Thursday, October fifteenth", _md(10, 15), "NULL"), ("DT26", "on the 25th", _nth(25), "NULL"), ("DT26", "the 31st", _nth(31), "NULL"), ("DT27", "by 12th", _nth(12), "NULL"),
    ("DT28", "on Tuesday the 5th", _AGREED, "NULL"), ("DT29", "on the fifth", _nth(5), "NULL"), ("DT29", "by the thirtieth", _nth(30), "NULL"), ("DT30", "in October", "CASE WHEN month(d) = 10 THEN d WHEN month(d) < 10 THEN make_date(year(d), 10, 1) ELSE make_date(year(d) + 1, 10, 1) END", "NULL"),
]

#: (rule, phrase, minute)
TIME_PHRASES = [
    ("TM1", "between 3 and 5 pm", 900), ("TM1", "between 9 and 11 in the morning", 540), ("TM1", "between 11 and 1 pm", 660), ("TM2", "in the evening at 7", 1140), ("TM2", "at night around nine thirty", 1290), ("TM3", "at 7:30 in the morning", 450), ("TM3", "at 11 at night", 1380),
    ("TM4", "at 3 pm", 900), ("TM4", "3:30 p.m.", 930), ("TM4", "at 12 am", 0), ("TM5", "at 330pm", 930), ("TM6", "at a quarter past three", 915), ("TM6", "at half past nine", 570), ("TM6", "at ten to three", 890), ("TM7", "at 15:30", 930), ("TM7", "at 5:45", 1065), ("TM7", "at 05:45", 345),
    ("TM8", "at 4.30", 990), ("TM9", "at 1530", 930), ("TM10", "5 o'clock", 1020), ("TM11", "at 12 noon", 720), ("TM11", "at twelve midnight", 0), ("TM12", "at 5", 1020), ("TM12", "at 11", 660), ("TM13", "by 5", 1020), ("TM14", "at five thirty", 1050), ("TM14", "at eight forty five", 525), ("TM15", "at noon", 720), ("TM16", "in the afternoon", 840), ("TM16", "at night", 1200),
]

#: (rule, phrase, date in SQL, minute, rest)
WHEN_PHRASES = [
    ("W1", "call Anna tomorrow at 3 pm", "d + 1", 900, "call Anna"), ("W1", "call Anna at 9 am", "d + 1", 540, "call Anna"), ("W1", "call Anna at 11 am", "d", 660, "call Anna"), ("W2", "tomorrow evening at 7 call Anna", "d + 1", 1140, "call Anna"), ("W2", "tomorrow morning at 9 call Anna", "d + 1", 540, "call Anna"),
    ("D9", "Dinner tomorrow at 7", "d + 1", 1140, "Dinner"), ("D9", "Gym tomorrow at 7", "d + 1", 420, "Gym"), ("D13", "tonight at 2 call Anna", "d + 1", 120, "call Anna"), ("D13", "tonight at 11 call Anna", "d", 1380, "call Anna"), ("D8", "call Anna tomorrow at 5", "d + 1", 1020, "call Anna"),
    ("W3", "on Tuesday at noon call Anna", _next(2), 720, "call Anna"), ("D11", "today in the evening walk the dog", "d", 1080, "walk the dog"),
]

#: (rule, spoken, written)
NORMAL_PHRASES = [
    ("N1", "Buy “bread” , and  milk", "Buy bread, and milk"), ("N1", "Call [noise] Anna (cough) now", "Call Anna now"), ("N2", "I'm okay, buy bread", "okay, buy bread"), ("N2", "Um, buy, uh, bread", "buy, bread"), ("N2", "Unremind me to call", "remind me to call"),
    ("N3", "Tomorrow a 12 lunch", "Tomorrow at 12 lunch"), ("N3", "at 730 in the morning run", "at 7:30 in the morning run"), ("N3", "at 4.0 call", "at 4 call"), ("N3", "at 15 0 0 call", "at 15:00 call"), ("N3", "at 11 a.m. call", "at 11 am call"),
    ("N4", "Called Anna tomorrow at 5", "call Anna tomorrow at 5"), ("N4", "By the cake", "buy the cake"), ("N4", "Pickup the kids", "pick up the kids"), ("N4", "please cent the report", "please send the report"), ("N5", "Buy bread Call the bank", "Buy bread. Call the bank"),
    ("C0", "call call the the bank", "call the bank"), ("C0", "by the way, call the bank and", "call the bank"), ("C2", "call at 4, no wait, at 4.30", "call at 4.30"), ("C2", "call on Monday, sorry, on Tuesday", "call on Tuesday"), ("C2", "take the rice out. No, not rice, the meat", "take the meat out"), ("C2", "call at 4, no, 5", "call at 5"),
]

#: (rule, note, joints and clauses)
CLAUSE_NOTES = [
    ("C1", "Call the bank. Buy milk.", "Call the bank.||.:Buy milk."), ("C1", "Call Dr. Karimov. Then buy milk", "Call Dr Karimov.||..:Then buy milk"), ("C4", "Call the bank and then buy milk", "Call the bank||then:buy milk"), ("C4", "Buy bread and milk", "Buy bread and milk"), ("C4", "Call the bank, so buy milk", "Call the bank||so:buy milk"),
    ("C4", "Call the bank, after that buy milk", "Call the bank||then:buy milk"), ("C4", "Call the bank and also buy milk", "Call the bank||also:buy milk"), ("C5", "Call the bank, on Friday buy milk", "Call the bank||,:on Friday buy milk"), ("C5", "call the bank on Friday on October 5th pay the rent", "call the bank on Friday||.:on October 5th pay the rent"),
    ("C7", "go to the market and buy milk", "go to the market and buy milk"), ("C7", "send the build and the release notes", "send the build and the release notes"), ("C10", "Call the bank, buy milk and water the plants", "Call the bank||,:buy milk||and:water the plants"), ("C11", "Call the bank. And buy milk", "Call the bank.||..:And buy milk"),
]

#: (rule, note, [(title, date in SQL, minute or NULL, reminder)])
TASK_NOTES = [
    ("X1", "Thank you, bye.", []), ("X2", "What is this?", []), ("X3", "I have three tasks for tomorrow. Call the bank. Buy milk.", [("Call the bank", "d + 1", "NULL", False), ("Buy milk", "d + 1", "NULL", False)]),
    ("X4", "The plumber is coming tomorrow at 3 pm, so buy a new tap", [("Buy a new tap", "d + 1", "900", True)]), ("X4", "It's very cold today. Buy milk", [("Buy milk", "NULL", "NULL", False)]), ("X5", "My phone is almost dead. Buy milk", [("Buy milk", "NULL", "NULL", False)]),
    ("X6", "Okay, so please remind me to call to my brother tomorrow.", [("Call my brother", "d + 1", "NULL", True)]), ("X7", "I want to learn English every day at 8 am", [("Learn English", "d + 1", "480", True)]), ("X8", "On Tuesday call the bank and buy milk", [("Call the bank", _next(2), "NULL", False), ("Buy milk", _next(2), "NULL", False)]),
    ("X8", "Call the bank on Tuesday, also buy milk", [("Call the bank", _next(2), "NULL", False), ("Buy milk", "NULL", "NULL", False)]), ("X8", "Tomorrow call the bank, and whenever I have time fix the door", [("Call the bank", "d + 1", "NULL", False), ("Fix the door", "NULL", "NULL", False)]),
    ("X9", "Remind me to water the plants", [("Water the plants", "NULL", "NULL", True)]), ("X10", "Pay the rent on the 25th. Remind me the day before", [("Pay the rent", f"{_nth(25)} - CASE WHEN day(d) IN (24, 25) THEN 0 ELSE 1 END", "NULL", True)]), ("X11", "Send the invoice by Friday and remind me on Thursday evening", [("Send the invoice", _next(5), "NULL", True)]),
    ("X12", "Pay the internet bill, it's due on the 25th", [("Pay the internet bill", _nth(25), "NULL", False)]), ("X13", "I called mom yesterday. Buy milk", [("Buy milk", "NULL", "NULL", False)]), ("X14", "Call the vet and book a table, both on Friday", [("Call the vet", _next(5), "NULL", False), ("Book a table", _next(5), "NULL", False)]),
    ("X15", "Clean the house last Friday. Buy milk", [("Clean the house", "NULL", "NULL", False), ("Buy milk", "NULL", "NULL", False)]), ("J7", "Buy milk. Buy milk. Buy milk tomorrow", [("Buy milk", "NULL", "NULL", False), ("Buy milk", "d + 1", "NULL", False)]), ("C2", "Call the bank at 3 pm, no wait, at 4 pm", [("Call the bank", "d", "960", True)]),
    ("C6", "Tomorrow at 9 am. Call the bank", [("Call the bank", "d + 1", "540", True)]), ("C9", "On the 1st pay the rent, on the 2nd the gas bill", [("Pay the rent", _nth(1), "NULL", False), ("Pay the gas bill", _nth(2), "NULL", False)]), ("D7", "On Tuesday at 3 pm call the bank", [("Call the bank", _next(2), "900", True)]),
]


def _said(spark, sf_dir: str, phrases: list[str], names: list[str]) -> DataFrame:
    """id, now, rule and note of every order: the phrase that its key names."""
    pick = lambda values: F.element_at(F.array(*(F.lit(v) for v in values)), (F.col("o_orderkey") % len(values) + 1).cast("int"))
    now = F.to_date("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(_MINUTE_NOW))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), now.alias("now"), pick(names).alias("rule"), pick(phrases).alias("note"))


def _cases(n: int, values: list[str]) -> str:
    return f"CASE id % {n} " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _orders() -> str:
    return f"o AS (SELECT {_NOW_SQL} FROM orders)"


def date_phrases(spark, sf_dir):
    """DT1 to DT30 with the text around the phrase."""
    phrases = [p[1] for p in DATE_PHRASES]
    notes = _said(spark, sf_dir, [f"{p} call Anna" for p in phrases], [p[0] for p in DATE_PHRASES])
    return when.parse_when(notes, "note", "now").select("id", "rule", "date", "minute", "rest")


def time_phrases(spark, sf_dir):
    """TM1 to TM16 on the day after now, so that no time is over."""
    notes = _said(spark, sf_dir, [f"call Anna {p[1]}" for p in TIME_PHRASES], [p[0] for p in TIME_PHRASES])
    return when.parse_when(notes, "note", "now").select("id", "rule", "date", "minute", "rest")


def when_phrases(spark, sf_dir):
    """How a date and a time are read together."""
    notes = _said(spark, sf_dir, [p[1] for p in WHEN_PHRASES], [p[0] for p in WHEN_PHRASES])
    return when.parse_when(notes, "note", "now").select("id", "rule", "date", "minute", "rest")


def normal_notes(spark, sf_dir):
    """Repairs of transcripts and self-corrections."""
    notes = _said(spark, sf_dir, [p[1] for p in NORMAL_PHRASES], [p[0] for p in NORMAL_PHRASES])
    return when.once_each(notes, ["note"], text=spoken.corrected(spoken.normalise(F.col("note")))).select("id", "rule", "text")


def note_clauses(spark, sf_dir):
    """Clauses of notes with their joints, one row each."""
    notes = _said(spark, sf_dir, [p[1] for p in CLAUSE_NOTES], [p[0] for p in CLAUSE_NOTES])
    return extract.note_clauses(notes).select("id", "rule", "position", "joint", "clause")


def note_tasks(spark, sf_dir):
    """Tasks of notes that need every rule of the fold."""
    notes = _said(spark, sf_dir, [p[1] for p in TASK_NOTES], [p[0] for p in TASK_NOTES])
    return extract.extract_tasks(notes).select("id", "rule", "position", "title", "date", "minute", "has_reminder")


def note_drafts(spark, sf_dir):
    """Tasks of the same notes, and the whole note where there is none."""
    notes = _said(spark, sf_dir, [p[1] for p in TASK_NOTES], [p[0] for p in TASK_NOTES])
    return extract.drafts(notes).groupBy("id", "rule").agg(F.count("*").alias("n_drafts"), F.min("title").alias("first_title"))


def _clause_rows() -> list[tuple[int, int, str, str]]:
    out = []
    for i, (_, _, text) in enumerate(CLAUSE_NOTES):
        for k, part in enumerate(text.split("||")):
            joint, clause = ("", part) if k == 0 else part.split(":", 1)
            out.append((i, k, joint, clause))
    return out


def _task_rows(columns: str) -> str:
    parts = []
    for i, (_, _, tasks) in enumerate(TASK_NOTES):
        for k, (title, date, minute, reminder) in enumerate(tasks, 1):
            parts.append(f"SELECT id, d, {i} AS kind, {k} AS position, {_quoted(title)} AS title, CAST({date} AS DATE) AS date, CAST({minute} AS INTEGER) AS minute, {reminder} AS has_reminder FROM o WHERE id % {len(TASK_NOTES)} = {i}")
    return f"SELECT {columns} FROM ({' UNION ALL '.join(parts)})"


def _rule_sql(rows: list[tuple]) -> str:
    return _cases(len(rows), [_quoted(r[0]) for r in rows])


_N = len(DATE_PHRASES)
QUERIES = {f.__name__: f for f in (date_phrases, time_phrases, when_phrases, normal_notes, note_clauses, note_tasks, note_drafts)}
SQL = {
    "date_phrases": f"WITH {_orders()} SELECT id, {_rule_sql(DATE_PHRASES)} AS rule, CAST({_cases(_N, [p[2] for p in DATE_PHRASES])} AS DATE) AS date, CAST({_cases(_N, [p[3] for p in DATE_PHRASES])} AS INTEGER) AS minute, 'call Anna' AS rest FROM o",
    "time_phrases": f"WITH {_orders()}, t AS (SELECT id, d, {_rule_sql(TIME_PHRASES)} AS rule, CAST({_cases(len(TIME_PHRASES), [str(p[2]) for p in TIME_PHRASES])} AS INTEGER) AS minute FROM o) SELECT id, rule, CAST(CASE WHEN minute <= {_MINUTE_NOW} THEN d + 1 ELSE d END AS DATE) AS date, minute, 'call Anna' AS rest FROM t",
    "when_phrases": f"WITH {_orders()} SELECT id, {_rule_sql(WHEN_PHRASES)} AS rule, CAST({_cases(len(WHEN_PHRASES), [p[2] for p in WHEN_PHRASES])} AS DATE) AS date, CAST({_cases(len(WHEN_PHRASES), [str(p[3]) for p in WHEN_PHRASES])} AS INTEGER) AS minute, {_cases(len(WHEN_PHRASES), [_quoted(p[4]) for p in WHEN_PHRASES])} AS rest FROM o",
    "normal_notes": f"WITH {_orders()} SELECT id, {_rule_sql(NORMAL_PHRASES)} AS rule, {_cases(len(NORMAL_PHRASES), [_quoted(p[2]) for p in NORMAL_PHRASES])} AS text FROM o",
    "note_clauses": f"WITH {_orders()}, c(kind, position, joint, clause) AS (VALUES {', '.join(f'({i}, {k}, {_quoted(j)}, {_quoted(c)})' for i, k, j, c in _clause_rows())}) SELECT id, {_rule_sql(CLAUSE_NOTES)} AS rule, CAST(position AS INTEGER) AS position, joint, clause FROM o JOIN c ON id % {len(CLAUSE_NOTES)} = kind",
    "note_tasks": f"WITH {_orders()} {_task_rows(f'id, {_rule_sql(TASK_NOTES)} AS rule, CAST(position AS INTEGER) AS position, title, date, minute, has_reminder')}",
    "note_drafts": f"WITH {_orders()}, t AS ({_task_rows('id, title')}), e AS (SELECT id, {_cases(len(TASK_NOTES), [_quoted(p[1]) for p in TASK_NOTES])} AS title FROM o WHERE {_cases(len(TASK_NOTES), [str(not p[2]) for p in TASK_NOTES])}) SELECT id, {_rule_sql(TASK_NOTES)} AS rule, count(*) AS n_drafts, min(title) AS first_title FROM (SELECT id, title FROM t UNION ALL SELECT id, title FROM e) GROUP BY id",
}

