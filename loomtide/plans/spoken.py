"""Queries of whole notes whose words vary with the row: corrections, several days and times, carried days, topics and kinds of clauses.

Every order says one of the templates, filled with weekdays, hours and numbers of its key; SQL computes the answer by date arithmetic from the
same numbers, without the grammar.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import notes as spoken
from ..functions import numerals, when
from ..functions.when import MONTHS, WEEKDAYS
from ..operators import extract
from .language import _MINUTE_NOW, _quoted
from .views import table

#: What a template may name, as SQL over the key; Spark reads the same expressions.  {w} and {v} are different weekdays, {h} and {g} hours.
_NUMBERS = {"w": "id % 7 + 1", "v": "(id + 3) % 7 + 1", "h": "id % 6 + 2", "g": "id % 6 + 3", "n": "id % 9 + 11", "m": "id % 9 + 12", "k": "id % 7 + 2", "a": "id % 12 + 1", "b": "(id + 5) % 12 + 1"}
_NAMES = {"w": [x.capitalize() for x in WEEKDAYS], "v": [x.capitalize() for x in WEEKDAYS], "a": [x.capitalize() for x in MONTHS], "b": [x.capitalize() for x in MONTHS]}
_SIGNALS = ["no wait", "sorry", "I mean", "no"]
_FOUND = "(SELECT d, id, id % {n} AS kind, (id // {n}) % 4 AS turn FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_orderkey AS id FROM orders))"


def _ahead(letter: str) -> str:
    """The next such weekday after the day d."""
    days = f"((({_NUMBERS[letter]}) - isodow(d)) % 7 + 7) % 7"
    return f"(d + CAST(CASE WHEN {days} = 0 THEN 7 ELSE {days} END AS INTEGER))"


def _filled(text: str) -> Column:
    """A template with its names and numbers as columns of the key."""
    out = F.lit(text)
    for letter, number in _NUMBERS.items():
        if "{" + letter + "}" in text:
            value = F.expr(number)
            word = F.element_at(F.array(*(F.lit(x) for x in _NAMES[letter])), value.cast("int")) if letter in _NAMES else value.cast("string")
            out = F.replace(out, F.lit("{" + letter + "}"), word)
    if "{s}" in text:
        out = F.replace(out, F.lit("{s}"), F.element_at(F.array(*(F.lit(x) for x in _SIGNALS)), F.expr("turn + 1").cast("int")))
    return out


def _sql_text(text: str) -> str:
    """The same in SQL."""
    out = _quoted(text)
    for letter, number in _NUMBERS.items():
        if "{" + letter + "}" in text:
            value = f"[{', '.join(_quoted(x) for x in _NAMES[letter])}][{number}]" if letter in _NAMES else f"CAST({number} AS VARCHAR)"
            out = f"replace({out}, '{{{letter}}}', {value})"
    if "{s}" in text:
        out = f"replace({out}, '{{s}}', [{', '.join(_quoted(x) for x in _SIGNALS)}][turn + 1])"
    return out


def _said(spark, sf_dir: str, templates: list[str], rules: list[str]) -> DataFrame:
    n = len(templates)
    now = F.to_date("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(mins=F.lit(_MINUTE_NOW))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), now.alias("now")).withColumns({"kind": F.expr(f"id % {n}"), "turn": F.expr(f"(id div {n}) % 4")})
    rule = F.element_at(F.array(*(F.lit(r) for r in rules)), (F.col("kind") + 1).cast("int"))
    # A template is filled only for its own rows.
    note = reduce(lambda out, i: out.when(F.col("kind") == i, _filled(templates[i])), range(1, n), F.when(F.col("kind") == 0, _filled(templates[0])))
    return rows.select("id", "now", rule.alias("rule"), note.alias("note"))


def _cases(values: list[str]) -> str:
    return "CASE kind " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(values)) + " END"


#: (rule, said, meant): each said with four signals.
CORRECTIONS = [
    ("C2 fronted", "At {h} call the bank, {s}, at {g}", "At {g} call the bank"), ("C2 time", "call the bank at {h}, {s}, at {g}", "call the bank at {g}"), ("C2 day", "call Anna on {w}, {s}, on {v}", "call Anna on {v}"),
    ("C2 date", "pay the rent on the {n}th, {s}, the {m}th", "pay the rent on the {m}th"), ("C2 word", "meet Bob on {w}, {s}, tomorrow at {h}", "meet Bob tomorrow at {h}"), ("C2 over words", "On {w} go to the gym, {s}, on {v}", "On {v} go to the gym"),
    ("C2 loose", "call Anna tomorrow, {s}, on {v}", "call Anna on {v}"), ("C2 month", "send the report in {a}, {s}, in {b}", "send the report in {b}"), ("C2 goes on", "call the bank at {h} pm, {s}, at {g} pm and buy milk", "call the bank at {g} pm and buy milk"),
    ("C2 refused", "buy {k} eggs. {s}, I have to go", "buy {k} eggs. {s}, I have to go"),
]

_NULL = "NULL"
_AT = lambda letter: f"(({_NUMBERS[letter]}) * 60)"
_PM = lambda letter: f"(({_NUMBERS[letter]}) * 60 + 720)"
#: (rule, said, date, minute, rest, spans)
SEVERAL = [
    ("W1 moved", "Move the meeting from {w} to {v}", _NULL, _NULL, "Move the meeting from {w} to {v}", 0), ("W1 moved with a time", "Reschedule it from {w} to {v} at {h} pm", _NULL, _NULL, "Reschedule it from {w} to {v} at {h} pm", 0),
    ("W1 first day", "call Anna on {w} or write on {v}", _ahead("w"), _NULL, "call Anna or write on {v}", 1), ("W1 part after", "at {h} go jogging in the morning", "CASE WHEN {m} < 607 THEN d + 1 ELSE d END".replace("{m}", _AT("h")), _AT("h"), "go jogging", 2),
    ("W1 part before", "in the evening go to the gym at {h}", "d", _PM("h"), "go to the gym", 2), ("W1 part of a thing", "at {h} pm buy flowers for the party in the evening", "d", _PM("h"), "buy flowers for the party in the evening", 1),
    ("W1 other day", "tomorrow call Anna about today at {h} pm", "d + 1", _NULL, "call Anna about today at {h} pm", 1), ("W1 same day", "today call Anna today at {h} pm", "d", _PM("h"), "call Anna", 2),
    ("W3 touching", "on {w} at {h} pm call Anna", _ahead("w"), _PM("h"), "call Anna", 1), ("W3 apart", "on {w} call Anna at {h} pm", _ahead("w"), _PM("h"), "call Anna", 2), ("W1 exact", "in {k} minutes call Anna at {h} pm", "d", f"607 + {_NUMBERS['k']}", "call Anna at {h} pm", 1),
    ("D9 near", "dinner with Anna tomorrow at 7", "d + 1", "1140", "dinner with Anna", 1), ("D9 far", "tomorrow at 7 run through the park and down to the river and over the long bridge, then think about dinner", "d + 1", "420", "run through the park and down to the river and over the long bridge, then think about dinner", 1),
]

_W = _ahead("w")
#: (rule, note, [(title, date, minute, reminder)])
CARRIED = [
    ("run day", "On {w} call the bank, buy milk and water the plants", [("Call the bank", _W, _NULL, False), ("Buy milk", _W, _NULL, False), ("Water the plants", _W, _NULL, False)]),
    ("first day", "Call the bank on {w} and buy milk", [("Call the bank", _W, _NULL, False), ("Buy milk", _W, _NULL, False)]), ("no day of a list", "Call the bank on {w}, also buy milk", [("Call the bank", _W, _NULL, False), ("Buy milk", _NULL, _NULL, False)]),
    ("new statement", "Call the bank on {w} and I also need to buy milk", [("Call the bank", _W, _NULL, False), ("Buy milk", _NULL, _NULL, False)]),
    ("heading with a time", "{w} at {h} pm. Call the bank. Buy milk.", [("Call the bank", _W, _PM("h"), True), ("Buy milk", _W, _NULL, False)]), ("heading of a list", "I have two things for {w}. Call the bank. Buy milk.", [("Call the bank", _W, _NULL, False), ("Buy milk", _W, _NULL, False)]),
    ("spoken day", "Call the bank on {w}. Pick up the kids at {h}.", [("Call the bank", _W, _NULL, False), ("Pick up the kids", _W, f"CASE WHEN {_NUMBERS['h']} <= 6 THEN {_PM('h')} ELSE {_AT('h')} END", True)]),
    ("spoken day ended", "Call the bank on {w}. Buy milk. Pick up the kids at {h} pm.", [("Call the bank", _W, _NULL, False), ("Buy milk", _NULL, _NULL, False), ("Pick up the kids", "d", _PM("h"), True)]),
    ("shared reminder", "Remind me at {h} pm to take my pills and to lock the garage", [("Take my pills", "d", _PM("h"), True), ("Lock the garage", "d", _PM("h"), True)]),
    ("somebody's plan", "My sister is coming on {w} at {h} pm, buy a cake", [("Buy a cake", _W, _PM("h"), True)]), ("deadline", "Submit the report by {w} and call Anna", [("Submit the report", _W, _NULL, False), ("Call Anna", _NULL, _NULL, False)]),
    ("counted", "Call the bank in {k} days and buy milk", [("Call the bank", f"d + CAST({_NUMBERS['k']} AS INTEGER)", _NULL, False), ("Buy milk", _NULL, _NULL, False)]),
    ("vague", "I have two things for {w}. Call the bank. At some point fix the door.", [("Call the bank", _W, _NULL, False), ("Fix the door", _NULL, _NULL, False)]),
    ("two days before", "Pay the rent on {w}. Remind me two days before.", [("Pay the rent", f"CASE WHEN {_W} - 2 > d THEN {_W} - 2 ELSE {_W} END", _NULL, True)]), ("event stays", "The exam is on {w}. Remind me the day before.", [("Exam", _W, _NULL, True)]),
    ("afternoon goes on", "Buy milk at {h} p.m. Call Anna at 9.", [("Buy milk", "d", _PM("h"), True), ("Call Anna", "d", "1260", True)]), ("evening heading", "Tonight I have one thing. Call Anna at 9.", [("Call Anna", "d", "1260", True)]),
    ("both", "Call the vet and book a table, both on {w}", [("Call the vet", _W, _NULL, False), ("Book a table", _W, _NULL, False)]), ("waits", "Call the bank on {w}. When the salary comes pay the rent.", [("Call the bank", _W, _NULL, False), ("When the salary comes pay the rent", _NULL, _NULL, False)]),
    ("gone day, its clock", "Call the bank yesterday at {h} pm", [("Call the bank", "d", _PM("h"), True)]),
]

#: (rule, note, [(title, date)])
TOPICS = [
    ("one", "The car, I need to wash it on {w}", [("Wash the car", _W)]), ("many", "The tickets, print them on {w}", [("Print the tickets", _W)]), ("bare", "Milk, buy it tomorrow", [("Buy milk", "d + 1")]),
    ("number refused", "Tickets, print it on {w}", [("Tickets", _NULL), ("Print it", _W)]), ("sentence", "The fence. Fix it on {w}", [("Fix the fence", _W)]), ("no topic", "Call Anna, remind it on {w}", [("Call Anna", _NULL), ("Remind it", _W)]),
]

#: (predicate, clause, kind)
KINDS = [
    ("X1", "Thank you very much", "small talk"), ("X2", "Is the bank open?", "question"), ("X3", "I have {k} tasks", "preamble"), ("X4 others", "my sister is coming on {w}", "others"), ("X4 others", "they are going to visit on {w}", "others"), ("X4 state", "I'm free on {w}", "state"),
    ("X4 narration", "the weather is nice", "narration"), ("X4 narration", "he was angry", "narration"), ("X5 report", "Sardor said the meeting is on {w}", "narration"), ("X5 reason", "because he is busy on {w}", "narration"), ("X5 scene", "it's very crowded today", "narration"),
    ("X10", "remind me {k} days before", "earlier"), ("X11", "remind me on {w}", "remind"), ("X12", "it's at {h} pm", "elaboration"), ("X13", "I called the bank yesterday", "done"), ("X14", "both on {w}", "both"), ("C6", "on {w} at {h} pm", "when"),
    ("C10", "call the bank on {w}", "task"), ("C10", "the phone bill", "task"), ("C10", "dentist on {w}", "task"), ("X4 not mine", "Madina asked me to print it", "task"),
]


def _noted(spark, sf_dir, rows: list[tuple]) -> DataFrame:
    return _said(spark, sf_dir, [r[1] for r in rows], [r[0] for r in rows])


def corrected_notes(spark, sf_dir):
    """Forty corrections, in text."""
    return when.once_each(_noted(spark, sf_dir, CORRECTIONS), ["note"], text=spoken.corrected(F.col("note"))).select("id", "rule", "text")


def when_spans(spark, sf_dir):
    """Notes with several days and times; the day and time of the note, what is left of it and how many stretches were cut."""
    return when.parse_when(_noted(spark, sf_dir, SEVERAL), "note", "now", "w").select("id", "rule", "date", "minute", "rest", F.size("w.spans").alias("spans"))


def carried_days(spark, sf_dir):
    """Every rule by which a clause takes a day or a time from others."""
    return extract.extract_tasks(_noted(spark, sf_dir, CARRIED)).select("id", "rule", "position", "title", "date", "minute", "has_reminder")


def topic_notes(spark, sf_dir):
    """C3, C8: "it" and "them" that speak of the topic before, and refusals."""
    return extract.extract_tasks(_noted(spark, sf_dir, TOPICS)).select("id", "rule", "position", "title", "date")


def clause_kinds(spark, sf_dir):
    """What a clause is."""
    notes = _noted(spark, sf_dir, KINDS)
    today, minute_now = F.to_date("now"), F.hour("now") * 60 + F.minute("now")
    facts = when.once_each(notes, ["note", "now"], f=extract.clause_facts(F.struct(F.lit("").alias("joint"), F.col("note").alias("text")), today, minute_now))
    return facts.select("id", "rule", F.col("f.kind").alias("kind"))


#: (guard, said, normalised)
GUARDS = [
    ("N5 four", "I need to call Anna to buy {k} eggs to wash the car and to pay the rent", "I need to call Anna, to buy {k} eggs, to wash the car and to pay the rent"), ("N5 middle timed", "Remember to call Anna to buy milk on {w} and to pay the rent", "Remember to call Anna, to buy milk on {w} and to pay the rent"),
    ("N5 purpose", "I want to call Anna to ask about {k} tickets and to buy a gift", "I want to call Anna to ask about {k} tickets and to buy a gift"), ("N5 two", "I need to call Anna and to buy {k} eggs", "I need to call Anna and to buy {k} eggs"),
    ("N5 commas", "to go to the bank to pay the bill, to call Anna and to buy {k} eggs", "to go to the bank to pay the bill, to call Anna and to buy {k} eggs"), ("N5 asked", "Remind me to ask Timur to call me at {h} and to send the photos", "Remind me to ask Timur to call me at {h} and to send the photos"),
    ("N4 order", "Called Anna tomorrow at {h}", "call Anna tomorrow at {h}"), ("N4 done", "Called Anna yesterday at {h}", "Called Anna yesterday at {h}"), ("N4 no object", "Called, then left at {h}", "Called, then left at {h}"), ("N4 buy", "By the {k} cakes", "buy the {k} cakes"), ("N4 by the end", "By the end of the week pay {k} bills", "By the end of the week pay {k} bills"),
]

#: Leads that a title loses, however many stand before it.
LEADS = ["so", "okay", "please", "and", "then", "also", "I need to", "remind me to", "don't forget to", "we have to", "I also want to", "maybe"]
#: (form, number in words as SQL text of n) is made of these parts in both engines.
_ONES = ["one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
_TENS = ["", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]


def guarded_notes(spark, sf_dir):
    """Rewrites of transcripts, each with a phrase that passes and one that is refused."""
    return when.once_each(_noted(spark, sf_dir, GUARDS), ["note"], text=spoken.normalise(F.col("note"))).select("id", "rule", "text")


def title_fixed_point(spark, sf_dir):
    """One to twelve leads before a title go in as many rounds as it takes, and a title is its own title."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"))
    leads = F.array_join(F.transform(F.sequence(F.lit(0), (F.col("id") % 12).cast("int")), lambda k: F.element_at(F.array(*(F.lit(x) for x in LEADS)), ((F.col("id") + k * 5) % 12 + 1).cast("int"))), " ")
    said = F.concat(leads, F.lit(" call customer "), (F.col("id") % 900 + 1).cast("string"), F.lit(" , please"))
    titled = when._once(rows.repartition(spark.sparkContext.defaultParallelism), title=spoken.clean_title(said))
    return titled.select("id", "title", (spoken.clean_title(F.col("title")) == F.col("title")).alias("same"))


def _below_hundred(n: Column) -> Column:
    pick = lambda values, k: F.element_at(F.array(*(F.lit(x) for x in values)), k.cast("int"))
    ten = pick(_TENS, F.floor(n / 10) + 1)
    return F.when(n == 0, None).when(n < 20, pick(_ONES, F.greatest(n, F.lit(1)))).when(n % 10 == 0, ten).otherwise(F.concat(ten, F.when(n % 2 == 0, "-").otherwise(" "), pick(_ONES, F.greatest(n % 10, F.lit(1)))))


def spelt_numbers(spark, sf_dir):
    """numbers to 9,999 in words, with and without "and" and hyphens, as digits."""
    n = (F.col("id") % 9999 + 1).cast("int")
    rest = _below_hundred(n % 100)
    high = F.concat_ws(" ", F.when(n >= 1000, F.concat(_below_hundred(F.floor(n / 1000)), F.lit(" thousand"))), F.when(F.floor(n / 100) % 10 > 0, F.concat(_below_hundred(F.floor(n / 100) % 10), F.lit(" hundred"))))
    joint = F.when((high != "") & rest.isNotNull() & (F.col("id") % 3 == 0), "and")
    said = F.concat_ws(" ", F.lit("Order"), F.when(high != "", high), joint, rest, F.lit("of them"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).repartition(spark.sparkContext.defaultParallelism)
    return rows.select("id", F.array_join(numerals.wer_tokens(said), " ").alias("text"))


def spelt_clocks(spark, sf_dir):
    """every minute of the day in six spellings, in one form."""
    m, style = (F.col("id") % 1440).cast("int"), (F.floor(F.col("id") / 7) % 6).cast("int")
    hour, minute = (F.floor(m / 60) + 11) % 12 + 1, m % 60
    half, dotted = F.when(m < 720, "am").otherwise("pm"), F.when(m < 720, "a.m.").otherwise("p.m.")
    digits = lambda mark: F.concat(hour.cast("string"), F.lit(mark), F.lpad(minute.cast("string"), 2, "0"))
    spoken_minute = F.when(minute == 0, F.when(style == 4, "o'clock")).when(minute < 10, F.concat(F.lit("oh "), _below_hundred(minute))).otherwise(_below_hundred(minute))
    words = F.concat_ws(" ", _below_hundred(hour), spoken_minute, half)
    said = F.when(style == 0, F.concat(digits(":"), F.lit(" "), half)).when(style == 2, F.concat(digits("."), half)).when(style == 3, F.concat(digits(""), F.lit(" "), F.upper(half))).when(style == 5, F.concat(digits(":"), F.lit(" "), dotted)).otherwise(words)
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id")).repartition(spark.sparkContext.defaultParallelism)
    return rows.select("id", F.array_join(numerals.wer_tokens(F.concat(F.lit("Call at "), said)), " ").alias("text"))


def _rows_sql(rows: list[tuple], columns: str, shape) -> str:
    parts = [f"SELECT id, {_quoted(rule)} AS rule, CAST({k} AS INTEGER) AS position, {shape(task)} FROM o WHERE kind = {i}" for i, (rule, _, tasks) in enumerate(rows) for k, task in enumerate(tasks, 1)]
    return f"WITH o AS {_FOUND.format(n=len(rows))} SELECT {columns} FROM ({' UNION ALL '.join(parts)})"


def _rule(rows: list[tuple]) -> str:
    return _cases([_quoted(r[0]) for r in rows])


QUERIES = {f.__name__: f for f in (corrected_notes, when_spans, carried_days, topic_notes, clause_kinds, guarded_notes, title_fixed_point, spelt_numbers, spelt_clocks)}
SQL = {
    "corrected_notes": f"SELECT id, {_rule(CORRECTIONS)} AS rule, {_cases([_sql_text(r[2]) for r in CORRECTIONS])} AS text FROM {_FOUND.format(n=len(CORRECTIONS))}",
    "when_spans": f"SELECT id, {_rule(SEVERAL)} AS rule, CAST({_cases([r[2] for r in SEVERAL])} AS DATE) AS date, CAST({_cases([r[3] for r in SEVERAL])} AS INTEGER) AS minute, {_cases([_sql_text(r[4]) for r in SEVERAL])} AS rest, CAST({_cases([str(r[5]) for r in SEVERAL])} AS INTEGER) AS spans FROM {_FOUND.format(n=len(SEVERAL))}",
    "carried_days": _rows_sql(CARRIED, "*", lambda t: f"{_quoted(t[0])} AS title, CAST({t[1]} AS DATE) AS date, CAST({t[2]} AS INTEGER) AS minute, {t[3]} AS has_reminder"),
    "topic_notes": _rows_sql(TOPICS, "*", lambda t: f"{_quoted(t[0])} AS title, CAST({t[1]} AS DATE) AS date"),
    "clause_kinds": f"SELECT id, {_rule(KINDS)} AS rule, {_cases([_quoted(r[2]) for r in KINDS])} AS kind FROM {_FOUND.format(n=len(KINDS))}",
    "guarded_notes": f"SELECT id, {_rule(GUARDS)} AS rule, {_cases([_sql_text(r[2]) for r in GUARDS])} AS text FROM {_FOUND.format(n=len(GUARDS))}",
    "title_fixed_point": "SELECT o_orderkey AS id, 'Call customer ' || (o_orderkey % 900 + 1) AS title, TRUE AS same FROM orders",
    "spelt_numbers": "SELECT o_orderkey AS id, 'order ' || (o_orderkey % 9999 + 1) || ' of them' AS text FROM orders",
    "spelt_clocks": "SELECT id, concat_ws(' ', 'call at', CAST((m // 60 + 11) % 12 + 1 AS VARCHAR), CASE WHEN m % 60 > 0 THEN CAST(m % 60 AS VARCHAR) END, CASE WHEN m < 720 THEN 'am' ELSE 'pm' END) AS text FROM (SELECT o_orderkey AS id, o_orderkey % 1440 AS m FROM orders)",
}
