"""Notes to dated tasks: every clause as a struct of facts, and one ordered fold over the clauses of a note.

Everything is column expressions over one row; nothing is shuffled, and a note is worked on whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gram, when
from ..functions import notes as spoken
from ..functions.lexicon import any_of
from ..functions.text import normalise_title
from ..functions.when import let, let_all

MAX_TASKS = 20
RESULT = ["position", "title", "date", "minute", "has_reminder", "confidence"]
TASK = "struct<title: string, date: date, minute: int, reminder: boolean, low: boolean, todo: boolean, due: boolean>"


def note_clauses(notes: DataFrame, note_col: str = "note") -> DataFrame:
    """One row per clause of a note: the note's columns, ``position``, ``joint`` and ``clause``.

    A null or empty note has no clause.
    """
    kept = [c for c in notes.columns if c.lower() not in ("position", "joint", "clause")]
    said = notes.where(F.length(F.trim(note_col)) > 0).withColumn("__said", F.col(note_col).cast("string"))
    parts = when.once_each(said, ["__said"], __clauses=clauses_of(F.col("__said")))
    return parts.select(*kept, F.posexplode("__clauses").alias("position", "part")).select(*kept, "position", "part.joint", F.col("part.text").alias("clause"))


def clauses_of(note: Column) -> Column:
    """The clauses of a note in spoken order, topics filled in: structs of ``joint`` and ``text``."""
    return let(spoken.clauses(spoken.corrected(spoken.normalise(note))), spoken.filled_topics)


# ── Facts of a clause ────────────────────────────────────────────────────────────────────────────

_MERIDIEM = r"(?i)\d\s*[ap]\.?\s?m\b|\b[ap]\.m\b"
_COUNTS = {"two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7}
_UNITS = ["day", "days", "evening", "night", "week", "weeks"]
_EARLIER = rf"\b(?:{any_of(['the', 'a', 'one', *_COUNTS])}|\d)\s+{any_of(_UNITS)}\s+(?:{any_of(['ahead', 'before', 'earlier'])}|in\s+advance)\b(?!\s+{any_of(spoken.DETERMINERS)}\b)"
# Going somewhere or being at something.
TRIPS = "attend come drive fly go head meet ride travel visit walk".split()
#: A task waits for this, on a day that nobody said: somebody acts, a thing is done, the pay comes.
_ACTS = "approve approves arrive arrives bring brings call calls come comes confirm confirms deliver delivers land lands pay pays reply replies return returns send sends sign signs write writes".split()
_ENDS = "approved back delivered done finished fixed free here paid ready repaired sent signed".split()
_PAY = ["bonus", "pay day", "paycheck", "payday", "pension", "salary"]
_AWAITS = (
    rf"(?<!\b{any_of('ask check decide know remember see wonder'.split())}\s)\b(?:{any_of('after once till until when whenever'.split())}|as\s+soon\s+as)\s+(?!{any_of('i we you that this then'.split())}\b)(?:{any_of(spoken.DETERMINERS)}\s+)?[a-z']+\s*"
    rf"(?:\s{any_of(_ACTS)}|(?:'s|'re|\s(?:is|are|gets?))\s+{any_of(_ENDS)})\b|\b{any_of('after before once until when'.split())}\s+(?:(?:the|my|next)\s+)?{any_of(_PAY)}\b"
)


def clause_facts(part: Column, today: Column, minute_now: Column) -> Column:
    """What one clause says: its kind, its own day and minute as said, its title without them, and how it passes on a day."""

    def read(w: Column) -> Column:
        found = F.transform(w["tokens"], lambda t: F.lower(F.trim(t)))
        return let_all({"w": w, "words": found, "off": gram.vague_span(found)}, cut)

    def cut(c) -> Column:
        w, off = c("w"), c("off")
        spans = F.when(off.isNull(), w["spans"]).otherwise(when.joined_spans(F.array_append(w["spans"], F.struct(off["start"].cast("int").alias("start"), off["size"].cast("int").alias("size")))))
        first = F.get(w["spans"], F.lit(0))["start"]
        last = F.element_at(F.when(F.size(w["spans"]) > 0, w["spans"]).otherwise(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("size")))), -1)
        date = when.small_hours(w["date"], w["minute"], w["said_part"])
        letters = gram.grammar(c("words"))
        text = F.lower(part["text"])
        earlier = F.regexp_substr(text, F.lit(_EARLIER))
        return let_all(
            {
                "w": w, "rest": F.trim(when.cut_spans(w["tokens"], w["spans"])), "title_text": when.cut_spans(w["tokens"], spans), "date": date, "first": first, "last": last["start"] + last["size"], "letters": letters, "text": text,
                "vague": off.isNotNull(), "earlier": earlier, "words": c("words"), "joint": part["joint"],
            },
            judged,
        )

    def judged(c) -> Column:
        w, text, first = c("w"), c("text"), c("first")
        dated = w["said_date"] | w["minute"].isNotNull()
        over = F.coalesce(when.is_over(c("date"), w["minute"], today, minute_now), F.lit(False))
        lead = F.substring(w["line"], F.lit(1), first - 1)
        fronted = F.coalesce(first.isNotNull() & lead.rlike("^[~cls,.O3j]*$"), F.lit(False))
        opening = F.lower(F.trim(F.get(w["tokens"], first - 1)))
        before = F.get(c("words"), first - 2)
        deadline = F.coalesce(opening.isin("by", "before", "until", "till", "due") | before.isin("by", "before", "until", "till", "due"), F.lit(False))
        asked = F.exists(c("words"), lambda x: x.isin("remind", "reminder", "alarm", "alert", "nudge")) | text.rlike(r"\bdon't\s+(?:let\s+me\s+)?forget\b")
        told, to = F.array_position(c("words"), "remind"), F.array_position(c("words"), "to")
        days = F.when(c("earlier").isNotNull(), F.when(c("earlier").contains("week"), 7).otherwise(1) * F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in _COUNTS.items() for x in kv)), F.split_part(c("earlier"), F.lit(" "), F.lit(1))), F.split_part(c("earlier"), F.lit(" "), F.lit(1)).try_cast("int"), F.lit(1)))
        # "the day before at 9" tells of a reminder; its words are no title.
        title_text = F.when(c("earlier").isNotNull() & asked, F.regexp_replace(c("title_text"), f"(?i){_EARLIER}", "")).otherwise(c("title_text"))
        return let_all({"kind": kind_of(text, c("rest"), c("letters"), dated, over, c("earlier"), asked), "title": normalise_title(spoken.clean_title(title_text))}, lambda k: F.struct(
            c("joint").alias("joint"), k("kind").alias("kind"), k("title").alias("title"), F.when(k("title") == "", normalise_title(spoken.clean_title(part["text"]))).alias("whole"), c("date").alias("date"), w["minute"].alias("minute"), w["said_date"].alias("said_date"), w["low"].alias("low"),
            (w["exact"] | F.coalesce(w["date_rule"] == "in_amount", F.lit(False))).alias("counted"), c("vague").alias("vague"), asked.alias("asked"), fronted.alias("fronted"), deadline.alias("deadline"), text.rlike(r"[.!?]\s*$").alias("ends"),
            text.rlike(_AWAITS).alias("awaits"), (text.rlike(_MERIDIEM)).alias("meridiem"), text.rlike(r"\b(?:tonight|evening|night)\b").alias("evening"), c("letters").rlike("^[cf,.]*P").alias("statement"), text.rlike(r"^\W*(?:and\W+)?oh\b").alias("afterthought"),
            c("letters").rlike("^[cf,.]*t[Vv]").alias("infinitive"), F.coalesce((told > 0) & (first > told) & (to >= c("last")), F.lit(False)).alias("shares"), days.cast("int").alias("days"), spoken.first_verb(c("rest")).alias("verb"),
            (~spoken.opens_with_verb(c("rest")) & fronted & c("rest").rlike(r"^[\s,]*(?:the|my|our|his|her)\s") & ~F.lower(c("rest")).rlike(rf"\b(?:{'|'.join(spoken.EVENTS)})\b")).alias("gapped"),
            (text.rlike(r"\b(?:due|deadline)\b")).alias("due"), text.rlike(spoken.THING).alias("thing"), text.rlike(rf"\b(?:both|(?:both|all|each)\s+of\s+th\w+),?\s+{spoken.WHEN}").alias("shared_day")))

    return let(when.read_when(part["text"], today, minute_now), read)


def kind_of(text: Column, rest: Column, letters: Column, dated: Column, over: Column, earlier: Column, asked: Column) -> Column:
    """What a clause is, by the first test that holds; its dates are cut from ``rest``."""
    bare = F.lower(rest)
    alone = bare.rlike(r"^\W*(?:(?:and|so|then|or|on|at|by|in|the|of|for|from)\b\W*){0,12}$")
    past, asked_me = text.rlike(spoken.DONE_BEFORE), text.rlike(r"\basked\s+me\s+to\b")
    return (
        F.when(past & over, "done")
        .when(text.rlike(spoken.DONE) & (over | ~dated | text.rlike(spoken.ALREADY)), "done")
        .when(text.rlike(spoken.QUESTION) & ~dated, "question")
        .when(alone & dated, "when")
        .when(bare.rlike(spoken.PREAMBLE), "preamble")
        .when(bare.rlike(spoken.SMALL_TALK), "small talk")
        .when(earlier.isNotNull() & asked, "earlier")
        .when(bare.rlike(spoken.REMIND_ONLY), "remind")
        .when(bare.rlike(spoken.BOTH) & dated, "both")
        .when(text.rlike(spoken.ELABORATION) & dated, "elaboration")
        .when(letters.rlike(gram.OTHERS), "others")
        .when(letters.rlike(gram.STATE), "state")
        .when(text.rlike(r"^\W*because\b"), "narration")
        .when(text.rlike(r"^\W*(?:(?:so|okay|ok|um|ooh|well|and)\W+){0,4}(?:today|yesterday)\s+(?:is|was)\b") | (letters.rlike(gram.SCENE) & text.rlike(r"\btoday\b")), "narration")
        .when(letters.rlike(gram.REPORT) & ~asked_me, "narration")
        .when(letters.rlike(gram.NARRATION) & (~dated | over) & ~asked_me, "narration")
        .otherwise("task")
    )


# ── The fold ─────────────────────────────────────────────────────────────────────────────────────

#: What is carried from clause to clause.  Of ``header_*``: a heading's day, and its time for the one task after it; ``spoken``: the day
#: that is talked about; ``run_*``: a day that led its clause, and the time of somebody's plan; ``first_day``: the day of the sentence's first
#: task; ``pm_*``: the last time after noon; ``shared_*``: a "remind me at 7 to ... and to ..."; ``sent``: tasks before this sentence.
STATE = {
    "tasks": f"array<{TASK}>", "sent": "int", "header_date": "date", "header_minute": "int", "header_day": "date", "header_asked": "boolean", "evening": "boolean", "spoken": "date", "run_date": "date", "run_minute": "int",
    "first_day": "date", "pm_minute": "int", "pm_date": "date", "shared": "boolean", "shared_date": "date", "shared_minute": "int", "verb": "string", "ended": "boolean",
}


def _state(values: dict[str, Column]) -> Column:
    return F.struct(*(values[n].cast(t).alias(n) for n, t in STATE.items()))


def fold_tasks(facts: Column, today: Column, minute_now: Column, max_tasks: int) -> Column:
    """The tasks of a note from the facts of its clauses in spoken order: an array of structs.

    A clause without a day of its own takes, by the first that applies: the shared "remind me at 7 to A and to B", the time of the heading right
    before it, nothing if it is vague, only a heading's day if it waits for something, the day of the sentence's first task if it follows it, and the day that led its
    sentence or else the heading's.  A time without a day takes the day that is talked about, a heading's, or that of the last time after noon, unless that is over.
    A sentence's end clears what its own clauses carried; an undated sentence ends the day that is talked about.
    """
    blank = _state({n: F.array() if n == "tasks" else F.lit(0) if n == "sent" else F.lit(False) if t == "boolean" else F.lit("") if n == "verb" else F.lit(None) for n, t in STATE.items()})
    null, no, yes = F.lit(None), F.lit(False), F.lit(True)
    over = lambda d, m: F.coalesce(when.is_over(d, m, today, minute_now), no)

    def with_last(tasks: Column, **changes: Column) -> Column:
        last = F.get(tasks, F.size(tasks) - 1)
        new = F.struct(*(changes.get(f.split(":")[0].strip(), last[f.split(":")[0].strip()]).cast(f.split(":")[1].strip()).alias(f.split(":")[0].strip()) for f in TASK[7:-1].split(",")))
        return F.when(F.size(tasks) > 0, F.array_append(F.slice(tasks, F.lit(1), F.greatest(F.size(tasks) - 1, F.lit(0))), new)).otherwise(tasks)

    def step(old: Column, at: Column) -> Column:
        c, after, n = F.get(facts, at), F.get(facts, at + 1), F.size(facts)
        fresh = old["ended"]
        follows = c["joint"].isin("and", "then", "..") & ~c["afterthought"]
        begin = {k: old[k] for k in STATE}
        begin |= {k: F.when(~fresh, old[k]) for k in ("run_date", "run_minute")}
        begin |= {"shared": old["shared"] & ~fresh, "sent": F.when(fresh, F.size(old["tasks"])).otherwise(old["sent"]), "first_day": F.when(follows, old["first_day"]), "verb": F.when(fresh, "").otherwise(old["verb"]), "ended": c["ends"]}
        return let_all({"s": _state(begin), "c": c, "after": after, "last": at == n - 1, "follows": follows}, lambda x: F.when(F.size(x("s")["tasks"]) >= max_tasks, x("s")).otherwise(decided(x)))

    def decided(x) -> Column:
        s, c, after = x("s"), x("c"), x("after")
        keep = {k: s[k] for k in STATE}
        put = lambda **k: _state(keep | k)
        tasks, begun = s["tasks"], F.size(s["tasks"]) > s["sent"]
        last = F.get(tasks, F.size(tasks) - 1)
        open_time = c["minute"].isNotNull() & last["date"].isNotNull() & last["minute"].isNull() & ~c["said_date"] & ~over(last["date"], c["minute"])
        timed = F.when(F.coalesce(open_time, no), with_last(tasks, minute=c["minute"], reminder=yes)).otherwise(tasks)
        own_day_next = F.coalesce(after["said_date"] & (after["date"] != c["date"]), no)
        passes = ~x("last") & ~c["ends"]
        frames = passes & ~(c["minute"].isNotNull() & own_day_next)
        # A reminder or a detail of time for the task before it fills what that lacks.
        none = last["date"].isNull() & last["minute"].isNull()
        rolled = when.rolled(c["date"], c["minute"], today, minute_now)
        filled = with_last(
            tasks, date=F.when(none & (c["said_date"] | c["minute"].isNotNull()), rolled).otherwise(last["date"]), low=F.when(none, c["low"]).otherwise(last["low"]),
            minute=F.when(last["minute"].isNull() & c["minute"].isNotNull() & (none | ~c["said_date"] | (c["date"] == last["date"])), c["minute"]).otherwise(last["minute"]), reminder=last["reminder"] | c["asked"] | c["minute"].isNotNull(),
        )
        day = F.date_sub(last["date"], c["days"])
        to_do = F.coalesce(last["todo"] & ~last["due"] & last["date"].isNotNull() & last["minute"].isNull() & ~over(day, F.coalesce(c["minute"], F.lit(540))), no)
        sooner = with_last(tasks, reminder=yes, date=F.when(to_do, day).otherwise(last["date"]), minute=F.when(to_do, c["minute"]).otherwise(last["minute"]))
        both = F.transform(tasks, lambda t, i: F.when((i >= s["sent"]) & t["date"].isNull() & t["minute"].isNull(), F.struct(t["title"].alias("title"), c["date"].alias("date"), c["minute"].alias("minute"), (t["reminder"] | c["minute"].isNotNull()).alias("reminder"), t["low"].alias("low"), t["todo"].alias("todo"), t["due"].alias("due"))).otherwise(t))
        heading = put(header_date=F.when(c["said_date"], c["date"]).otherwise(s["header_date"]), header_minute=c["minute"], header_day=rolled, header_asked=c["asked"], evening=c["evening"])
        lead = put(spoken=F.when(c["said_date"], c["date"]).otherwise(s["spoken"]), run_date=F.when(c["said_date"], c["date"]).otherwise(s["run_date"]), run_minute=c["minute"])
        kind = c["kind"]
        # "the flight is at 6" tells of a trip, a meeting or an event, not of the shirt to iron before it.
        title = F.lower(last["title"])
        attends = F.coalesce(title.rlike(rf"^(?:{any_of(TRIPS)}\b|{any_of(['bring', 'take'])}\b.*\bto\b)") | (~last["todo"] & title.rlike(rf"^(?:[\w']+\s+){{0,2}}(?:{'|'.join(spoken.EVENTS)})\b")), no)
        no_tasks = F.size(tasks) == 0
        return (
            F.when(kind.isin("done", "question", "narration", "small talk"), s)
            .when(kind == "preamble", F.when(c["said_date"], put(header_date=c["date"], evening=c["evening"])).otherwise(s))
            .when((kind == "others") & ~c["said_date"] & c["minute"].isNull(), s)
            .when((kind == "others") & begun, put(tasks=timed))
            .when((kind == "others") & frames, lead)
            .when(kind == "state", F.when(c["said_date"] & ~c["low"] & passes & ~own_day_next, put(spoken=c["date"], run_date=c["date"])).otherwise(s))
            .when((kind == "elaboration") & begun & (~c["thing"] | c["due"] | attends), put(tasks=filled))
            .when((kind == "remind") & ~no_tasks, put(tasks=filled))
            .when((kind == "earlier") & no_tasks & (c["title"] == ""), s)
            .when((kind == "earlier") & (c["title"] == ""), put(tasks=sooner))
            .when((kind == "when") & ~x("last") & (after["kind"].isin("task", "when", "earlier", "state") | (after["kind"].isin("others", "elaboration") & (after["said_date"] | after["minute"].isNotNull()))), heading)
            .when((kind == "when") & ~no_tasks, put(tasks=filled))
            .when((kind == "both") & begun, put(tasks=both))
            .when(kind == "remind", heading)
            .otherwise(added(x, keep))
        )

    def added(x, keep: dict) -> Column:
        s, c = x("s"), x("c")
        tasks = s["tasks"]
        begun = F.size(tasks) > s["sent"]
        last = F.get(tasks, F.size(tasks) - 1)
        nothing = ~c["said_date"] & c["minute"].isNull()
        earlier = (c["kind"] == "earlier") & last["date"].isNotNull() & ~c["said_date"]
        context = F.coalesce(s["spoken"], s["header_date"], s["pm_date"])
        late = F.coalesce((s["pm_minute"].isNotNull() & (c["minute"] + 720 > s["pm_minute"])) | s["evening"], no)
        clock = F.when((c["minute"] < 720) & late & ~c["meridiem"], c["minute"] + 720).otherwise(c["minute"])
        in_context = F.coalesce(~c["said_date"] & c["minute"].isNotNull() & context.isNotNull() & ~over(context, clock), no)
        from_shared = nothing & s["shared"] & c["infinitive"]
        from_header = nothing & ~from_shared & s["header_minute"].isNotNull()
        quiet = nothing & ~from_shared & ~from_header
        from_first = quiet & ~c["vague"] & ~c["awaits"] & s["first_day"].isNotNull() & x("follows") & ((c["joint"] != "and") | ~c["statement"])
        from_run = quiet & ~c["vague"] & ~c["awaits"] & ~from_first
        date = (
            F.when(earlier, F.greatest(F.date_sub(last["date"], c["days"]), today))
            .when(c["said_date"], c["date"]).when(in_context, context).when(~nothing, when.rolled(c["date"], c["minute"], today, minute_now)).when(from_shared, s["shared_date"])
            .when(from_header, F.coalesce(s["header_date"], s["header_day"])).when(c["vague"], null).when(c["awaits"], F.when(s["run_date"].isNull(), s["header_date"])).when(from_first, s["first_day"]).otherwise(F.coalesce(s["run_date"], s["header_date"]))
        )
        minute = F.when(in_context, clock).when(~nothing, c["minute"]).when(from_shared, s["shared_minute"]).when(from_header, s["header_minute"]).when(from_run, s["run_minute"])
        return let_all({"date": date, "minute": minute, "answers": F.coalesce(s["run_minute"].isNotNull() & (date == s["run_date"]), no), "given": from_shared | from_header | earlier}, lambda y: settled(x, y, keep, nothing, begun, last))

    def settled(x, y, keep: dict, nothing: Column, begun: Column, last: Column) -> Column:
        s, c = x("s"), x("c")
        minute = F.coalesce(y("minute"), F.when(y("answers"), s["run_minute"]))
        # A day already gone names the thing; its clock counts the next time it comes round.
        gone = F.coalesce(y("date") < today, no)
        date = F.when(gone, F.when(minute.isNotNull(), F.date_add(today, F.when(minute < minute_now, 1).otherwise(0)))).otherwise(y("date"))
        gap = c["gapped"] & (s["verb"] != "") & c["joint"].isin(",", "and", "then")
        title = F.when(gap, F.concat(F.initcap(s["verb"]), F.lit(" "), F.lower(F.substring(c["title"], 1, 1)), F.substring(c["title"], F.lit(2), F.length(c["title"])))).when(c["title"] == "", c["whole"]).otherwise(c["title"])
        return let_all({"title": title, "date": date, "minute": minute, "reminder": c["minute"].isNotNull() | c["asked"] | y("given") | minute.isNotNull() | (s["header_asked"] & s["header_minute"].isNotNull())}, lambda t: appended(x, t, keep, nothing, begun, last))

    def appended(x, t, keep: dict, nothing: Column, begun: Column, last: Column) -> Column:
        s, c = x("s"), x("c")
        tasks = s["tasks"]
        lower = F.lower(t("title"))
        todo = c["verb"] != ""
        new = F.struct(t("title").alias("title"), t("date").cast("date").alias("date"), t("minute").cast("int").alias("minute"), F.coalesce(t("reminder"), no).alias("reminder"), (c["low"] & c["said_date"]).alias("low"), todo.alias("todo"), c["due"].alias("due"))
        known = F.exists(tasks, lambda k: (F.lower(k["title"]) == lower) & k["date"].eqNullSafe(t("date")) & k["minute"].eqNullSafe(t("minute")))
        again = F.coalesce(begun & (F.lower(last["title"]) == lower), no)
        plain = t("date").isNull() & t("minute").isNull()
        replaces = again & last["date"].isNull() & last["minute"].isNull()
        skip = (F.length(t("title")) <= 1) | known | (again & ~replaces & plain)
        base = F.when(replaces, F.slice(tasks, F.lit(1), F.greatest(F.size(tasks) - 1, F.lit(0)))).otherwise(tasks)
        spread = F.transform(base, lambda k, i: F.when(c["shared_day"] & c["said_date"] & (i >= s["sent"]) & k["date"].isNull() & k["minute"].isNull(), F.struct(k["title"].alias("title"), t("date").cast("date").alias("date"), t("minute").cast("int").alias("minute"), k["reminder"].alias("reminder"), k["low"].alias("low"), k["todo"].alias("todo"), k["due"].alias("due"))).otherwise(k))
        steady = c["said_date"] & ~c["low"] & ~c["deadline"] & ~c["counted"]
        first_task = F.size(tasks) == s["sent"]
        pm = t("minute") >= 720
        spoken_day = F.when(c["said_date"], F.when(~c["deadline"] & ~c["low"], c["date"])).when(plain & c["ends"], null).otherwise(s["spoken"])
        used = nothing & s["header_minute"].isNotNull()
        return F.when(skip, _state(keep | {"spoken": spoken_day})).otherwise(
            _state(keep | {
                "tasks": F.array_append(spread, new), "spoken": spoken_day, "header_minute": F.when(~used, s["header_minute"]), "header_asked": s["header_asked"] & ~used, "run_minute": null,
                "pm_minute": F.when(t("minute").isNull(), s["pm_minute"]).when(pm, t("minute")), "pm_date": F.when(t("minute").isNull(), s["pm_date"]).when(pm, t("date")),
                "first_day": F.when(first_task & steady, t("date")).when(nothing & ~c["vague"], s["first_day"]),
                "run_date": F.when(c["vague"], null).when(c["said_date"], F.when(c["fronted"] & steady, c["date"])).otherwise(s["run_date"]),
                "shared": F.when(c["asked"], c["shares"]).otherwise(s["shared"]), "shared_date": F.when(c["asked"], t("date")).otherwise(s["shared_date"]), "shared_minute": F.when(c["asked"], t("minute")).otherwise(s["shared_minute"]),
                "verb": F.when(todo, c["verb"]).otherwise(s["verb"]),
            })
        )

    return F.aggregate(F.when(F.size(facts) > 0, F.sequence(F.lit(0), F.size(facts) - 1)).otherwise(F.array().cast("array<int>")), blank, step, lambda s: s["tasks"])


def _folded(notes: DataFrame, now_col: str, note_col: str, max_tasks: int) -> DataFrame:
    """``notes`` with ``__tasks``: clauses are found once for each different note, tasks once for each different note, day and minute."""
    now = F.col(now_col).cast("timestamp_ntz")
    rows = notes.withColumns({"__said": F.coalesce(F.col(note_col).cast("string"), F.lit("")), "__today": F.to_date(now), "__minute_now": F.hour(now) * 60 + F.minute(now)})
    today, minute_now = F.col("__today"), F.col("__minute_now")
    facts = F.transform("__clauses", lambda part: clause_facts(part, today, minute_now))
    tasks = fold_tasks(F.col("__facts"), today, minute_now, max_tasks)
    split = lambda values: when.once_each(values, ["__said"], __clauses=clauses_of(F.col("__said")))
    return when.once_each(rows, ["__said", "__today", "__minute_now"], split, __facts=facts, __tasks=tasks).drop("__said", "__today", "__minute_now")


def _shown(rows: DataFrame, keep: list[str]) -> DataFrame:
    t = F.col("__t")
    return rows.select(*keep, (F.col("__nth") + 1).cast("int").alias("position"), t["title"].alias("title"), t["date"].alias("date"), t["minute"].alias("minute"), t["reminder"].alias("has_reminder"), F.when(t["low"], "low").otherwise("high").alias("confidence"))


def extract_tasks(notes: DataFrame, now_col: str = "now", note_col: str = "note", max_tasks: int = MAX_TASKS) -> DataFrame:
    """Rows of the input's columns with ``position``, ``title``, ``date``, ``minute``, ``has_reminder``, ``confidence``.

    ``now`` is a TIMESTAMP_NTZ column.  A note is repaired and cut into clauses; each task clause gives a title without its date and time,
    and what it does not say itself comes from the clauses before it (``fold_tasks``).

    Null, empty and small-talk notes give no row; at most ``max_tasks`` tasks come from a note, in spoken order, and a task
    said twice counts once.  Notes of any length are read whole.  Rows that repeat stay apart.  Columns of the input that are named as results give way to them.
    """
    keep = [c for c in notes.columns if c.lower() not in RESULT]
    rows = _folded(notes, now_col, note_col, max_tasks)
    return _shown(rows.select(*keep, F.posexplode("__tasks").alias("__nth", "__t")), keep)


def drafts(notes: DataFrame, now_col: str = "now", note_col: str = "note") -> DataFrame:
    """``extract_tasks``, and one row that holds the whole note for each note without a task; notes without text give none.

    ``low_confidence_date`` marks dates that are a guess.  A note and its tasks are one row until the end, so none can be lost or doubled.
    """
    keep = [c for c in notes.columns if c.lower() not in RESULT]
    whole = normalise_title(F.coalesce(F.col(note_col).cast("string"), F.lit("")))
    alone = F.struct(whole.alias("title"), F.lit(None).cast("date").alias("date"), F.lit(None).cast("int").alias("minute"), F.lit(False).alias("reminder"), F.lit(False).alias("low"), F.lit(False).alias("todo"), F.lit(False).alias("due"))
    rows = _folded(notes, now_col, note_col, MAX_TASKS)
    all_ = F.when(F.size("__tasks") > 0, F.col("__tasks")).when(F.length(whole) > 0, F.array(alone)).otherwise(F.array().cast(f"array<{TASK}>"))
    out = _shown(rows.select(*keep, F.posexplode(all_).alias("__nth", "__t")), keep)
    return out.withColumn("low_confidence_date", (F.col("confidence") == "low") & F.col("date").isNotNull())
