"""Dates and times in English phrases, by sequences of word classes.

A phrase is cut into tokens.  The lexicon gives every token a class, one letter, and a number, so a
phrase becomes a string of letters, and a rule is a short pattern over that string: ``JW`` is "on Friday".  The first
rule that fits at the first place wins; its value is computed from the numbers of its tokens.
Everything is a column expression, and ``now`` is an argument.
"""

from __future__ import annotations

import functools
import re
import zlib
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import civil
from .text import fold_temporal_case

# Words of the grammar.
WEEKDAYS = "monday tuesday wednesday thursday friday saturday sunday".split()
SHORT_WEEKDAYS = {"mon": 1, "tue": 2, "tues": 2, "wed": 3, "weds": 3, "thu": 4, "thur": 4, "thurs": 4, "fri": 5, "sat": 6, "sun": 7}
MONTHS = "january february march april may june july august september october november december".split()
NUMBERS = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()
#: Month names that are words of other meanings too.
DOUBTFUL_MONTHS = {"march", "may", "august"}
#: Nouns that make an ordinal, or a part of the day before them, no date.
COUNTED = "edition floor place row try attempt version chapter section page item anniversary person lesson lessons class period lecture grade round stage level street avenue lane entrance gate door block building house shift term semester course episode season part step draft question task".split()
# Prepositions that tie a part of the day to a thing.
PREPOSITIONS = "about after at before by during for from in into of on till to until with".split()
#: Verbs that move a thing from one day to another.
MOVES = "move moving moved reschedule rescheduling rescheduled change changing changed shift shifting push pushing postpone postponing postponed".split()
#: Things people do in the evening.
EVENING_EVENTS = "dinner concert drinks party movie cinema theatre theater opera gig show supper date nightclub bar pub"


def _lexicon() -> dict[str, str]:
    """Word -> class letter and number."""
    out: dict[str, str] = {}

    def put(letter: str, words: str | list[str], number: int | str = "") -> None:
        for w in words.split() if isinstance(words, str) else words:
            out[w] = f"{letter}{number}"

    for i, w in enumerate(WEEKDAYS, 1):
        put("W", [w, f"{w}s"], i)
    for w, i in SHORT_WEEKDAYS.items():
        put("w", w, i)
    for i, w in enumerate(MONTHS, 1):
        put("m", w[:3], i)
        put("m" if w in DOUBTFUL_MONTHS else "M", w, i)
    put("m", "sept", 9)
    for i, w in enumerate(NUMBERS, 1):
        put("N", w, i)
    put("N", "couple", 2)
    put("N", "few", 3)
    for w, i in (("twenty", 20), ("thirty", 30), ("forty", 40), ("fifty", 50)):
        put("5", w, i)
        for k, unit in enumerate(ORDINALS[:9], 1):
            put("O", f"{w}-{unit}", i + k)
    for i, w in enumerate(ORDINALS, 1):
        put("O", w, i)
    put("O", "thirtieth", 30)
    put("e", "a an", 1)
    for w in ("morning", "afternoon", "evening"):
        put("P", w, civil.PART_MINUTES[w])
    put("8", "night", civil.PART_MINUTES["night"])
    for w in ("noon", "midday", "midnight"):
        put("K", w, civil.PART_MINUTES[w])
    put("H", "half", 30)
    put("Q", "quarter", 15)
    for words, n in (("minutes minute min mins minute's minutes'", 1), ("hours hour hr hrs hour's hours'", 60), ("days day's days'", 1440), ("weeks week's weeks'", 10080), ("months month's", 43200), ("years year year's", 525600)):
        put("U", words, n)
    put("y", "day", 1440)
    put("u", "week", 10080)
    put("r", "month", 43200)
    for letter, words in {
        "D": "today", "R": "tomorrow", "Y": "yesterday", "G": "tonight", "X": "next", "L": "last previous", "S": "this", "C": "coming upcoming", "E": "the", "F": "of", "I": "in", "A": "at @",
        "B": "by before until till til", "J": "on", "V": "around about like approximately roughly maybe another just exactly", "Z": "after", "p": "past", "6": "to", "g": "from since", "b": "between",
        "c": "and", "k": "o'clock oclock", "h": "weekend weekends", "j": "for due starting", "T": "time", "l": "or", "s": "later sooner earlier less more so", "1": "end", "3": "every each", "4": COUNTED,
        "~": "ok okay well oh please also anyway yeah yes then", ",": ",", ".": ". ; : ! ?",
    }.items():
        put(letter, words)
    put("v", MOVES)
    put("a", "am a.m a.m.", 0)
    put("a", "pm p.m p.m.", 720)
    return out


TOKEN = (
    r"(\s*(?:\d{4}-\d{1,2}-\d{1,2}\b|\d{1,2}/\d{1,2}(?:/\d{2,4})?\b|\d{1,2}:\d{2}\b|\d{1,3}\.\d{1,2}(?![\d.])|\d+(?:st|nd|rd|th)\b|\d+"
    r"|(?i:[ap]\.\s?m\b\.?)|[\p{L}\p{M}]+(?:['-][\p{L}\p{M}]+)*'?|\S))"
)


def tokens(text: Column) -> Column:
    """The tokens of a text, each with the blanks before it; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(1))


def words(found: Column) -> Column:
    return F.transform(found, lambda t: fold_temporal_case(F.trim(t)))


SHELVES = 64


def _shelves(known: dict[str, str]) -> Column:
    """A map that is dealt over an array by a hash of its keys, since Spark looks through a map key by key."""
    rows: list[list[str]] = [[] for _ in range(SHELVES)]
    quoted = lambda x: "'" + x.replace("'", "\\'") + "'"
    for word, value in known.items():
        rows[zlib.crc32(word.encode()) % SHELVES] += [quoted(word), quoted(value)]
    # One expression in text: a call for each of a thousand literals would take seconds.
    return F.expr("array(" + ", ".join(f"map({', '.join(row or [quoted(''), quoted('')])})" for row in rows) + ")")


def codes(found: Column) -> Column:
    """Class letter and number of each word."""
    shelves = _shelves(_lexicon())
    part = lambda w, k: F.split_part(w, F.lit(":"), F.lit(k)).try_cast("int")
    point = lambda w, k: F.rpad(F.split_part(w, F.lit("."), F.lit(k)), k, "0").try_cast("int")

    def code(w: Column) -> Column:
        number = (
            F.when(w.rlike(r"^\d{1,2}$"), F.concat(F.lit("d"), w))
            .when(w.rlike(r"^\d{3,4}$"), F.concat(F.lit("q"), w))
            .when(w.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$"), F.concat(F.lit("t"), (part(w, 1) * 60 + part(w, 2)).cast("string")))
            .when(w.rlike(r"^([01]?\d|2[0-3])\.[0-5]\d?$"), F.concat(F.lit("f"), (F.split_part(w, F.lit("."), F.lit(1)).try_cast("int") * 60 + point(w, 2)).cast("string")))
            .when(w.rlike(r"^\d{1,2}(?:st|nd|rd|th)$"), F.concat(F.lit("o"), F.regexp_extract(w, r"^(\d+)", 1)))
            .when(w.rlike(r"^\d{4}-"), F.lit("i")).when(w.contains("/"), F.lit("x")).otherwise(F.lit("n"))
        )
        return F.coalesce(F.try_element_at(F.get(shelves, (F.crc32(w) % SHELVES).cast("int")), w), F.when(w.rlike(r"^\d"), number).otherwise(F.lit("_")))

    return F.transform(found, code)


def classes(coded: Column) -> Column:
    return F.array_join(F.transform(coded, lambda c: F.substring(c, 1, 1)), "")


def numbers(coded: Column) -> Column:
    return F.transform(coded, lambda c: F.when(F.length(c) > 1, F.substring(c, 2, 10).cast("int")))


@dataclass
class Match:
    """A stretch of classes, and the numbers and words of its tokens."""

    m: Column
    v: Column
    w: Column

    def at(self, letters: str) -> Column:
        """The number of the first token of these classes, or null."""
        return F.get(self.v, F.regexp_instr(self.m, F.lit(f"[{letters}]")) - 1)

    def has(self, letters: str) -> Column:
        return self.m.rlike(f"[{letters}]")

    def word(self, letters: str) -> Column:
        return F.get(self.w, F.regexp_instr(self.m, F.lit(f"[{letters}]")) - 1)

    def ordinal(self) -> Column:
        """The day of month that is named: 5, 5th, fifth, twenty fifth."""
        return F.coalesce(self.at("od"), self.at("O") + F.coalesce(self.at("5"), F.lit(0)))


_LEAD = "(?:3|[JBj]E?)?"
_WHICH = "(?:SC|EC|[SCXLp])?"
_PART = "[P8]?"
_AMOUNT = "(?:e?NF?|5N?|e|d|q)"
_IN = "[IZ]V?"
_DAY = "(?:o|d|5?O)"
_NO_COUNT = "(?![4yurUT])"
_ENDS = "(?=$|[.,ABIZVgc])"


def _date_atoms(x: Match) -> dict[str, Column]:
    """What the tokens of a date say."""
    return {
        "target": x.at("Ww"), "part": x.at("P8"), "month": x.at("Mm"), "dom": x.ordinal(), "year": x.at("q"), "unit": x.at("Uyur"),
        "amount": F.coalesce(x.at("dq"), F.coalesce(x.at("5"), F.lit(0)) + x.at("N"), x.at("5"), x.at("e")), "hours": F.coalesce(x.at("d"), x.at("N"), F.lit(1)), "point": x.word("f"), "slash": x.word("x"), "iso": x.word("i"),
    }


def _date_values(m: Column, today: Column, c) -> dict[str, Column]:
    """Dates that the atoms name, whichever rule fits; ``c`` gives an atom by its name."""
    first = F.trunc(today, "month")
    # A weekday and a day of the month: the month, this one or the next, in which they agree.
    of_month = lambda k: F.date_add(F.add_months(first, k), c("dom") - 1)
    agreed = lambda k: F.when((c("dom") <= F.day(F.last_day(F.add_months(first, k)))) & (civil.iso_weekday(of_month(k)) == c("target")), of_month(k))
    slash = lambda k: F.split_part(c("slash"), F.lit("/"), F.lit(k)).try_cast("int")
    month, dom, year = F.coalesce(c("month"), slash(1)), F.coalesce(c("dom"), slash(2)), F.coalesce(c("year"), slash(3))
    return {
        "named": F.when(month.isNull(), None).when(year.isNull(), civil.yearless_date(today, month, dom)).otherwise(civil.exact_date(civil.full_year(year), month, dom)),
        "nth": civil.day_of_month_on_or_after(today, c("dom")),
        "fits": F.coalesce(F.when(agreed(0) >= today, agreed(0)), agreed(1)),
        "weekday": F.when(m.contains("X"), civil.next_week_weekday(today, c("target"))).when(m.rlike("[Lp]"), civil.last_weekday(today, c("target"))).otherwise(civil.forward_weekday(today, c("target"), m.contains("S"))),
        "minutes": F.when(m.contains("f"), F.round(c("point").try_cast("double") * 60).cast("int")).when(m.contains("H"), F.when(m.rlike("^[IZ]V?(?:HeU|eHU)"), 30).otherwise(c("hours") * 60 + 30)).otherwise(c("amount") * c("unit")).cast("long"),
        "days": F.when(c("unit") == 1440, F.date_add(today, c("amount"))).when(c("unit") == 10080, F.date_add(today, c("amount") * 7)).when(c("unit") == 43200, F.add_months(today, c("amount"))).when(c("unit") == 525600, F.add_months(today, c("amount") * 12)),
    }


def date_rules(m: Column, today: Column, minute_now: Column, c=F.col) -> list[tuple[str, str, Column, Column | None, Column | bool]]:
    """(name, pattern, date, implied minute, low confidence) of each rule; what is longer at one place comes first.

    Values are made of ``_date_atoms`` and ``_date_values``, which ``c`` gives by name.
    """
    day = lambda n: F.date_add(today, n)
    part, first = c("part"), F.trunc(today, "month")
    next_week = lambda target: civil.next_week_weekday(today, target)
    soon, at = day(F.floor((minute_now + c("minutes")) / 1440).cast("int")), F.pmod(minute_now + c("minutes"), F.lit(1440)).cast("int")
    weekend = F.when(m.contains("X"), next_week(F.lit(6))).otherwise(civil.forward_weekday(today, F.lit(6), True))
    alone = F.when(F.month(today) == c("month"), today).otherwise(F.make_date(F.year(today) + F.when(c("month") < F.month(today), 1).otherwise(0), c("month"), F.lit(1)))
    return [
        ("weekday_month_day", f"{_LEAD}{_WHICH}[Ww]{_PART},?[JE]*[Mm]E?{_DAY}(?:,?q)?", c("named"), part, False),
        ("weekday_day_month", f"{_LEAD}{_WHICH}[Ww]{_PART},?[JE]*{_DAY}F?[Mm](?:,?q)?", c("named"), part, False),
        ("weekday_nth", f"{_LEAD}{_WHICH}W,?J?E?(?:o|5?O{_ENDS}){_NO_COUNT}", F.coalesce(c("fits"), c("nth")), None, c("fits").isNull()),
        ("next_week_weekday", f"{_LEAD}(?:Xu,?[JI]?W{_PART}|W{_PART}F?Xu)", next_week(c("target")), part, False),
        ("weekday", f"(?:{_LEAD}{_WHICH}W|(?:[JBjIAgV]{_WHICH}|SC|[SCXLp])w){_PART}", c("weekday"), part, False),
        ("after_tomorrow", "[JBj]?E?yZR", day(2), None, False),
        ("before_yesterday", "E?yBY", day(-2), None, False),
        ("tomorrow", f"[JBj]?R{_PART}", day(1), part, False),
        ("today", f"[JBj]?s?D{_PART}", day(0), part, False),
        ("tonight", "[Bj]?G", day(0), F.lit(1200), False),
        ("last_night", "L8", day(-1), F.lit(1200), False),
        ("yesterday", f"[g]?Y{_PART}", day(-1), part, False),
        ("this_part", "S[P8]", day(0), part, False),
        ("weekend", "[JBjA]?(?:SC|EC|[ESXC])h", weekend, None, True),
        ("month_end", "[JBjA]?E?(?:1|Ly)F[ESX]?r", F.last_day(F.add_months(first, F.when(m.contains("X"), 1).otherwise(0))), None, False),
        ("next_week", "[JBj]?Xu", next_week(F.lit(1)), None, True),
        ("next_month", "[JBjI]?Xr", F.add_months(first, 1), None, True),
        ("half_hour", f"{_IN}(?:HeU|eHU)", soon, at, False),
        ("hour_and_half", f"{_IN}(?:eUceH|[Nd]ceHU)T?", soon, at, False),
        ("decimal_hours", f"{_IN}fU", soon, at, False),
        ("in_amount", f"{_IN}{_AMOUNT}[Uyur]T?(?:ls)?", F.when(c("amount").between(1, 999), F.coalesce(c("days"), soon)), F.when(c("days").isNull(), at), False),
        ("iso", "[JBj]?i", F.try_to_date(c("iso"), "yyyy-M-d"), None, False),
        ("slash", "[JBj]?x", c("named"), None, False),
        ("month_day", f"{_LEAD}[Mm]E?{_DAY}(?:,?q)?", c("named"), None, False),
        ("day_month", f"{_LEAD}E?{_DAY}F?[Mm](?:,?q)?", c("named"), None, False),
        ("the_nth", f"{_LEAD}Eo{_NO_COUNT}", c("nth"), None, False),
        ("on_nth", f"[JBj]o{_NO_COUNT}", c("nth"), None, False),
        ("on_the_nth_word", f"[JBj]E5?O{_NO_COUNT}", c("nth"), None, False),
        ("month", "[IJBjXS][Mm]", alone, None, True),
    ]


_CLOCK = "(?:t|f|d|N(?:5N?|N)?)"
_AT = "(?:[ABJg]V?|V)?"
_IN_PART = "(?:IE[P8]|A8)"
_THEN = "(?=$|[.,#cIJA])"


def _clock_atoms(x: Match) -> dict[str, Column]:
    """What the tokens of a time say: minutes of the clock words as written, the meridiem, the part of the day, and the last number."""
    place = F.regexp_instr(x.m, F.lit("[tfdNq]"))
    token, after = F.substring(x.m, place, F.lit(1)), F.substring(x.m, place + 1, F.lit(2))
    number = F.get(x.v, place - 1)
    more = F.when((token == "N") & after.rlike("^5N"), F.get(x.v, place) + F.get(x.v, place + 1)).when((token == "N") & after.rlike("^[5N]"), F.get(x.v, place)).otherwise(0)
    return {
        "total": F.when(token.isin("t", "f"), number).when(token == "q", F.floor(number / 100) * 60 + number % 100).otherwise(number * 60 + more).cast("int"),
        "zero": F.coalesce(x.word("tfq").startswith("0"), F.lit(False)), "meridiem": x.at("a"), "own_part": x.at("P8"), "named": x.at("K"), "number": x.at("dqN"),
        "last": F.get(x.v, F.length(F.regexp_extract(x.m, "^(.*[dN])", 1)) - 1), "shift": F.coalesce(x.at("QH"), x.at("d"), F.coalesce(x.at("5"), F.lit(0)) + F.coalesce(x.at("N"), F.lit(0))),
    }


def _clock_values(m: Column, c) -> dict[str, Column]:
    """The hour that a clock means: ``hour`` of the clock words, or of the last number in "quarter past three"."""
    part = F.coalesce(c("own_part"), c("said"))
    name = F.when(part == 540, "morning").when(part == 840, "afternoon").when(part == 1080, "evening").when(part == 1200, "night")
    far = m.rlike("[p6ZB][dN](?:a|IE[P8]|A8)?$") & m.rlike("[QHdN5U][p6ZB]")
    written = F.when(far, c("last")).otherwise(F.floor(c("total") / 60)).cast("int")
    late = c("evening") & written.between(7, 10) & ~c("zero")
    meant = F.when(c("meridiem").isNotNull(), civil.hour_with_meridiem(written, c("meridiem") == 720)).when(name.isNotNull(), civil.hour_in_part(written, name)).when(late, written + 12).otherwise(civil.hour_without_meridiem(written, c("zero")))
    return {"written": written, "meant": meant.cast("int")}


def time_rules(m: Column, c=F.col) -> list[tuple[str, str, Column]]:
    """(name, pattern, minute of day) of each rule, of which the first that fits counts; values are made of ``_clock_atoms`` and ``_clock_values``."""
    clock = F.when(c("written") < 24, c("meant") * 60 + c("total") % 60)
    half_day = F.when(c("written") <= 12, clock)
    # "between 11 and 1 pm" begins in the morning.
    begin = F.when(c("meridiem").isNotNull() & (c("last") < c("written")) & (c("written") < 12), c("total")).otherwise(clock)
    apart = F.pmod(c("meant") * 60 + F.when(m.rlike("[pZ]"), c("shift")).otherwise(-c("shift")), F.lit(1440))
    return [
        ("between", "b(?:t|d|N)c(?:t|d|N)a?(?:IE[P8])?", begin),
        ("part_clock", f"{_IN_PART},?[AVB]+{_CLOCK}a?", clock),
        ("clock_part", f"{_AT}{_CLOCK}{_IN_PART}", clock),
        ("apart", f"(?:(?:[AB]V?)?(?:e?Q|H)|[AB]V?(?:d|N|5N?)U?)[p6ZB][dN](?:a|{_IN_PART})?", F.when(c("last") <= 12, apart)),
        ("meridiem", f"{_AT}{_CLOCK}a", half_day),
        ("compact", "(?:[AB]V?)?qa", F.when(c("number") % 100 < 60, half_day)),
        ("number_noon", "(?:[AB]V?)?[dN]K", F.when(c("written") == 12, c("named"))),
        ("oclock", "(?:[AB]V?)?[dN]k", clock),
        ("colon", "[ABVg]*t", clock),
        ("point", "(?:[ABVg]+|(?<=#))f", clock),
        ("military", "AV?q", F.when((c("number") < 2400) & (c("number") % 100 < 60), c("total"))),
        ("at_hour", "AV?d(?!U)", clock),
        ("at_word", "AV?N(?:5N?|N)?(?!U)", clock),
        ("by_hour", f"BV?(?:d|N){_THEN}", clock),
        ("by_first", "(?<=^|[~c,.l])BV?(?:d|N)(?!U)", clock),
        ("noon", "(?:[ABI]E?V?)?K", c("named")),
        ("part", "(?:IE[P8]|A8|(?<=#)[P8])(?!4)", c("own_part")),
    ]


def _first_rule(m: Column, rules: list, value) -> Column:
    out = None
    for rule in rules:
        test, x = m.rlike(f"^(?:{re.sub(r'[(][?]<=[^)]*[)]', '', rule[1])})$"), value(rule)
        out = F.when(test, x) if out is None else out.when(test, x)
    return out


def _once(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns that are computed once: a generator keeps the optimizer from copying large expressions to each use.

    They are evaluated in a lambda: generated code for them would be a method too large for the JVM to compile.
    """
    packed = F.struct(*(c.alias(n) for n, c in columns.items()))
    return df.select("*", F.explode(F.transform(F.array(F.lit(0)), lambda _: packed)).alias("__x")).select("*", *(F.col(f"__x.{n}").alias(n) for n in columns)).drop("__x")


def once_each(df: DataFrame, by: list[str], before=None, **columns: Column) -> DataFrame:
    """The last of ``columns``, worked on once for each different value of the columns ``by``, which it depends on alone, and joined to the rows.

    A column may use the ones before it; ``before`` may add some to the different values in its own way.
    Spoken notes repeat, and a note costs milliseconds where a join costs microseconds.  Few values are broadcast, and many meet their rows in a
    sort-merge join, whose skewed partitions are split.  The input is read twice; if it then gives values that it did not give before (a limit without an order), the job fails and no row is lost.
    """
    keys, last = [f"__by{i}" for i in range(len(by))], list(columns)[-1]
    # Few bytes are much work: values are dealt evenly to more tasks than cores.
    tasks = 4 * max(df.sparkSession.sparkContext.defaultParallelism, 2)
    done = df.select(*by).distinct().repartition(tasks)
    done = before(done) if before else done
    for name, column in columns.items():
        done = _once(done, **{name: column})
    done = done.select(*(F.col(name).alias(key) for name, key in zip(by, keys)), F.struct(last).alias("__met"))
    same = reduce(Column.__and__, (F.col(name).eqNullSafe(F.col(key)) for name, key in zip(by, keys)))
    met = F.when(F.col("__met").isNotNull(), F.col("__met").getField(last)).otherwise(F.raise_error(F.lit("the input changes when it is read again")))
    return df.join(done, same, "left").select(*df.columns, met.alias(last))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def let_all(values: dict[str, Column], body) -> Column:
    """``body`` of a function that gives the named values, each computed once."""
    return let(F.struct(*(v.alias(n) for n, v in values.items())), lambda x: body(_fields(x)))


def _fields(x: Column):
    """The fields of a struct by name, each named to Spark once."""
    return functools.cache(x.getField)


SPAN = "struct<start: int, m: string>"
DATE = "struct<start: int, size: int, rule: string, date: date, part: int, low: boolean, exact: boolean>"
TIME = "struct<start: int, size: int, rule: string, minute: int, part: int>"


def spans_of(line: Column, rules: list) -> Column:
    """All stretches of a class string that any rule fits, left to right, none over another: start (from 1) and classes."""
    any_ = "|".join(f"(?:{r[1]})" for r in rules)
    pieces = F.split(F.regexp_replace(line, f"({any_})", "\x01$1\x02"), "[\x01\x02]")
    blank = F.struct(F.lit(1).alias("at"), F.array().cast(f"array<{SPAN}>").alias("found"), F.lit(False).alias("inside"))

    def step(acc: Column, piece: Column) -> Column:
        span = F.struct(acc["at"].alias("start"), piece.alias("m"))
        return F.struct((acc["at"] + F.length(piece)).alias("at"), F.when(acc["inside"] & (piece != ""), F.array_append(acc["found"], span)).otherwise(acc["found"]).alias("found"), (~acc["inside"]).alias("inside"))

    return F.aggregate(pieces, blank, step, lambda acc: acc["found"])


def _dates(line: Column, numbers_: Column, words_: Column, today: Column, minute_now: Column) -> Column:
    """All dates of a text with their places; stretches that name no day of the calendar are left out."""

    def value(span: Column) -> Column:
        m = span["m"]
        cut = lambda a: F.slice(a, span["start"], F.length(m))

        def rule(atom) -> Column:
            return let_all(_date_values(m, today, atom), lambda val: decide(lambda n: atom(n) if n in _ATOMS else val(n)))

        def decide(c) -> Column:
            rules = date_rules(m, today, minute_now, c)
            one = lambda r: F.struct(F.lit(r[0]).alias("rule"), r[2].cast("date").alias("date"), (r[3] if r[3] is not None else F.lit(None)).cast("int").alias("part"), F.coalesce(r[4] if isinstance(r[4], Column) else F.lit(r[4]), F.lit(False)).alias("low"))
            return let(_first_rule(m, rules, one), lambda d: F.struct(
                span["start"].cast("int").alias("start"), F.length(m).cast("int").alias("size"), d["rule"].alias("rule"), d["date"].alias("date"), d["part"].alias("part"), d["low"].alias("low"),
                F.coalesce(d["rule"].isin("half_hour", "hour_and_half", "decimal_hours", "in_amount") & d["part"].isNotNull(), F.lit(False)).alias("exact")))

        return let(F.struct(cut(numbers_).alias("v"), cut(words_).alias("w")), lambda x: let_all(_date_atoms(Match(m, x["v"], x["w"])), rule))

    rules = date_rules(F.lit(""), today, minute_now, lambda n: F.lit(None))
    return F.filter(F.transform(spans_of(line, rules), value), lambda d: d["date"].isNotNull())


_ATOMS = {"target", "part", "month", "dom", "year", "unit", "amount", "hours", "point", "slash", "iso"}
_CLOCK_ATOMS = {"total", "zero", "meridiem", "own_part", "named", "number", "last", "shift", "said", "evening"}


def _hidden(line: Column, spans: Column) -> Column:
    """The class string with the tokens of all spans as "#"."""
    return F.aggregate(spans, line, lambda out, d: F.overlay(out, F.repeat(F.lit("#"), d["size"]), d["start"], d["size"]))


def _times(line: Column, numbers_: Column, words_: Column, dates: Column, evening) -> Column:
    """All times outside the dates.  A clock is read in the part of the day that is said with the date next to it, or with the first date."""

    def value(span: Column) -> Column:
        m, start = span["m"], span["start"]
        cut = lambda a: F.slice(a, start, F.length(m))
        beside = F.filter(dates, lambda d: ~d["exact"] & ((d["start"] + d["size"] == start) | (start + F.length(m) == d["start"])))
        said = F.coalesce(F.get(F.transform(F.filter(beside, lambda d: d["part"].isNotNull()), lambda d: d["part"]), F.lit(0)), F.get(F.transform(F.slice(dates, 1, 1), lambda d: F.when(~d["exact"], d["part"])), F.lit(0)))

        def rule(atom) -> Column:
            return let_all(_clock_values(m, atom), lambda val: decide(lambda n: atom(n) if n in _CLOCK_ATOMS else val(n)))

        def decide(c) -> Column:
            one = lambda r: F.struct(F.lit(r[0]).alias("rule"), r[2].cast("int").alias("minute"))
            return let(_first_rule(m, time_rules(m, c), one), lambda t: F.struct(start.cast("int").alias("start"), F.length(m).cast("int").alias("size"), t["rule"].alias("rule"), t["minute"].alias("minute"), F.when(t["rule"] == "part", c("own_part")).cast("int").alias("part")))

        return let(F.struct(cut(numbers_).alias("v"), cut(words_).alias("w")), lambda x: let_all(_clock_atoms(Match(m, x["v"], x["w"])) | {"said": said, "evening": evening(start, F.length(m))}, rule))

    rules = time_rules(F.lit(""), lambda n: F.lit(None))
    return F.filter(F.transform(spans_of(_hidden(line, dates), rules), value), lambda t: t["minute"].isNotNull())


def _moved_until(line: Column, dates: Column) -> Column:
    """The last token of "move it from Friday to Monday" and of a time right after it; 0 without.  Both days belong to the thing that is moved."""
    marked = _hidden(line, dates)
    found = F.regexp_extract(marked, "^(.*?v[^.,]{0,20}(?:g#|#)#*6#+)", 1)
    return F.when(found.rlike("g#+6#+$") | found.rlike("v[^.,#]*#+6#+$"), F.length(found)).otherwise(0)


def scan_when(text: Column, today: Column, minute_now: Column) -> Column:
    """All that a text says of days and times: struct of ``tokens``, ``line`` (their classes), ``dates`` and ``times``, each with its place.

    Dates and times of a thing that is moved from one day to another are left out.
    """
    lower = F.lower(text)
    events = rf"\b(?:{'|'.join(EVENING_EVENTS.split())})\b"

    def evening(found: Column):
        # An evening event within sixty characters of the time.
        def near(start: Column, size: Column) -> Column:
            before = F.right(F.array_join(F.slice(found, 1, F.greatest(start - 1, F.lit(0)).cast("int")), ""), F.lit(60))
            after = F.left(F.array_join(F.slice(found, (start + size).cast("int"), F.size(found) + 1), ""), F.lit(60))
            return F.lower(before).rlike(events) | F.lower(after).rlike(events)

        return lambda start, size: F.when(lower.rlike(events), near(start, size)).otherwise(False)

    def classed(found: Column) -> Column:
        return let(F.struct(words(found).alias("w")), lambda x: let(F.struct(codes(x["w"]).alias("c"), x["w"].alias("w")), lambda y: let(F.struct(classes(y["c"]).alias("line"), numbers(y["c"]).alias("v"), y["w"].alias("w")), lambda z: dated(found, z))))

    def dated(found: Column, z: Column) -> Column:
        return let(_dates(z["line"], z["v"], z["w"], today, minute_now), lambda d: let(F.when(F.size(d) >= 2, _moved_until(z["line"], d)).otherwise(0), lambda end: timed(found, z, d, end)))

    def timed(found: Column, z: Column, d: Column, end: Column) -> Column:
        times = _times(z["line"], z["v"], z["w"], d, evening(found))
        own = lambda x: x["start"] > end + F.when(end > 0, 1).otherwise(0)
        return F.struct(found.alias("tokens"), z["line"].alias("line"), F.filter(d, own).alias("dates"), F.filter(times, own).alias("times"))

    return let(tokens(text), classed)


def read_when(text: Column, today: Column, minute_now: Column) -> Column:
    """What a text means: struct of ``tokens``, ``line``, ``date`` and ``minute`` (as said; null for none), ``said_date``, ``low``, ``exact``, ``spans`` and the two rules.

    The first date and the first time outside it count.  A time that is said together with another day is that day's: it is
    left out, unless the other day is the same.  A part of the day and a clock that are said apart are one time, unless a
    preposition ties the part to a thing.  Spans that touch are one.
    """
    return let(scan_when(text, today, minute_now), _resolved)


def _beside(line: Column, a: Column, b: Column) -> Column:
    """Only commas stand between two places, or nothing."""
    first = F.when(a["start"] <= b["start"], a["start"] + a["size"]).otherwise(b["start"] + b["size"])
    last = F.greatest(a["start"], b["start"])
    return F.substring(line, first, last - first).rlike("^,*$")


def _resolved(x: Column) -> Column:
    line, dates, times = x["line"], x["dates"], x["times"]
    day = F.get(dates, F.lit(0))
    parts = F.filter(times, lambda t: t["part"].isNotNull())
    clocks = F.filter(times, lambda t: t["part"].isNull())
    part = F.when(F.size(parts) == 1, F.get(parts, F.lit(0)))
    clock = F.get(clocks, F.lit(0))

    def chosen(c) -> Column:
        part, clock, day = c("part"), c("clock"), c("day")
        # "at 9 buy flowers for the party in the evening": the part is the party's.
        between = F.substring(line, clock["start"] + clock["size"], part["start"] - clock["start"] - clock["size"])
        things = (part["start"] > clock["start"]) & (F.length(between) > 0) & F.array_join(F.transform(F.slice(x["tokens"], clock["start"] + clock["size"], F.greatest(part["start"] - clock["start"] - clock["size"], F.lit(0)).cast("int")), F.trim), " ").rlike(rf"(?i)\b(?:{'|'.join(PREPOSITIONS)})\b")
        paired = F.coalesce(part.isNotNull() & clock.isNotNull() & ~things, F.lit(False))
        name = F.when(part["part"] == 540, "morning").when(part["part"] == 840, "afternoon").when(part["part"] == 1080, "evening").when(part["part"] == 1200, "night")
        first = F.when(paired | F.coalesce(things, F.lit(False)), clock).otherwise(F.get(times, F.lit(0)))
        return let_all({"time": first, "paired": paired, "name": name, "part": part, "day": day}, owned)

    def owned(c) -> Column:
        time, day = c("time"), c("day")
        others = F.filter(F.slice(dates, F.lit(2), F.size(dates) + 1), lambda d: _beside(line, d, time))
        other = F.when(day.isNotNull() & time.isNotNull() & ~c("paired") & ~_beside(line, day, time), F.get(others, F.lit(0)))
        return let_all({"time": time, "paired": c("paired"), "name": c("name"), "part": c("part"), "day": day, "other": other}, decided)

    def decided(c) -> Column:
        day, other = c("day"), c("other")
        same = F.coalesce(other.isNotNull() & ~day["exact"] & (other["date"] == day["date"]), F.lit(False))
        time = F.when(other.isNull() | same, c("time"))
        time = F.when(F.coalesce(day["exact"], F.lit(False)), None).otherwise(time)
        return let_all({"time": time, "paired": c("paired"), "name": c("name"), "part": c("part"), "day": day, "same": F.when(same, other)}, told)

    def told(c) -> Column:
        time, day, same = c("time"), c("day"), c("same")
        hour = F.floor(time["minute"] / 60).cast("int")
        bare = F.when(hour > 12, hour - 12).otherwise(hour)
        minute = F.when(c("paired") & ~time["rule"].isin("meridiem", "compact", "noon", "number_noon"), civil.hour_in_part(bare, c("name")) * 60 + time["minute"] % 60).otherwise(time["minute"])
        found = F.filter(F.array(day_span(day), day_span(same), day_span(time), F.when(c("paired"), day_span(c("part")))), lambda s: s.isNotNull())
        said = F.coalesce(same["part"], day["part"])
        return F.struct(
            x["tokens"].alias("tokens"), line.alias("line"), day["date"].alias("date"), F.coalesce(minute.cast("int"), day["part"]).alias("minute"), F.when(time.isNotNull(), said).alias("said_part"),
            day.isNotNull().alias("said_date"), F.coalesce(day["low"], F.lit(False)).alias("low"), F.coalesce(day["exact"], F.lit(False)).alias("exact"), joined_spans(found).alias("spans"), day["rule"].alias("date_rule"), time["rule"].alias("time_rule"), day["part"].alias("day_part"),
        )

    return let_all({"part": part, "clock": clock, "day": day}, chosen)


def day_span(x: Column) -> Column:
    return F.when(x.isNotNull(), F.struct(x["start"].cast("int").alias("start"), x["size"].cast("int").alias("size")))


def joined_spans(spans: Column) -> Column:
    """Spans by start; those that touch or overlap are one."""
    kind = "array<struct<start: int, size: int>>"

    def step(out: Column, s: Column) -> Column:
        last = F.get(out, F.size(out) - 1)
        end = F.greatest(last["start"] + last["size"], s["start"] + s["size"])
        both = F.struct(last["start"].alias("start"), (end - last["start"]).cast("int").alias("size"))
        touch = (F.size(out) > 0) & (s["start"] <= last["start"] + last["size"])
        return F.when(touch, F.array_append(F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0))), both)).otherwise(F.array_append(out, s))

    return F.aggregate(F.array_sort(spans), F.array().cast(kind), step)


def small_hours(date: Column, minute: Column, said: Column) -> Column:
    """Tonight at 2 is the next day's 02:00."""
    return F.when((said == 1200) & (minute < 300), F.date_add(date, 1)).otherwise(date)


def rolled(date: Column, minute: Column, today: Column, minute_now: Column) -> Column:
    """The date; without one, a time that is over today is tomorrow's."""
    return F.coalesce(date, F.when(minute.isNotNull(), F.date_add(today, F.when(minute <= minute_now, 1).otherwise(0))))


def is_over(date: Column, minute: Column, today: Column, minute_now: Column) -> Column:
    """A past day, or today at an earlier minute."""
    return (date < today) | ((date == today) & F.coalesce(minute < minute_now, F.lit(False)))


def cut_spans(found: Column, spans: Column) -> Column:
    """The text of the tokens outside the spans (first token from 1, and length)."""
    return F.array_join(F.filter(found, lambda _, i: ~F.exists(spans, lambda s: (i + 1 >= s["start"]) & (i + 1 < s["start"] + s["size"]))), "")


def parse_when(df: DataFrame, text_col: str = "text", now_col: str = "now", read_col: str | None = None) -> DataFrame:
    """``df`` with ``date``, ``minute``, ``rest`` (the text without them), ``confidence`` and the rules that fitted.

    The first date and the first time outside it are combined: the clock is read in the part of the day that is
    said with the date, small hours of a night belong to the next day, and a bare time that is over rolls to tomorrow.
    ``read_col`` names a column for all that ``read_when`` gives.
    """
    today, minute_now = F.col("__today"), F.col("__minute_now")
    rows = df.withColumns({"__today": F.to_date(now_col), "__minute_now": F.hour(now_col) * 60 + F.minute(now_col)})
    out = once_each(rows, [text_col, "__today", "__minute_now"], __w=read_when(F.col(text_col), today, minute_now))
    w = F.col("__w")
    date = rolled(small_hours(w["date"], w["minute"], w["said_part"]), w["minute"], today, minute_now)
    shown = {"date_rule": w["date_rule"], "time_rule": w["time_rule"], "minute": w["minute"], "date": date, "rest": F.trim(cut_spans(w["tokens"], w["spans"])), "confidence": F.when(w["low"], "low").otherwise("high")}
    return out.withColumns(shown | ({read_col: w} if read_col else {})).drop("__w", "__today", "__minute_now")
