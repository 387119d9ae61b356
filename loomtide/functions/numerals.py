"""Numbers and times of day in words, folded to digits by a left-to-right automaton."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .when import let

# Words of numbers.
ONES = "one two three four five six seven eight nine".split()
TEENS = "ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
ORDINAL_ONES = "first second third fourth fifth sixth seventh eighth ninth".split()
ORDINAL_TEENS = "tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth".split()
ORDINAL_TENS = "twentieth thirtieth fortieth fiftieth sixtieth seventieth eightieth ninetieth".split()

#: What a number word is: after a number of scale n only a word of a smaller scale goes on with it.
ZERO, ONE, TEEN, TEN, HUNDRED, THOUSAND = range(1, 7)
#: Spellings of one thing: money, the halves of the day, clock times with and without minutes, thousands, ordinals in digits, hyphens.
_SPELT = [
    (r"[’‘`´]", "'"), (r"\$\s?(\d[\d,]*(?:\.\d+)?)", " $1 dollars "), (r"\b([ap])\.?\s?m\b\.?", "$1m"), (r"(\d)(?=[ap]m\b)", "$1 "), (r"\b(\d{1,2})([0-5]\d)(?=\s[ap]m\b)", "$1:$2"), (r"(\d),(?=\d{3}\b)", "$1"),
    (r"\b(\d{1,2})[:.]00\b", "$1"), (r"\b(\d{1,2})[:.]0?(\d{1,2})\b", "$1 $2"), (r"\b(\d+)(?:st|nd|rd|th)\b", "$1"), (r"\bo'?\s?clock\b", " "), (r"(?<=[a-z])-(?=[a-z])", " "), (r"[^a-z0-9':\s]+", " "),
]


def _known() -> Column:
    """Number word -> "scale:value"; ordinals end a number and have the scale of their cardinal below 0."""
    rows = {"zero": (ZERO, 0), "hundred": (HUNDRED, 100), "thousand": (THOUSAND, 1000)}
    for scale, first, step, plain, ordinal in ((ONE, 1, 1, ONES, ORDINAL_ONES), (TEEN, 10, 1, TEENS, ORDINAL_TEENS), (TEN, 20, 10, TENS, ORDINAL_TENS)):
        for k, (a, b) in enumerate(zip(plain, ordinal)):
            rows[a], rows[b] = (scale, first + k * step), (-scale, first + k * step)
    return F.expr("map(" + ", ".join(f"'{w}', named_struct('scale', {s}, 'value', {v})" for w, (s, v) in rows.items()) + ")")


def fold_numbers(words: Column) -> Column:
    """Words with every number in words as digits: "two thousand and five" is 2005, "twenty first" 21, "seven oh five" 7 and 5, "three thirty" 3 and 30."""
    blank = F.struct(F.array().cast("array<string>").alias("out"), F.lit(0).alias("total"), F.lit(0).alias("part"), F.lit(0).alias("scale"), F.lit("").alias("held"))

    def state(out, total, part, scale, held) -> Column:
        return F.struct(out.alias("out"), total.cast("int").alias("total"), part.cast("int").alias("part"), scale.cast("int").alias("scale"), held.alias("held"))

    def flushed(acc: Column) -> Column:
        number = F.when(acc["scale"] > 0, F.array_append(acc["out"], (acc["total"] + acc["part"]).cast("string"))).otherwise(acc["out"])
        return F.when(acc["held"] != "", F.array_append(number, acc["held"])).otherwise(number)

    zero, empty = F.lit(0), F.lit("")

    def step(acc: Column, word: Column) -> Column:
        def read(x: Column) -> Column:
            scale, value, known = F.abs(x["k"]["scale"]), x["k"]["value"], x["k"].isNotNull()
            ends = x["k"]["scale"] < 0
            now = acc["scale"]
            # "oh" before one digit is a nought of the minutes.
            minutes = (acc["held"] == "oh") & (scale == ONE)
            number = F.when(now > 0, F.array_append(acc["out"], (acc["total"] + acc["part"]).cast("string"))).otherwise(acc["out"])
            goes_on = (((now == TEN) & (scale == ONE)) | (now.isin(HUNDRED, THOUSAND) & scale.isin(ONE, TEEN, TEN))) & ((acc["held"] == "") | ((acc["held"] == "and") & (now >= HUNDRED)))
            counts = now.isin(ONE, TEEN, TEN) & (acc["part"] < 100) & (acc["held"] == "")
            after = lambda out, total, part, s: F.when(ends, state(F.array_append(out, (total + part).cast("string")), zero, zero, zero, empty)).otherwise(state(out, total, part, s, empty))
            return (
                F.when(~known & (word == "and") & (now >= HUNDRED) & (acc["held"] == ""), state(acc["out"], acc["total"], acc["part"], now, F.lit("and")))
                .when(~known & (word == "oh") & now.isin(ONE, TEEN) & (acc["held"] == ""), state(acc["out"], acc["total"], acc["part"], now, F.lit("oh")))
                .when(~known, state(F.array_append(flushed(acc), word), zero, zero, zero, empty))
                .when((scale == HUNDRED) & counts, state(acc["out"], acc["total"], acc["part"] * 100, F.lit(HUNDRED), empty))
                .when((scale == THOUSAND) & (now > 0) & (now < THOUSAND) & (acc["total"] == 0) & (acc["held"] == ""), state(acc["out"], acc["part"] * 1000, zero, F.lit(THOUSAND), empty))
                .when(minutes, after(number, zero, value, scale))
                .when(goes_on, after(acc["out"], acc["total"], acc["part"] + value, scale))
                .otherwise(after(flushed(acc), zero, value, scale))
            )

        return F.get(F.transform(F.array(F.struct(F.try_element_at(_known(), word).alias("k"))), read), F.lit(0))

    # Words without any of a number stay as they are: "and" and "oh" mean something only after one.
    spelt = F.array(*(F.lit(w) for w in ["zero", "hundred", "thousand", *ONES, *TEENS, *TENS, *ORDINAL_ONES, *ORDINAL_TEENS, *ORDINAL_TENS]))
    return F.when(~F.arrays_overlap(words, spelt), words).otherwise(F.aggregate(words, blank, step, flushed))


def wer_tokens(text: Column) -> Column:
    """Words for counting errors: lower case without punctuation, and one form for every spelling of a number or a time of day; null has none.

    "3 PM", "3 p.m.", "3pm" and "three pm" are 3 and pm, "7:05" and "seven oh five" 7 and 5, "3:00" and "three o'clock" 3, "21st" and "twenty-first" 21.
    """
    out = F.lower(F.coalesce(text, F.lit("")))
    for pattern, to in _SPELT:
        out = F.regexp_replace(out, pattern, to)
    return let(F.filter(F.split(out, r"\s+"), lambda w: w != ""), fold_numbers)
