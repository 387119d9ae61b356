"""Self-corrections of a speaker, by aligning what comes after a signal with what it takes back.

"At 4 call the bank, no wait, at 4.30": the words after the signal and a stretch before it have the same word classes, so the
later stretch takes the place of the earlier one, wherever that stood.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .when import classes, codes, let, tokens, words

#: How a speaker takes something back.  The last group says it only of days, times and things of the same kind.
SIGNALS = (
    r"no,?\s+wait(?:,?\s+no)?|wait,?\s+no|no,?\s+no|no,?\s+sorry|sorry,?\s+no|sorry|no,?\s+i\s+mean|i\s+mean(?:t)?|or\s+rather|no,?\s+actually|actually,?\s+no"
    r"|actually|no,?\s+make\s+(?:it|that)|make\s+(?:it|that)|no"
)
_FILLED = r"(?:um+|uh+|er|erm|hmm+)"
SIGNAL = rf"(?i)\s*[,.;-]?\s*(?<![\w'])(?:{_FILLED},?\s+)?(?:{SIGNALS})(?![\w'])(?:,?\s+{_FILLED}(?![\w']))?,?\s+(?=\S)"
WEAK = r"(?i)^\W*(?:actually|make\s+(?:it|that)|no|sorry)\W*$"
#: Word classes of the grammar that stand for each other in a correction, under one letter.
_ALIKE = {"d": "dNtfq5K", "W": "WwRDGYHh", "M": "Mm", "o": "oO", "A": "A", "n": "_4vTsre1"}
#: What a corrected word is drawn to: a number, a day, a month, an ordinal, or a plain word.
_FROM = "".join(_ALIKE.values())
_TO = "".join(k * len(v) for k, v in _ALIKE.items())
_BEFORE_DAY = "[AJBEIgSXC]{0,3}"
#: A taken back stretch is looked for in so many tokens before the signal, and is no longer than so many.
REACH, LONGEST = 40, 6


def _kinds(found: Column) -> Column:
    return F.translate(classes(codes(words(found))), _FROM, _TO)


def _merged(before: Column, signal: Column, after: Column) -> Column:
    """The tokens of a text, after what follows a signal was put in the place of what it corrects; else all three as they are."""
    whole = F.concat(before, F.array(signal), after)
    near = F.slice(before, F.greatest(F.size(before) - REACH + 1, F.lit(1)), F.lit(REACH))

    def aligned(x: Column) -> Column:
        near, a, b = x["near"], x["a"], x["b"]
        # The words after the signal up to a stop, or to a joint.
        said = F.regexp_substr(b, F.lit("^[^.,c]+"))
        day = F.coalesce(said.rlike("^[AJBEIg]{0,2}[SXCE]?[dWMoP]"), F.lit(False))
        whose = ~F.coalesce(F.get(x["after_words"], F.lit(0)).isin("i", "we", "you", "it", "he", "she", "they", "that's", "it's", "i'm", "that", "this", "there"), F.lit(True))
        bare = F.regexp_substr(said, F.lit("^E?n{1,2}(?=$|[^nE])"))
        plain = bare.isNotNull() & ~signal.rlike(WEAK) & whose
        stretch = F.when(day, said).when(plain, bare)
        tail = F.rtrim(a, F.lit(",."))
        # The longest beginning of it that stood before; of equal ones the last.  Plain words are taken back only right before the signal.
        place = lambda k: F.length(tail) - F.instr(F.reverse(tail), F.reverse(F.substring(stretch, F.lit(1), k))) - k + 2
        good = lambda k: (F.instr(tail, F.substring(stretch, F.lit(1), k)) > 0) & F.when(day, F.substring(stretch, F.lit(1), k).rlike("[dWMo]")).otherwise((k == F.length(stretch)) & (place(k) + k - 1 == F.length(tail)))
        size = F.get(F.filter(F.sequence(F.lit(LONGEST), F.lit(1), F.lit(-1)), lambda k: (k <= F.length(stretch)) & good(k)), F.lit(0))
        # "tomorrow. No, on Monday": the day itself agrees, whatever stands before it.
        lead = F.length(F.regexp_substr(said, F.lit(f"^{_BEFORE_DAY}")))
        core = F.length(tail) - F.instr(F.reverse(tail), F.substring(said, lead + 1, F.lit(1))) + 1
        old = F.length(F.regexp_substr(F.substring(tail, F.lit(1), core), F.lit(f"{_BEFORE_DAY}.$")))
        loose = day & size.isNull() & (F.instr(tail, F.substring(said, lead + 1, F.lit(1))) > 0)
        found = F.when(size.isNotNull(), F.struct(size.alias("new"), size.alias("old"), place(size).alias("place"))).when(loose, F.struct((lead + 1).alias("new"), old.alias("old"), (core - old + 1).alias("place")))
        return let(F.struct(found.alias("f"), F.size(before).alias("n"), F.size(near).alias("m")), replaced)

    def replaced(y: Column) -> Column:
        new_size, old_size = y["f"]["new"], y["f"]["old"]
        first = (y["n"] - y["m"] + y["f"]["place"]).cast("int")
        # "on Friday, no, tomorrow": the preposition goes with its day.
        lone = F.coalesce(F.lower(F.trim(F.get(after, F.lit(0)))).isin("tomorrow", "today", "tonight") & F.lower(F.trim(F.get(before, first - 2))).isin("on", "by", "at"), F.lit(False))
        head = F.slice(before, F.lit(1), F.greatest(first - 1 - lone.cast("int"), F.lit(0)).cast("int"))
        opens = F.substring(F.trim(F.get(before, F.lit(0))), 1, 1).rlike(r"\p{Lu}") & (F.size(head) == 0)
        word = lambda t: F.when(opens, F.concat(F.upper(F.substring(F.trim(t), 1, 1)), F.substring(F.trim(t), F.lit(2), F.length(t)))).otherwise(F.concat(F.when(F.size(head) > 0, " ").otherwise(""), F.trim(t)))
        new = F.transform(F.slice(after, F.lit(1), new_size), lambda t, i: F.when(i == 0, word(t)).otherwise(t))
        rest = F.slice(before, (first + old_size).cast("int"), F.size(before) + 1)
        follow = F.slice(after, (new_size + 1).cast("int"), F.size(after) + 1)
        return F.when(y["f"].isNull(), whole).otherwise(F.concat(head, new, rest, follow))

    return let(F.struct(near.alias("near"), _kinds(near).alias("a"), _kinds(after).alias("b"), words(after).alias("after_words")), aligned)


def repair(text: Column) -> Column:
    """The text with every correction in place of what it corrects, from left to right; null stays null.

    A signal that corrects nothing stays as it was said.  The text is worked on whole; for one signal the last ``REACH`` tokens before it are looked through.
    """
    parts = F.split(F.regexp_replace(text, f"({SIGNAL})", "\x03$1\x03"), "\x03")

    folded = lambda p: F.array_join(F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(p) - 2, F.lit(1)), F.lit(2)), tokens(F.get(p, F.lit(0))), lambda acc, i: _merged(acc, F.get(p, i), tokens(F.get(p, i + 1)))), "")
    return let(parts, lambda p: F.when(F.size(p) < 3, text).otherwise(folded(p)))
