"""What a clause is, by strings of word classes: a lexicon gives each word one letter, and predicates are short patterns over them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import EVENTS, FIRST_VERBS, IRREGULAR, PASTS, VERBS
from .when import SHELVES, _shelves, let


def _progressives(verbs: list[str]) -> list[str]:
    out = []
    for v in verbs:
        stem = v[:-1] if v.endswith("e") and not v.endswith("ee") else v
        out += [stem + "ing", v + v[-1] + "ing"]
    return out


def _words() -> dict[str, str]:
    """Word -> letter; a later line wins."""
    out: dict[str, str] = {}
    for letter, words in {
        "g": _progressives(VERBS + FIRST_VERBS), "V": VERBS, "v": FIRST_VERBS, "E": EVENTS, "x": [*PASTS, *IRREGULAR],
        "G": "coming arriving visiting flying landing moving".split(),
        "P": "i we i'll we'll i'd we'd i've we've".split(), "Y": "i'm we're".split(),
        "p": "he she they you it this that there everyone everybody everything someone somebody nobody".split(),
        "y": "he's she's they're you're it's that's there's everyone's everybody's everything's who's".split(),
        "I": "me us him her them".split(), "d": "the a an my our his their your some any these those".split(),
        "m": "need needs want must should will would gotta got can could may might supposed going plan have".split(), "b": "is are was were am be been isn't aren't wasn't weren't".split(),
        "h": "has had hasn't looks seems feels hurts works doesn't didn't won't".split(), "S": "said says told tells asked asks wrote writes thinks called".split(), "t": ["to"],
        "Z": "free set busy off home at in close near on out done ready available".split(), "n": ["not", "so", "very", "too", "almost", "really", "still"],
        "c": "and or but because then also plus".split(), "f": "okay ok um uh well oh ah ooh wow man hey just anyway yeah yes please maybe first second third finally honestly actually now".split(), "r": "remind reminder alarm alert notify nudge".split(),
        ",": [","], ".": [".", ";", ":", "!", "?"],
    }.items():
        out |= dict.fromkeys(words, letter)
    return out


#: Words of phrases that put a task off without a day.
_OFF = {
    "A": "at", "S": "some", "Q": "point", "L": "later sometime", "F": "soon", "H": "this", "U": "week month year", "w": "when whenever", "P": "i we", "G": "have get find", "C": "can",
    "D": "the", "T": "time", "N": "no", "K": "rush hurry", "E": "eventually someday", "O": "one", "B": "of these", "Y": "day", "Z": "days", "s": "sooner", "r": "or", "J": "in near distant", "u": "future",
    "q": "for within only just per a every than about over that same", "x": "each before after early earlier late ahead off trip pass ticket tour course visa delivery shipping left",
}
#: A point in time that is left open, "when I have time", "one of these days", "sooner or later", "no rush", and a lone "one day".
OPEN_DAY = "ASQ|LHU|L(?:F|L)?(?![HU])|w(?:PGS?D?T|PC)|OBBZ|E|SY(?!x)|srL|JDJ*u|JDu|(?<![qJSADHBr])OY(?![xqJL])|NK"


def _letters(found: Column, lexicon: dict[str, str]) -> Column:
    shelves = _shelves(lexicon)
    return F.array_join(F.transform(found, lambda w: F.coalesce(F.try_element_at(F.get(shelves, (F.crc32(w) % SHELVES).cast("int")), w), F.lit("_"))), "")


def grammar(found: Column) -> Column:
    """The class string of the words of a clause; a verb after a determiner is a noun."""
    return F.regexp_replace(_letters(found, _words()), "(?<=d)[VvxgmS]", "_")


def vague_span(found: Column) -> Column:
    """Where a task is put off without a day, as ``start`` (from 1) and ``size``, else null: no day of another task is meant for it."""
    lexicon = {w: letter for letter, words in _OFF.items() for w in words.split()}
    span = lambda line: F.struct(F.regexp_instr(line, F.lit(OPEN_DAY)).alias("start"), F.length(F.regexp_substr(line, F.lit(OPEN_DAY))).alias("size"))
    return let(_letters(found, lexicon), lambda line: F.when(line.rlike(OPEN_DAY), span(line)))


_OPEN = "^[cf,.]*n?[cf,.]*"
#: Somebody else's plan: "my sister is coming", "Anna's arriving", "they are going to visit".
OTHERS = f"{_OPEN}(?![VvPY])[dIEpy_g][dIEpy_gc]{{0,5}}b?(?:G|mtV)"
#: How the speaker stands: "I'm free", "we are at".
STATE = f"{_OPEN}(?:Y|Pb)n*Z"
#: What is told, not ordered: third persons, things that are or have, and feelings of the speaker.
NARRATION = f"{_OPEN}(?:y|p[bhmSx_]|[dI]?[_E]{{1,3}}(?:[_t][_ZEd]{{0,2}})?(?:b(?!m)|h|S)|[_E]{{1,2}},?S|Y(?![mgG])n*[_Z]|Pb(?!m)n*[_gZ]|PS)"
#: The same, of how things are now, even where today is named: "it's very crowded today".
SCENE = f"{_OPEN}(?:_b_|y(?!G)n*_|pbn*_)"
#: What somebody said or did: "Sardor called, he said".
REPORT = f"{_OPEN}(?:_{{1,2}}|p|[dI]_{{1,2}}),?S"
