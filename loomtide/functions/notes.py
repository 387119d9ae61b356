"""Spoken notes as text: repairs, self-corrections and the places where a new clause begins."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .lexicon import EVENTS, FIRST_VERBS, IRREGULAR, PASTS, VERBS, any_of
from .repair import repair
from .text import strip_non_speech
from .when import MONTHS, WEEKDAYS, let, tokens, words

SOUNDS = "um+|uh+|uhm|er|erm|hm+|eh+|ehm|ugh|oo+h|ahum|ahem"
_VERB = any_of(VERBS + FIRST_VERBS)
_EVENT = any_of(EVENTS)
_DAYS = any_of(WEEKDAYS)
_SMALL = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve"
DETERMINERS = "a an her his my our that the their this".split()
#: What may stand between the beginning of a clause and its verb.
LEAD = (
    r"(?:(?:and|so|then|also|please|oh|okay|ok|well|maybe|anyway|first|second|third|finally|just|quickly|still|really|today's)\b,?\s+"
    r"|(?:i|we)(?:\s+(?:also|still|really|just))?\s+(?:need|have|want|must|should|ought|got|gotta|will|would\s+like|am\s+going|are\s+going|can)(?:\s+(?:also|still|really|just|to))*\s+|(?:i|we)'(?:ll|d\s+like\s+to|ve\s+got\s+to|m\s+going\s+to|re\s+going\s+to|ve\s+to)\s+"
    r"|(?:remind\s+me|don't\s+forget|do\s+not\s+forget|remember|make\s+sure|be\s+sure|don't\s+let\s+me\s+forget)(?:\s+(?:to|about|that\s+i|that|i))*\s+|let's\s+|now\s+|to\s+|need\s+to\s+|have\s+to\s+)"
)
#: How a phrase of time begins.
WHEN = (
    rf"(?:(?:on|at|by|before|until|till|in|after|next|this|around)\s+(?:the\s+|this\s+|next\s+|about\s+|coming\s+)*(?:{_DAYS}|\d[\w:.]*|{_SMALL}|first|second|third|noon|midnight|morning|afternoon|evening|half|an?\s+(?:hour|quarter|half|few|couple)|twenty|thirty|forty|fifteen|week|month|weekend|night|{'|'.join(MONTHS)})"
    rf"|tomorrow|tonight|today|later\s+today|(?:the\s+)?day\s+after\s+tomorrow|{_DAYS}|whenever|when\s+i\s+(?:have|get|find)|at\s+some\s+point|some\s?day|eventually|one\s+day|sometime)\b"
)
BREAK = "\x01"


def _chain(text: Column, rules: list[tuple[str, ...]]) -> Column:
    """Replacements one after another; inside a lambda, so that the chain does not blow up generated code.

    A rule with a third part is tried only where that short pattern is found, which every text that the rule fits holds.
    """

    def apply(t: Column, rule: tuple[str, ...]) -> Column:
        if len(rule) == 2:
            return F.regexp_replace(t, rule[0], rule[1])
        return let(t, lambda x: F.when(x.rlike(rule[2]), F.regexp_replace(x, rule[0], rule[1])).otherwise(x))

    return let(text, lambda x: reduce(apply, rules, x))


def normalise(text: Column) -> Column:
    """A transcript without quotes, brackets, hesitations and slips of the recogniser."""
    plain = strip_non_speech(F.translate(text, "“”„«»\"‘’", "\0\0\0\0\0\0''"))
    past = [(rf"(?i)(^|[.!?]\s+|,\s+(?:and\s+)?(?:then\s+)?){a}\s+(?![^.!?]*\b(?:yesterday|ago|already|last\s+\w+|earlier)\b)(?=(?:my|the|our|his|her|an?|[\p{{L}}]+)\b[^.!?,]*\b(?:tomorrow|tonight|next\s|at\s+\d|on\s+(?:{_DAYS})))", f"$1{b} ") for a, b in PASTS.items()]
    rules = [
        ("\0", ""), (r"\s+", " "), (r"\s+([,.;:!?])", "$1"),
        (r"\b([apAP])\.\s?[mM]\.(?=\s+(?!I\b)[A-Z]|\s*$)", "$1m."), (r"\b([apAP])\.\s?[mM]\.", "$1m"),
        # A sentence that opens with "I'm" as a hesitation, and words that the recogniser makes of others.
        (r"(?i)(^|[.!?]\s+)I'm,?\s+(?=(?:okay|ok|alright)(?:,|\s+so\b|$)|(?:i|we)\s|(?:what|um+|uh+)\b|so,|(?:today|tomorrow|tonight)(?:,|\s+(?:i|we)\b))", "$1"),
        (r"(?i)(^|[.!?]\s+)on\s+(?=ok(?:ay)?\b)", "$1"), (r"(?i)\bunremind\b", "remind"),
        (rf"(?i)(?<!\d\s?)\b(?:{SOUNDS})\b(?!'),?(?=\s|$|[.!?])\s*", ""), (r"^\s*[,.]\s*", ""), (r"([.!?])\s*[,.]+", "$1"), (r"(?i)\b(to|so|the|a|my),\s+(?=\w)", "$1 "),
        # Clock forms.
        (rf"(?i)\ba\s+(\d{{1,2}})\s+(?=(?:{_EVENT})\b)", "at $1 "), (r"(?i)(?<=^|\bat\s|\bby\s|,\s|\band\s)(\d{1,2})([0-5]\d)(?=\s+(?:in\s+the\s+(?:morning|afternoon|evening)|at\s+night)\b)", "$1:$2"), (r"(?i)\bat\s+(\d{1,2})\.0\b(?!\d)", "at $1"), (r"\b(\d{1,2})\s+0\s+0\b", "$1:00"),
        (r"\b(Dr|Mr|Mrs|Ms|St|No|vs|etc)\.\s", "$1 "),
        # Instructions.
        (r"(?i)\bpickup\b(?=\s+(?:the|my|a|our|his|her|some|[A-Z]))", "pick up"), (r"(?i)(^|[.,;]\s+|\b(?:to|and|please)\s+)by\s+(?=(?:the|some|a|new|more)\s+(?!(?:end|way|time|morning|evening|afternoon|car|bus|train|weekend|day|week|month)\b)\w+)", "$1buy "),
        (r"(?i)(^|[.,;]\s+|\b(?:to|and|please)\s+)(?:cent|scent)\s+(?=(?:the|him|her|them|a|my)\b)", "$1send "), *past,
        # A missing stop before a verb that is written as the first word of a sentence.
        (rf"(?<=[a-z0-9])\s+(?=(?:{'|'.join(v.capitalize() for v in VERBS)})\s+(?:the|my|a|an|some|for|to|[A-Z])\b)", ". "),
    ]
    return F.trim(with_list_commas(_chain(plain, rules)))


def corrected(text: Column) -> Column:
    """Without stutters and what the speaker took back."""
    before = [
        (r"(?i)\b(\w+(?:'\w+)?)(?:,?\s+\1\b){1,150}", "$1"),
        (rf"(?i)\b((?:i|we)\s+(?:need|have|want)\s+to)\s+(?:{_VERB}),\s+(?=\1\s)", ""),
        (r"(?i)\bby\s+the\s+way,?\s+", ""),
        # "the lagman. No, not lagman, the manti": the word that is denied is replaced where it stood.
        (r"(?i)\b(?:the\s+)?(\w{3,})\b([^.!?]{0,80})[.,!?]\s*(?:no,?\s+)?not\s+(?:the\s+)?\1,?\s+(?:but\s+)?((?:the\s+)?\w+)", "$3$2"),
        (r"(?i)(?:^|(?<=[.!?]\s))[^.!?]*[.!?]\s*(?:no,?\s+)?(?:scratch|forget)\s+that[.!,]?\s*", ""),
    ]
    return F.trim(_chain(repair(_chain(text, before)), [(r"(?i)[,\s]+(?:and|so|but|then|also|or)\W*$", "")]))


def broken(text: Column) -> Column:
    """The text with a mark and the joint (".", "and", "then", ...) and a bar before each clause but the first."""
    opens = rf"(?:{LEAD}){{0,12}}(?:{_VERB})\b"
    starts = rf"(?:{opens}|(?:{LEAD}){{0,12}}{WHEN}|(?:{LEAD}){{1,3}}|(?:an?\s+|the\s+|my\s+)?(?:\w+\s+)?(?:{_EVENT})\b)"
    trip = r"(?<!\b(?:go|come|drive|head|walk|run|back)\s(?:to|at|by|over)\s[^,.;\x01]{1,40})"
    rules = [
        # A date in the middle that a verb follows begins a task.
        (rf"(?i)(?<=\w)(?<!\bweek)\s+(?=on\s+(?:the\s+)?(?:(?:{'|'.join(MONTHS)})\s+\d\w*|{_DAYS}|\d+(?:st|nd|rd|th))\s+(?:{_VERB})\s+(?:the|my|a|an|to|some|for)\b)", f"{BREAK}.|", r"(?i)\son\s"),
        (r"(?<=[.!?])\s+(?=(?i:(?:and|then),?\s))", f"{BREAK}..|", r"[.!?]\s"),
        (r"(?<=[.!?;])\s+(?=\S)", f"{BREAK}.|", r"[.!?;]\s"), (r":\s+(?=\D)", f"{BREAK}.|", r":\s"),
        (rf"(?i)\s*,?\s+(?:oh,?\s+)?(?:and|but)\s+(?:also,?\s+|oh,?\s+)?(?:then|after\s+that|before\s+that)\s*,?\s+", f"{BREAK}then|", r"(?i)then|that"),
        (rf"(?i)(?:,\s*|\s+)(?:then|after\s+that|before\s+that)\s*,?\s+(?={starts}|to\s)", f"{BREAK}then|", r"(?i)then|that"),
        (rf"(?i)\s*,?\s+(?:oh,?\s+)?(?:and|but)\s+(?:also|plus|oh),?\s+", f"{BREAK}also|", r"(?i)also|plus|oh"),
        (rf"(?i),\s+(?:oh,?\s+)(?:and\s+)?", f"{BREAK}also|", r"(?i),\s+oh"),
        (rf"(?i)(?<!\bi)(?<!\bwe)(?:,\s*|\s+)(?:also|plus)\s*,?\s+(?={starts})", f"{BREAK}also|", r"(?i)also|plus"),
        (rf"(?i),\s+(?:so|but)\s+(?={starts})", f"{BREAK}so|", r"(?i),\s+(?:so|but)\s"), (rf"(?i)\s+but\s+(?=(?:{LEAD}){{0,12}}{WHEN})", f"{BREAK}so|", r"(?i)\sbut\s"),
        (rf"(?i),\s+and\s+(?={starts})", f"{BREAK}and|", r"(?i),\s+and\s"),
        (rf"(?i){trip}\s+and\s+(?!(?:{_VERB})\s+(?:it|them)\s*(?:$|[.,;!?\x01]))(?=(?:{LEAD}){{0,12}}(?:(?:{_VERB})\s+(?!and\b)\w|{WHEN})|(?:{LEAD}){{1,3}})", f"{BREAK}and|", r"(?i)\sand\s"),
        (rf"(?i),\s+(?=(?:{LEAD}){{0,12}}(?:(?:{_VERB})\s+\w|{WHEN})|it's\s+due|because\s|now\s+\w|(?:both|all\s+of\s+them)\s|(?:it|he|she|that)'s\s|(?:my|the|his|her|our|he|she|it)\s*(?:\w+\s+)?(?:is|are)\s)", f"{BREAK},|", r","),
    ]
    return _chain(text, rules)


def clauses(text: Column) -> Column:
    """The clauses of a note in spoken order: structs of ``joint`` and ``text``.

    Joints: "" for the first, "." for a new sentence, ".." for one that opens with "and", "then" or "also", and "then", "also", "so", "and", ",".
    """
    parts = F.split(broken(text), BREAK)
    return F.transform(parts, lambda p, i: F.struct(F.when(i == 0, "").otherwise(F.split_part(p, F.lit("|"), F.lit(1))).alias("joint"), F.trim(F.when(i == 0, p).otherwise(F.regexp_replace(p, r"^[^|]*\|", ""))).alias("text")))


def filled_topics(parts: Column) -> Column:
    """Clauses whose "it" or "them" names a topic said right before: "The car, I need to wash it" is one clause about the car.

    A topic is one to three words without a verb or a day.  "it" takes any determined topic and a bare singular, "them" a bare plural or a determined topic that ends in s.
    """
    seen = F.transform(parts, lambda p: let(F.regexp_replace(F.lower(p["text"]), r"[,.!?:;]+$", ""), lambda t: _topic_facts(p, t)))

    def fill(q: Column) -> Column:
        def said(p: Column, i: Column) -> Column:
            before, here = F.get(q, i - 1), (i > 0) & F.coalesce(_names(F.get(q, i - 1), p), F.lit(False))
            name = F.regexp_replace(before["text"], r"[,.!?:;]+$", "")
            filled = F.regexp_replace(p["text"], r"(?i)\b(?:it|them)\b", F.concat(F.lower(F.substring(name, 1, 1)), F.substring(name, F.lit(2), F.length(name))))
            gone = F.coalesce(_names(p, F.get(q, i + 1)), F.lit(False))
            return F.struct(F.when(here, before["joint"]).otherwise(p["joint"]).alias("joint"), F.when(here, filled).otherwise(p["text"]).alias("text"), gone.alias("gone"))

        return F.transform(F.filter(F.transform(q, said), lambda p: ~p["gone"]), lambda p: F.struct(p["joint"].alias("joint"), p["text"].alias("text")))

    return let(seen, lambda q: F.when(F.exists(q, lambda p: p["topic"]), fill(q)).otherwise(parts))


def _topic_facts(p: Column, bare: Column) -> Column:
    determined = r"(?:the|my|our|his|her|their|this|that|these|those)\s+"
    topic = bare.rlike(rf"^(?:{determined})?[a-z][a-z'-]*(?:\s+[a-z][a-z'-]*)?$")
    # Few clauses are so short; only those are looked at closely.
    plain = F.when(topic, ~bare.rlike(rf"\b(?:{_VERB}|{_EVENT}|{_DAYS}|today|tomorrow|tonight|at|on|in|by|morning|evening|night|noon)\b|^(?:okay|ok|so|and|then|yes|no|hello|hi|hey|thanks|please|also|well|oh|um|i|we)\b")).otherwise(False)
    object_ = lambda word: F.when(F.lower(p["text"]).rlike(rf"\b{word}\b"), F.lower(p["text"]).rlike(rf"^(?:{LEAD}){{0,12}}(?:{_VERB})\s+(?:\w+\s+){{0,2}}{word}\b")).otherwise(False)
    return F.struct(p["joint"].alias("joint"), p["text"].alias("text"), plain.alias("topic"), bare.rlike(r"(?<!s)s$").alias("many"), bare.rlike(f"^{determined}").alias("fixed"), object_("it").alias("it"), object_("them").alias("them"))


def _names(p: Column, q: Column) -> Column:
    """A topic, and a clause that speaks of it in the right number."""
    return p["topic"] & q["joint"].isin(",", "so", ".") & ((q["it"] & (~p["many"] | p["fixed"])) | (q["them"] & p["many"]))


def opens_with_verb(text: Column) -> Column:
    return F.lower(text).rlike(rf"^(?:{LEAD}){{0,12}}(?:{_VERB})\b")


def first_verb(text: Column) -> Column:
    """The verb that a clause begins with, after its leads; else empty."""
    return F.regexp_extract(F.lower(text), rf"^(?:{LEAD}){{0,12}}({_VERB})\b", 1)


# ── What a clause is ─────────────────────────────────────────────────────────────────────────────

_OPENING = r"^\W*(?:(?:so|and|but|well|anyway|because|okay|ok|oh|ah|yeah|honestly|actually|now)\W+){0,8}"
SMALL_TALK = (
    r"^\W*(?:(?:also|plus|then|just|quickly|first|so|and|oh|okay|ok|well|um|yeah|ah|wow|anyway|no|wait|nothing|sorry|bye|hello|hi|hey|thanks|please|right|yes|man|honestly|you\s+know|let's\s+(?:go|see)|thank\s+you(?:\s+(?:so|very)\s+much)?|that's\s+(?:it|all)(?:\s+for\s+\w+)?"
    r"|how\s+are\s+you|what\s+(?:else|a\s+day|was\s+it)|let\s+me\s+(?:think|see)|i\s+(?:almost\s+)?forgot(?:\s+what\s+i\s+wanted\s+to\s+say)?|i\s+think|no\s+rush|no\s+hurry|ah\s+yes|oh\s+no|oh\s+man)\W*){0,80}$"
)
PREAMBLE = rf"^\W*(?:(?:so|okay|ok|and|well|here)\W+){{0,8}}(?:(?:i|we)\s+have|i've\s+got|there\s+are|here\s+are|these\s+are|my|i\s+need\s+to\s+do|i\s+have\s+to\s+do)?\s*(?:an?\s+)?(?:some|a\s+few|few|several|many|a\s+lot\s+of|(?:{_SMALL})|\d+|my|the)?\s*(?:\w+\s+)?(?:tasks?|things?|plans?|errands|to-?dos?|stuff|todo\s+list)(?:\s+to\s+do)?(?:\s+for)?\W*$"
QUESTION = r"^\W*(?:(?:so|and|but|um)\W+){0,8}(?:is|are|was|were|does|did|what|who|whose|where|why|how|which|am\s+i)\b.*\?\s*$"
THING = r"^\W*(?:(?:so|and|oh)\W+)?(?:the|its|his|her|my|our|their)\s"
ELABORATION = rf"^\W*(?:and\W+)?(?:do\s+it|it's|it\s+is|it\s+(?:starts|begins|opens|leaves)|that's|the\s+\w+(?:\s+\w+)?\s+(?:is|starts|begins|leaves|opens)|they\s+(?:start|open)|he\s+is|she\s+is)\s+(?:due\s+|scheduled\s+|moved\s+)?(?:at|on|by|in|from|tomorrow|today|tonight|for)\b"
DONE_BEFORE = rf"^\W*(?:{'|'.join(PASTS)}|{'|'.join(IRREGULAR)})\b"
DONE = rf"^\W*(?:(?:so|and)\W+){{0,8}}(?:i|we)\s+(?:already\s+|just\s+)?(?:{'|'.join(IRREGULAR)}|(?!need\b)\w+ed)\b"
ALREADY = r"\balready\b"
REMIND_ONLY = r"^\W*(?:and\W+)?(?:please\s+)?(?:remind|alert|notify)\s+me(?:\s+(?:about\s+(?:it|that|this)|again))?\W*$"
DAY_BEFORE = r"\bremind\s+me\s+(?:about\s+(?:it|that)\s+)?(?:the\s+day\s+before|a\s+day\s+(?:before|earlier|ahead))\b"
BOTH = r"^\W*(?:both|all\s+(?:of\s+them|three|four)|all)\W*$"

# ── Titles ───────────────────────────────────────────────────────────────────────────────────────

_TITLE = [
    (r"(?i)^.*?\basked\s+me\s+to\s+", ""), (r"(?i)^(?:is|are)\s+(?=\w)", ""), (r"(?i)\s+and\s+(?:we|i)\s+(?:are|am)\s+\w+ing\b.*$", ""),
    (r"^[\s,.;:!?…-]+|[\s,;:…-]+$", ""),
    (rf"(?i)^(?:{LEAD}){{1,12}}(?=\S)", ""),
    (r"(?i)^(?:you\s+know|listen|look|anyway|oh|ah|yes|no|yeah|hey|hello|hi|okay|ok|so|well|and|but|then|also|plus|because|ah\s+yes|what\s+else|please|kindly|still|maybe|first|second|third|fourth|finally|next|lastly|can\s+you|could\s+you|would\s+you)\b[\s,.!]*(?=\S)", ""),
    (r"(?i)^(?:i|we)\s+(?:really\s+|still\s+|also\s+)?(?:need|have|want|plan|must|should|will|shall|would\s+like|am\s+going|are\s+going|am\s+supposed|got|gotta)(?:\s+to\b)?\s*", ""),
    (r"(?i)^(?:i|we)\s+(?=(?:" + _VERB + r")\b)", ""),
    (r"(?i)^(?:i'm|i\s+am|we're|we\s+are)\s+(?:going\s+to\s+)?(?=(?:go|fly|driv|mov|leav|meet|travel|pick|tak|visit)\w*ing\b)", "\x02"),
    (r"(?i)^\x02go(?:ing)\b", "go"), (r"(?i)^\x02fly(?:ing)\b", "fly"), (r"(?i)^\x02meet(?:ing)\b", "meet"), (r"(?i)^\x02travel(?:l?ing)\b", "travel"), (r"(?i)^\x02pick(?:ing)\b", "pick"), (r"(?i)^\x02visit(?:ing)\b", "visit"), (r"(?i)^\x02(driv|mov|leav|tak)ing\b", "$1e"),
    (r"(?i)^(?:there's|there\s+is|there\s+will\s+be|i've\s+got|we've\s+got|it's|have)\s+(?:an?\s+|the\s+)(?=\w)", ""),
    (rf"(?i)^have\s+(?=(?:\w+\s+){{0,2}}(?:{_EVENT})\b)", ""),
    (r"(?i)^(?:an?|the)\s+(?=(?:\w+\s+){0,2}(?:" + _EVENT + r")\b)", ""),
    (r"(?i)^(?:go\s+to\s+|go\s+)(?=travel\b)", ""), (r"(?i)\bcall(ed)?\s+to\s+(?=\w)", "call "), (r"(?i)^need\s+(?=\w)", ""), (r"(?i)^to\s+(?=\w)", ""), (r"(?i)^(?:remind|tell)\s+me\b\s*(?:about\s+|to\s+|that\s+)?", ""), (r"(?i)^(?:go\s+)?(?:i|we)\s+go\s+", "go "),
    (r"(?i)\b(?:every|each)\s+(?:day|week|month|year|morning|afternoon|evening|night)\b", ""), 
    (r"(?i)[\s,]+(?:on|at|by|for|in|and|or|until|till|before|after|from|is|are|was|to\s+do\s+it|you\s+know|please|due|so|then|too|as\s+well|actually|honestly)\W*$", ""),
    (r"[\s,.;:!?…-]+$", ""), (r"\s*,\s*,\s*", ", "), (r"\s{2,}", " "), (r"\s+([,.;:!?])", "$1"),
]


def clean_title(text: Column) -> Column:
    """A clause as a title (X6): leads, fillers, subjects and loose ends go, again and again until nothing changes.

    A round that changes a text makes it shorter, or puts one form for another that no rule fits, so there are at most as many rounds as characters.
    First letter in upper case; empty without a letter or digit.  A title is its own title.
    """
    start = F.struct(F.trim(text).alias("now"), F.lit(False).alias("still"))
    step = lambda acc, _: F.when(acc["still"], acc).otherwise(let(F.trim(_chain(acc["now"], _TITLE)), lambda new: F.struct(new.alias("now"), (new == acc["now"]).alias("still"))))
    settled = F.aggregate(F.sequence(F.lit(0), F.length(text)), start, step, lambda acc: acc["now"])
    return let(settled, lambda out: F.when(out.rlike(r"[\p{L}\p{N}]"), F.concat(F.upper(F.substring(out, 1, 1)), F.substring(out, F.lit(2), F.length(out)))).otherwise(""))


# Verbs that ask somebody to do a thing, and words after which "to" begins no item of a list.
_ASKS = "ask|tell|remind|get|let|help|teach|invite"
_MODAL = "have|has|had|need|needs|want|wants|going|got|ought|used|able|how|order|as|me|us"


def with_list_commas(text: Column) -> Column:
    """Sentences "to A to B and to C" with the commas that were not spoken.

    Three verbs at least follow a "to", the last after "and", with no comma between the first and the last.  The middle one of three gets its comma only with
    a day or a time of its own, since it may be the purpose of the first; of four or more all do.  What somebody is asked to do is no item, nor is what follows "need" or "going".
    """
    to = rf"\bto\s+(?:{_VERB})\b"
    plain = r"(?:(?!\bto\b)[^,.;!?])*?"
    timed = rf"(?=(?:(?!\bto\b)[^,.;!?])*?\b(?:at\s+\d|at\s+(?:{_SMALL})|tomorrow|today|tonight|(?:on|by|next)\s+(?:{_DAYS})|noon)\b)"
    # The item before must not be one that asks somebody, and no modal may stand before the "to".
    gap = rf"(?<!\b(?:{_MODAL}|and))\s+"
    four = rf"(?i)({to}(?<!\b(?:{_ASKS})){plain}){gap}(?=to\s+(?:{_VERB})\b{plain}\s(?:and\s+)?to\s+(?:{_VERB})\b{plain}(?:\sto\s+(?:{_VERB})\b{plain})*?\sand\s+to\s+(?:{_VERB})\b)"
    five = rf"(?i)(,\s+{to}(?<!\b(?:{_ASKS})){plain}){gap}(?=to\s+(?:{_VERB})\b{plain}\sand\s+to\s+(?:{_VERB})\b)"
    three = rf"(?i)(^[^,.;!?]*?{to}(?<!\b(?:{_ASKS})){plain}){gap}(?=to\s+(?:{_VERB})\b{timed}{plain}\sand\s+to\s+(?:{_VERB})\b)"
    sentences = F.regexp_extract_all(text, F.lit(r"([^.!?]+[.!?]*\s*|[.!?]+\s*)"), F.lit(1))
    listed = lambda s: F.when(s.rlike(rf"(?i)({to}).*({to}).*\band\s+({to})"), _chain(s, [(four, "$1, "), (five, "$1, "), (three, "$1, ")])).otherwise(s)
    return F.when(F.size(sentences) > 0, F.array_join(F.transform(sentences, listed), "")).otherwise(text)
