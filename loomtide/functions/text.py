"""Text functions as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Letters that lose their accent, group by group in natural order.
PLAIN_LETTERS = {
    "a": "àáâãäåāăą", "c": "çćĉċč", "d": "ðďđ", "e": "èéêëēĕėęě", "g": "ĝğġģ", "h": "ĥ", "i": "ìíîïĩīĭįı", "j": "ĵ", "k": "ķ", "l": "ĺļľŀł",
    "n": "ñńņň", "o": "òóôõöøōŏő", "r": "ŕŗř", "s": "śŝşš", "t": "ţťŧ", "u": "ùúûüũūŭůű", "w": "ŵ", "y": "ýÿŷ", "z": "źżž",
}
# Letters that become two.
WIDE_LETTERS = {"æ": "ae", "œ": "oe", "þ": "th", "ß": "ss"}
# Words that carry no meaning in a title.
STOP_WORDS = "a an the to my for with of and at on in i me it some up from about his her our your their this that him them go do get".split()

_FROM = "".join(PLAIN_LETTERS.values())
_TO = "".join(k * len(v) for k, v in PLAIN_LETTERS.items())
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def fold_for_search(text: Column) -> Column:
    """Lower case without accents, combining marks, ``%``, ``_`` and ``\\``; blanks collapsed."""
    out = F.translate(F.regexp_replace(F.lower(text), "[\\u0300-\\u036F%_\\\\]", ""), _FROM, _TO)
    for letter, pair in WIDE_LETTERS.items():
        out = F.replace(out, F.lit(letter), F.lit(pair))
    return F.trim(F.regexp_replace(out, r"[\s\x{A0}]+", " "))


def normalise_title(text: Column, units: int = 200) -> Column:
    """Blanks collapsed, cut to ``units`` UTF-16 units between code points."""
    plain = F.trim(F.regexp_replace(text, r"[\s\x{A0}]+", " "))
    size = lambda s: F.octet_length(F.encode(s, "UTF-16BE")) / 2
    # Only titles with wide characters need the search for the cut.
    cuts = F.filter(F.sequence(F.lit(units // 2), F.lit(units)), lambda k: size(F.substring(plain, F.lit(1), k)) <= units)
    return F.when(size(plain) <= units, plain).otherwise(F.rtrim(F.substring(plain, F.lit(1), F.array_max(cuts))))


def is_valid_title(text: Column) -> Column:
    return F.length(normalise_title(text)) > 0


def fold_temporal_case(text: Column) -> Column:
    """A-Z lower-cased and curly apostrophes straightened; the length stays."""
    return F.translate(text, UPPER + "‘’", LOWER + "''")


def strip_non_speech(text: Column) -> Column:
    """Without what stands in square or round brackets."""
    out = F.regexp_replace(F.regexp_replace(text, r"\[[^\]]*\]", ""), r"\([^)]*\)", "")
    return F.trim(F.regexp_replace(out, r"\s+", " "))


def content_words(text: Column) -> Column:
    """The set of meaningful words, cut to four letters."""
    found = F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9']+)"), F.lit(1))
    bare = F.transform(found, lambda w: F.replace(F.replace(w, F.lit("'s"), F.lit("")), F.lit("'"), F.lit("")))
    return F.array_distinct(F.transform(F.filter(bare, lambda w: (w != "") & ~w.isin(STOP_WORDS)), lambda w: F.substring(w, 1, 4)))


def title_similarity(a: Column, b: Column) -> Column:
    """Jaccard similarity of the content words; 1 if both have none."""
    return set_similarity(content_words(a), content_words(b))


def set_similarity(x: Column, y: Column) -> Column:
    """Jaccard similarity of two arrays without repeats; 1 if both are empty."""
    common = F.size(F.array_intersect(x, y))
    union = F.size(x) + F.size(y) - common
    return F.when(union == 0, 1.0).otherwise(common / F.when(union == 0, 1).otherwise(union))


def word_edits(reference: Column, hypothesis: Column) -> Column:
    """Levenshtein distance of two arrays of words: each different word becomes one character."""

    def letters(words: Column, known: Column) -> Column:
        return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.hex(F.array_position(known, w) + 0x4E00)), "UTF-16BE")), "")

    # The different words are found once for each pair and not for each word.
    known = F.array(F.array_union(reference, hypothesis))
    return F.get(F.transform(known, lambda k: F.levenshtein(letters(reference, k), letters(hypothesis, k))), F.lit(0))


def word_error_rate(reference: Column, hypothesis: Column) -> Column:
    """Edits by words of the reference; for an empty one 0 or 1."""
    n = F.size(reference)
    return F.when(n == 0, F.when(F.size(hypothesis) == 0, 0.0).otherwise(1.0)).otherwise(word_edits(reference, hypothesis) / F.when(n == 0, 1).otherwise(n))


def word_before(text: Column, at: Column) -> Column:
    """The word that ends before an offset (from 0), or empty."""
    return F.regexp_extract(F.substring(text, F.lit(1), at), r"([A-Za-z0-9'\x{80}-\x{10FFFF}]+)[^A-Za-z0-9'\x{80}-\x{10FFFF}]*$", 1)


def word_after(text: Column, at: Column) -> Column:
    """The word that begins at or after an offset (from 0), or empty."""
    return F.regexp_extract(F.substring(text, at + 1, F.length(text)), r"^[^A-Za-z0-9'\x{80}-\x{10FFFF}]*([A-Za-z0-9'\x{80}-\x{10FFFF}]+)", 1)


def encode_payload(task_id: Column) -> Column:
    return F.to_json(F.struct(task_id.alias("taskId")))


def decode_payload(payload: Column) -> Column:
    """The task id of a payload, or null."""
    return F.nullif(F.get_json_object(payload, "$.taskId"), F.lit(""))


def slot_hash(text: Column) -> Column:
    """A 31-bit multiplicative hash of the UTF-16 units; never 0."""
    units = F.transform(F.regexp_extract_all(F.hex(F.encode(text, "UTF-16BE")), F.lit("(.{4})"), F.lit(1)), lambda h: F.conv(h, 16, 10).cast("long"))
    out = F.aggregate(units, F.lit(0x811C9DC5 & 0x7FFFFFFF).cast("long"), lambda acc, u: (acc.bitwiseXOR(u) * 0x01000193).bitwiseAND(0x7FFFFFFF))
    return F.when(out == 0, 1).otherwise(out).cast("int")
