"""Index terms: word splitting, folding of case and accents, English suffix stripping (Porter)."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Code points of the combining marks that stay inside a word and are dropped.
MARKS = "".join(map(chr, (
    0x300, 0x301, 0x302, 0x303, 0x304, 0x306, 0x307, 0x308, 0x309, 0x30A, 0x30B, 0x30C,
    0x30F, 0x311, 0x31B, 0x323, 0x324, 0x325, 0x326, 0x327, 0x328, 0x32D, 0x32E, 0x330,
    0x331,
)))

WORD = rf"[\p{{L}}\p{{N}}\p{{Co}}][\p{{L}}\p{{N}}\p{{Co}}{MARKS}]*"


@cache
def accents() -> tuple[str, str]:
    """Letters that decompose into one letter and one mark, and those letters."""
    pairs = []
    for code in range(0xC0, 0x1F00):
        char = chr(code)
        parts = unicodedata.normalize("NFD", char)
        if len(parts) == 2 and unicodedata.combining(parts[1]) and char == char.lower():
            pairs.append((char, parts[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def words(text: Column) -> Column:
    """Lower-case words in order; accents are still on."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))


def fold(word: Column) -> Column:
    """Drop accents; pure ASCII passes through."""
    accented, plain = accents()
    return F.when(F.octet_length(word) > F.length(word), F.translate(word, accented + MARKS, plain)).otherwise(word)


def words_like(text: Column, prefixes: list[str]) -> Column:
    """:func:`words`, with an empty string for each word that begins with none of ``prefixes`` once accents are off."""
    if not prefixes:
        return F.transform(words(text), lambda _: F.lit(""))
    written = dict[str, str]()
    for accented, plain in zip(*accents(), strict=True):
        written[plain] = written.get(plain, "") + accented

    def letter(c: str) -> str:
        return f"[{re.escape(c)}{written.get(c, '')}][{MARKS}]*"

    # A plain first letter that fits nothing is seen at once.
    plain = "".join(sorted({re.escape(p[0]) for p in prefixes}))
    begins = rf"(?![\x00-\x7F&&[^{plain}]])(?:{'|'.join(''.join(map(letter, p)) for p in prefixes)})"
    pattern = rf"({begins}[\p{{L}}\p{{N}}\p{{Co}}{MARKS}]*+)|{WORD}"
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(pattern), F.lit(1))


# Shapes of a stem, with c a run of consonants and v a run of vowels.
_C = "[^aeiou][^aeiouy]*"
_V = "[aeiouy][aeiou]*"
MEASURE_1 = f"^({_C})?{_V}{_C}"
MEASURE_2 = f"^({_C})?{_V}{_C}{_V}{_C}"
EXACTLY_1 = f"^({_C})?{_V}{_C}({_V})?$"
HAS_VOWEL = f"^({_C})?[aeiouy]"
SHORT_END = f"^{_C}[aeiouy][^aeiouwxy]$"

# Suffixes and what replaces them, from Porter's paper.
STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "logi": "log", "bli": "ble",
    "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize", "ation": "ate", "ator": "ate",
    "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP_3 = {
    "icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": "",
}
STEP_4 = [
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
]


def _less(word: Column, suffix: str) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - len(suffix))


def _ends(word: Column, suffix: str) -> Column:
    return word.endswith(suffix) & (F.length(word) > len(suffix))


def _apply(rows: DataFrame, rules: dict[str, str], shape: str) -> DataFrame:
    """The longest suffix present decides; it is replaced if what precedes it has the shape."""
    # Most words end otherwise, which their last two letters tell without a pattern.
    fits = F.substring("_w", -2, 2).isin(sorted({rule[-2:] for rule in rules}))
    rows = rows.withColumn("_s", F.when(fits, F.regexp_extract("_w", f".({'|'.join(rules)})$", 1)).otherwise(""))
    w, suffix = F.col("_w"), F.col("_s")
    rows = rows.withColumn("_stem", F.substring(w, F.lit(1), F.length(w) - F.length(suffix)))
    ok = (suffix != "") & F.rlike("_stem", F.lit(shape))
    if "ion" in rules:
        ok = ok & ((suffix != "ion") | F.rlike("_stem", F.lit("[st]$")))
    if any(rules.values()):
        news = F.create_map(*[F.lit(x) for pair in rules.items() for x in pair])
        changed = F.concat("_stem", F.element_at(news, suffix))
    else:
        changed = F.col("_stem")
    return rows.withColumn("_w", F.when(ok, changed).otherwise(w)).drop("_s", "_stem")


def _plural(w: Column) -> Column:
    n = F.length(w)
    two = (w.endswith("sses") & (n > 4)) | (w.endswith("ies") & (n > 3))
    return (
        F.when(~w.endswith("s") | w.endswith("ss"), w)
        .when(two, F.substring(w, F.lit(1), n - 2))
        .otherwise(F.substring(w, F.lit(1), n - 1))
    )


def _participle(w: Column) -> Column:
    """Strip -ed and -ing; a zero byte marks words that lost one of them."""
    cut = None
    for suffix in ("ed", "ing"):
        stem = _less(w, suffix)
        value = F.when(F.rlike(stem, F.lit(HAS_VOWEL)), F.concat(stem, F.lit("\0"))).otherwise(w)
        cut = F.when(_ends(w, suffix), value) if cut is None else cut.when(_ends(w, suffix), value)
    eed = F.when(F.rlike(_less(w, "eed"), F.lit(MEASURE_1)), _less(w, "d")).otherwise(w)
    return F.when(_ends(w, "eed"), eed).otherwise(cut.otherwise(w))


def _mend(marked: Column) -> Column:
    w = _less(marked, "\0")
    long_enough = F.length(w) > 2
    repaired = (
        F.when(long_enough & F.rlike(w, F.lit("(at|bl|iz)$")), F.concat(w, F.lit("e")))
        .when(F.rlike(w, F.lit(r"([^aeioulsz])\1$")), _less(w, "x"))
        .when(F.rlike(w, F.lit(SHORT_END)), F.concat(w, F.lit("e")))
        .otherwise(w)
    )
    return F.when(marked.endswith("\0"), repaired).otherwise(marked)


def _final_y(w: Column) -> Column:
    stem = _less(w, "y")
    return F.when(w.endswith("y") & F.rlike(stem, F.lit(HAS_VOWEL)), F.concat(stem, F.lit("i"))).otherwise(w)


def _final_e(w: Column) -> Column:
    stem = _less(w, "e")
    gone = F.rlike(stem, F.lit(MEASURE_2)) | (F.rlike(stem, F.lit(EXACTLY_1)) & ~F.rlike(stem, F.lit(SHORT_END)))
    return F.when(w.endswith("e") & gone, stem).otherwise(w)


def _final_ll(w: Column) -> Column:
    return F.when(w.endswith("ll") & F.rlike(_less(w, "l"), F.lit(MEASURE_2)), _less(w, "l")).otherwise(w)


def _step(change) -> Callable[[DataFrame], DataFrame]:
    return lambda rows: rows.withColumn("_w", change(F.col("_w")))


_STEPS = (
    _step(_plural),
    _step(_participle),
    _step(_mend),
    _step(_final_y),
    lambda rows: _apply(rows, STEP_2, MEASURE_1),
    lambda rows: _apply(rows, STEP_3, MEASURE_1),
    lambda rows: _apply(rows, dict.fromkeys(STEP_4, ""), MEASURE_2),
    _step(_final_e),
    _step(_final_ll),
)


def kept_letters(term: str) -> str:
    """The letters of a term that every word with this term begins with, once its accents are off; one at least.

    Rules cut the end of a word and then write at most an e, an i, or the le of ble, which a later rule may shorten to l.
    """
    end = 2 if term.endswith("ble") else 1 if term.endswith(("bl", "e", "i")) else 0
    return term[: max(1, len(term) - end)]


def with_terms(rows: DataFrame, word: str, name: str = "term") -> DataFrame:
    """Add the index term of a lower-case word: accents off, suffixes off.

    One projection per step keeps each step's result a local variable of the generated code. Words of
    fewer than three or more than 64 letters stay as they are. A leading y is a consonant, which the
    capital shows to the patterns. The one-element ``explode`` keeps a later filter on the term from being
    rewritten in terms of every step.
    """
    rows = rows.withColumn("_plain", fold(F.col(word)))
    rows = rows.withColumn("_w", F.when(F.startswith("_plain", F.lit("y")), F.regexp_replace("_plain", "^y", "Y")).otherwise(F.col("_plain")))
    for step in _STEPS:
        rows = step(rows)
    fits = F.length("_plain").between(3, 64)
    stemmed = F.when(F.startswith("_w", F.lit("Y")), F.regexp_replace("_w", "^Y", "y")).otherwise(F.col("_w"))
    term = F.when(fits, stemmed).otherwise(F.col("_plain"))
    return rows.withColumn(name, F.explode(F.array(term))).drop("_plain", "_w")
