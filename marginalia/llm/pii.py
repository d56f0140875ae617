"""Personal data: patterns propose spans, checksums and ranges confirm them, context words move the score.

Kinds and their order: email, ip, card (Luhn), phone, then what the method adds: iban (mod 97) and local, a national
phone number that counts only beside a word such as "phone" or "call". Everything is a column expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.exprs import let
from marginalia.llm.spans import CONTEXT, FOUND, find_all, labelled, merged

# The lookbehinds stop a search from starting inside a run that the run's first character has already failed; \G admits
# the place where the last match ended. Possessive quantifiers keep the matcher from recursing on long runs.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Only the start is matched, so that what follows can hold the next start; the group looks ahead at the rest and its surroundings.
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=((?:\x20?[A-Z0-9]){11}(?s:.{0,100})))"
IBAN_TAIL = r"^(?:\x20?[A-Z0-9]){11,30}"
LOCAL = r"(?<![0-9A-Za-z+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])"

#: Countries by the length of their IBANs. Others may have from 15 to 34 characters.
IBAN_LENGTHS = {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
}

#: Words that raise the score of a kind when they stand nearby.
CONTEXT_WORDS = {
    "email": r"(?i)\b(e-?mail|mail|contact|write)\b",
    "ip": r"(?i)\b(ip|address|host|server|login)\b",
    "card": r"(?i)\b(card|visa|credit|payment|pay)\b",
    "phone": r"(?i)\b(phone|tel|telephone|call|mobile|fax)\b",
    "iban": r"(?i)\b(iban|account|bank|transfer)\b",
    "local": r"(?i)\b(phone|tel|telephone|call|mobile|fax)\b",
}
#: Score without and with context. Spans below ``THRESHOLD`` are dropped; the base kinds start above it.
SCORES = {
    "email": (0.9, 1.0), "ip": (0.6, 0.9), "card": (0.9, 1.0), "phone": (0.7, 1.0), "iban": (0.9, 1.0), "local": (0.2, 0.6),
}
THRESHOLD = 0.5
BASE_KINDS = ("email", "ip", "card", "phone")


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""

    def weight(d: Column, i: Column) -> Column:
        twice = d.cast("int") * 2
        return F.when(i % 2 == 1, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(d.cast("int"))

    singles = F.split(F.reverse(digits), "(?!^)(?!$)", -1)
    return F.aggregate(F.transform(singles, weight), F.lit(0), lambda a, b: a + b) % 10 == 0


def mod97(value: Column) -> Column:
    """Whether letters and digits, the first four moved to the end and letters read as 10 to 35, leave 1 modulo 97."""
    turned = F.concat(F.substr(value, F.lit(5)), F.left(value, F.lit(4)))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c >= "A", (acc * 100 + F.ascii(c) - 55) % 97).otherwise((acc * 10 + F.ascii(c) - 48) % 97)

    return F.aggregate(F.split(turned, "(?!^)(?!$)", -1), F.lit(0), step) == 1


def _small(part: Column) -> Column:
    bare = F.regexp_replace(part, "^0+(?=[0-9])", "")
    return (F.length(bare) <= 3) & (F.left(bare, F.lit(3)).cast("int") <= 255)


def _is_card(value: Column) -> Column:
    return let(_digits(value), lambda d: F.when(F.length(d).between(14, 19), luhn(d)).otherwise(False))


def _is_phone(value: Column) -> Column:
    return F.length(_digits(value)).between(10, 15)


def _ibans(text: Column) -> Column:
    """Matches of IBANs: of each start, the prefix that ends where letters and digits end and passes mod 97.

    The length of the country comes first, then the longest. A start inside an IBAN found before it counts no more.
    """
    none = F.expr(f"cast(array() as {FOUND})")

    def own_length(bare: Column) -> Column:
        fits = F.lit(False)
        for n, countries in IBAN_LENGTHS.items():
            fits = fits | ((F.length(bare) == n) & F.left(bare, F.lit(2)).isin(*countries.split()))
        return fits

    def cut(hit: Column, rest: Column) -> Column:
        def longest(tail: Column) -> Column:
            ends = F.filter(
                F.sequence(F.lit(11), F.length(tail)),
                lambda n: (F.substr(tail, n, F.lit(1)) != " ") & ~F.substr(rest, n + 1, F.lit(1)).rlike("[A-Za-z0-9]"))
            made = F.transform(ends, lambda n: F.struct(
                n.alias("n"), F.replace(F.concat(hit["value"], F.left(tail, n)), F.lit(" "), F.lit("")).alias("bare")))
            good = F.filter(made, lambda p: F.length(p["bare"]).between(15, 34) & mod97(p["bare"]))
            return F.array_max(F.transform(good, lambda p: F.struct(own_length(p["bare"]).alias("own"), p["n"].alias("n"))))["n"]

        return let(let(F.regexp_extract(rest, IBAN_TAIL, 0), longest), lambda n: F.struct(
            hit["start"].alias("start"), (hit["end"] + n).alias("end"), F.concat(hit["value"], F.left(rest, n)).alias("value"),
            hit["before"].alias("before"), F.substr(rest, n + 1, F.lit(CONTEXT)).alias("after")))

    def step(acc: Column, hit: Column) -> Column:
        return F.when(hit["start"] < acc["at"], acc).otherwise(
            F.struct(hit["end"].alias("at"), F.array_append(acc["out"], hit).alias("out")))

    starts = find_all(text, IBAN, r"[A-Z]{2}[0-9]{2}")
    cuts = F.filter(F.zip_with(starts, F.regexp_extract_all(text, F.lit(IBAN), 1), cut), lambda hit: hit["end"].isNotNull())
    zero = F.struct(F.lit(0).alias("at"), none.alias("out"))
    return F.when(text.rlike(IBAN), F.aggregate(cuts, zero, step, lambda acc: acc["out"])).otherwise(none)


def _spans(text: Column) -> Column:
    def kind(name: str, order: int, pattern: str, needs: str, valid: Column | None = None, found: Column | None = None) -> Column:
        low, high = SCORES[name]

        def score(hit: Column) -> Column:
            near = F.concat_ws(" ", hit["before"], hit["after"])
            return F.when(near.rlike(CONTEXT_WORDS[name]), F.lit(high)).otherwise(F.lit(low))

        found = find_all(text, pattern, needs) if found is None else found
        if valid is not None:
            found = F.filter(found, lambda hit: valid(hit["value"]))
        return F.filter(labelled(found, name, order, score), lambda s: s["score"] >= THRESHOLD)

    return merged([
        kind("email", 1, EMAIL, "@"),
        kind("ip", 2, IP, r"[0-9]\.[0-9]", lambda v: F.forall(F.split(v, r"\."), _small)),
        kind("card", 3, CARD, r"(?:[0-9][\x20-]?){13}[0-9]", _is_card),
        kind("phone", 4, PHONE, r"\+[0-9]", _is_phone),
        kind("iban", 5, IBAN, r"[A-Z]{2}[0-9]{2}", found=_ibans(text)),
        kind("local", 6, LOCAL, r"[0-9]{3}[\x20.-][0-9]{4}"),
    ])


def pii_spans(docs: DataFrame, text_col: str = "text", out_col: str = "pii") -> DataFrame:
    """``docs`` with ``out_col``: array of (start, order, kind, end, value, score), by start, then kind.

    A null text counts as empty. Rows, also repeated ones, are judged one by one, so nothing is shuffled and any row
    order or key is fine. A column that is already called ``out_col`` is replaced; all others stay.
    """
    return docs.withColumn(out_col, _spans(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))))
