"""Small fixtures, and plain versions of the operators to compare with."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use inside or give to results.
CLASHING = ("_row", "key", "row", "n", "idx", "part", "class_row", "links", "stats", "tokens", "given_0", "_kept", "run")


def documents(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    rows = [
        (i, t, ("en", "fr", None)[n % 3], f"src{n % 2}" if n % 5 else None, None if t is None else len(t))
        for n, (i, t) in enumerate(zip(ids, texts, strict=True))
    ]
    return spark.createDataFrame(rows, DOCS)


def clashing(docs):
    from pyspark.sql import functions as F

    return docs.withColumns({c: F.lit(f"given {c}") for c in CLASHING})


def sha(data: bytes | str) -> str:
    return hashlib.sha256(data.encode() if isinstance(data, str) else data).hexdigest()


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def pii_base(text: str) -> list[tuple]:
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 1, "email", m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(p) <= 255 for p in m[0].split(".")):
            out.append((m.start(), 2, "ip", m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 3, "card", m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 4, "phone", m.end()))
    return sorted(out)


def secrets_base(text: str) -> list[tuple]:
    out = []
    assign = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    for m in re.finditer(assign, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            out.append((m.start(), 1, "assign", m.end()))
    for m in re.finditer(r"AKIA[A-Z0-9]+", text):
        if len(m[0]) >= 20:
            out.append((m.start(), 2, "access", m.end()))
    for m in re.finditer(r"[0-9a-f]+", text):
        if len(m[0]) >= 24:
            out.append((m.start(), 3, "hex", m.end()))
    return sorted(out)


def joined(spans) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, _, kind, end in spans)


def statistics(text: str) -> tuple:
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    seen = Counter(grams)
    covered = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))


def without_repeats(bodies: list[bytes], length: int, keep_first: bool) -> list[tuple[bytes, list[tuple[int, int]]]]:
    """Each body without the bytes of strings that occur elsewhere (or only earlier), and the removed spans."""
    seen: Counter = Counter(b[i : i + length] for b in bodies for i in range(len(b) - length + 1))
    met: set[bytes] = set()
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            s = b[i : i + length]
            if (s in met) if keep_first else seen[s] > 1:
                gone[i : i + length] = b"\1" * length
            met.add(s)
        spans, start = [], None
        for i, g in enumerate([*gone, 0]):
            if g and start is None:
                start = i
            elif not g and start is not None:
                spans.append((start, i))
                start = None
        out.append((bytes(x for x, g in zip(b, gone, strict=True) if not g), spans))
    return out
