"""Note bodies: gzip, protobuf wire format, style runs."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Field numbers of document > note > text and attribute runs, and the checkbox style.
DOCUMENT, NOTE, NOTE_TEXT, RUN = 2, 3, 2, 5
RUN_LENGTH, RUN_STYLE, STYLE_TYPE, STYLE_CHECKLIST, CHECK_DONE = 1, 2, 1, 5, 2
STYLE_DEFAULT, STYLE_CHECKBOX = -1, 103
GZIP_MAGIC = b"\x1f\x8b"
MIN_PRINTABLE = 0.9

RUNS = "array<struct<offset:int,length:int,style_type:int,is_checked:boolean>>"
BODY = f"struct<text:string,runs:{RUNS}>"


def _inflate(blob: bytes) -> bytes:
    stream = zlib.decompressobj(wbits=31)
    data = stream.decompress(blob) + stream.flush()
    if not stream.eof:
        raise ValueError("truncated gzip stream")
    return data


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        value |= (byte & 127) << shift
        at, shift = at + 1, shift + 7
        if byte < 128:
            return value, at


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field number and value; a malformed tail raises."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            value, at = data[at : at + size], at + size
            if len(value) == size:
                continue
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def _strings(data: bytes) -> Iterator[str]:
    """Printable strings at any depth; whatever is not one is searched as a message."""
    found = fields(data)
    while True:
        try:
            _, value = next(found)
        except (StopIteration, IndexError, ValueError):
            return
        if not isinstance(value, bytes):
            continue
        try:
            text = value.decode()
        except UnicodeDecodeError:
            text = ""
        bare = text.replace("\n", "").replace("\r", "").replace("\t", "")
        # Most texts hold nothing else, which one call tells.
        odd = 0 if bare.isprintable() else sum(not c.isprintable() for c in bare)
        if text and (len(text) - odd) / len(text) > MIN_PRINTABLE:
            yield text
        else:
            yield from _strings(value)


def longest_string(blob: bytes | None) -> str:
    """Body text without a schema: the longest string of a gzipped message, blank if unreadable."""
    try:
        return max(_strings(_inflate(blob)), key=len, default="") if blob else ""
    except (zlib.error, ValueError, EOFError, RecursionError):
        return ""


def _first(data: bytes, number: int, default=None):
    return next((v for n, v in fields(data) if n == number), default)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def decode_body(blob: bytes | None) -> dict | None:
    """Text and style runs by the schema; null for anything that is not such a message."""
    if not blob:
        return None
    try:
        data = _inflate(blob) if blob[:2] == GZIP_MAGIC else bytes(blob)
        note = _first(_first(data, DOCUMENT, b""), NOTE, b"")
        runs, offset = [], 0
        for number, run in fields(note):
            if number != RUN:
                continue
            length, style = _first(run, RUN_LENGTH, 0), _first(run, RUN_STYLE)
            kind = STYLE_DEFAULT if style is None else _signed(_first(style, STYLE_TYPE, 2**64 - 1))
            checklist = _first(style, STYLE_CHECKLIST) if kind == STYLE_CHECKBOX else None
            done = None if checklist is None else bool(_first(checklist, CHECK_DONE, 0))
            runs.append({"offset": offset, "length": length, "style_type": kind, "is_checked": done})
            offset += length
        return {"text": _first(note, NOTE_TEXT, b"").decode(), "runs": runs}
    except (zlib.error, ValueError, IndexError, TypeError, AttributeError, EOFError):
        return None


def _body_text(blobs: pd.Series) -> pd.Series:
    return blobs.map(longest_string)


def _body(blobs: pd.Series) -> pd.DataFrame:
    found = [decode_body(b) or {"text": None, "runs": None} for b in blobs]
    return pd.DataFrame(found, columns=["text", "runs"])


def body_text(blob: Column) -> Column:
    return F.pandas_udf(_body_text, "string")(blob)


def body_struct(blob: Column) -> Column:
    """``struct<text, runs>``; the text is null when the blob cannot be read."""
    return F.pandas_udf(_body, BODY)(blob)


def pick_blob(mergeable: Column, data: Column) -> Column:
    """The mergeable blob if it holds anything, else the plain one."""
    filled = F.when(F.length(mergeable) > 0, mergeable)
    return F.coalesce(filled, F.when(F.length(data) > 0, data))
