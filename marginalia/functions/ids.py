"""Identifiers, cursors, clocks and hashes."""

from __future__ import annotations

import base64
import binascii
import json
from datetime import datetime, timedelta, timezone

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.config import CHARS_PER_TOKEN

CORE_DATA_EPOCH = 978307200
DEFAULT_TOKENS = 512
MIN_TOKENS = 256

_ID_PATTERN = r"^([pf])([0-9]+)$"
_URI_PATTERN = r"/(ICNote|ICFolder)/p([0-9]+)$"


def short_id(pk: Column) -> Column:
    return F.concat(F.lit("p"), pk.cast("string"))


def short_folder_id(pk: Column) -> Column:
    return F.concat(F.lit("f"), pk.cast("string"))


def id_kind(raw: Column) -> Column:
    """``note`` or ``folder``, null for anything that is not an identifier."""
    text = F.trim(raw)
    letter = F.regexp_extract(text, _ID_PATTERN, 1)
    entity = F.regexp_extract(text, _URI_PATTERN, 1)
    return (
        F.when((letter == "p") | (entity == "ICNote"), "note")
        .when((letter == "f") | (entity == "ICFolder"), "folder")
    )


def id_pk(raw: Column) -> Column:
    text = F.trim(raw)
    digits = F.coalesce(
        F.nullif(F.regexp_extract(text, _ID_PATTERN, 2), F.lit("")),
        F.nullif(F.regexp_extract(text, _URI_PATTERN, 2), F.lit("")),
    )
    return F.expr("try_cast(1 as bigint)") * digits.try_cast("bigint")


def parse_id(raw: str) -> tuple[str, int]:
    """Driver-side form of :func:`id_kind` and :func:`id_pk` for one argument."""
    text = (raw or "").strip()
    for letter, entity, kind in (("p", "ICNote", "note"), ("f", "ICFolder", "folder")):
        for tail in (text[1:] if text[:1] == letter else "", text.rpartition(f"/{entity}/p")[2] if f"/{entity}/p" in text else ""):
            if tail.isascii() and tail.isdigit():
                return kind, int(tail)
    raise ValueError(f"unrecognised id: {raw!r}")


def full_uri(store_uuid: Column | str, entity: str, pk: Column) -> Column:
    uuid = store_uuid if isinstance(store_uuid, Column) else F.lit(store_uuid)
    return F.format_string("x-coredata://%s/%s/p%d", uuid, F.lit(entity), pk)


def cursor_of(offset: Column) -> Column:
    """URL-safe base64 of the decimal offset."""
    return F.translate(F.base64(offset.cast("string").cast("binary")), "+/", "-_")


def offset_of(cursor: Column) -> Column:
    plain = F.unbase64(F.translate(cursor, "-_", "+/")).cast("string")
    return plain.try_cast("bigint")


def encode_cursor(offset: int) -> str:
    if offset < 0:
        raise ValueError("cursor offset must not be negative")
    return base64.urlsafe_b64encode(str(offset).encode()).decode()


def encode_state(**state: int | str | None) -> str:
    """A cursor that carries more than an offset."""
    return base64.urlsafe_b64encode(json.dumps(state, sort_keys=True).encode()).decode()


def decode_state(cursor: str | None, *names: str) -> dict | None:
    """What :func:`encode_state` was given, which must be exactly ``names``; nothing for the first page."""
    if cursor is None:
        return None
    try:
        state = json.loads(base64.urlsafe_b64decode(cursor.encode()))
    except (binascii.Error, UnicodeError, ValueError):
        raise ValueError(f"invalid cursor: {cursor!r}") from None
    if not isinstance(state, dict) or sorted(state) != sorted(names):
        raise ValueError(f"invalid cursor: {cursor!r}")
    return state


def decode_cursor(cursor: str | None) -> int:
    if cursor is None:
        return 0
    try:
        offset = int(base64.urlsafe_b64decode(cursor.encode()).decode())
    except (binascii.Error, UnicodeError, ValueError):
        raise ValueError(f"invalid cursor: {cursor!r}") from None
    if offset < 0:
        raise ValueError(f"invalid cursor: {cursor!r}")
    return offset


def catalog_time(seconds: Column) -> Column:
    """Catalog clock to a timestamp; a missing value is the start of the catalog epoch."""
    return F.timestamp_seconds(F.coalesce(seconds, F.lit(0.0)) + CORE_DATA_EPOCH)


def index_time(seconds: Column) -> Column:
    """Catalog clock to whole Unix seconds as the index stores it; a missing value is 0."""
    return F.when(seconds.isNull(), F.lit(0)).otherwise((seconds + CORE_DATA_EPOCH).cast("bigint")).cast("bigint")


def display_time(ts: Column) -> Column:
    """Minute precision in UTC whatever the session's zone, blank for the Unix epoch and for null."""
    moved = F.convert_timezone(F.current_timezone(), F.lit("UTC"), ts.cast("timestamp").cast("timestamp_ntz"))
    shown = F.date_format(moved, "yyyy-MM-dd HH:mm")
    return F.when(ts.isNull() | (F.unix_timestamp(ts) == 0), "").otherwise(shown)


def parse_instant(raw: str | None) -> datetime | None:
    """ISO-8601 argument to an instant; a value without a zone is UTC."""
    if not raw:
        return None
    try:
        value = datetime.fromisoformat(raw)
    except ValueError:
        raise ValueError(f"invalid ISO-8601 time: {raw!r}") from None
    return value if value.tzinfo else value.replace(tzinfo=timezone.utc)


def micros(at: datetime) -> int:
    """Microseconds since 1970, without the rounding of a float."""
    return (at - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(microseconds=1)


def content_hash(head: Column, content: Column) -> Column:
    """First 32 hex digits of sha256 over head, a blank line and content."""
    payload = F.concat(F.coalesce(head, F.lit("")), F.lit("\n\n"), content)
    return F.substring(F.sha2(payload, 256), 1, 32)


def chunk_key(node_id: Column, index: Column) -> Column:
    return F.concat_ws("#", node_id, index.cast("string"))


def approx_tokens(text: Column) -> Column:
    estimate = F.floor(F.length(text) / F.lit(CHARS_PER_TOKEN) * F.lit(1.1)).cast("int")
    return F.greatest(F.lit(1), estimate)


def effective_tokens(advertised: Column, discovered: Column) -> Column:
    return F.coalesce(F.least(advertised, discovered), F.lit(DEFAULT_TOKENS))


def ratcheted_tokens(discovered: Column, observed: Column) -> Column:
    """Capacity after a chunk of ``observed`` tokens was refused; it never grows. Without a refusal it stays."""
    reduced = F.greatest(F.lit(MIN_TOKENS), F.floor(observed * F.lit(0.9)).cast("int"))
    return F.least(discovered, F.when(observed.isNotNull(), reduced))
