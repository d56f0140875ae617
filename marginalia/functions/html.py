"""HTML as an array of tokens: splitting, entities, repair of the nesting, plain text."""

from __future__ import annotations

import json
from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.exprs import NOT_SPACE, SPACE, let, strip

# Tags with quoted attributes, else any text up to the bracket.
_QUOTED = r"""</?[a-zA-Z][^>"'\s/]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""
_TAG = rf"{_QUOTED}|</?[a-zA-Z][^>]*+>"
_ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[a-zA-Z][a-zA-Z0-9]*+);?"
TOKEN = (
    r"(?is)<!--.*?-->|<(?:script\b[^>]*+>.*?</script|style\b[^>]*+>.*?</style)\s*+>|<[!?][^>]*+>"
    rf"|{_TAG}|{_ENTITY}|[^<&]++|[<&]"
)

# Tags that break lines in plain text.
LINE_TAGS = (
    "p", "div", "br", "li", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "tr", "hr",
)
# Elements without content, and elements that end an open paragraph.
VOID_TAGS = (
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr",
)
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "dd", "div", "dl", "dt", "fieldset", "footer", "form", "h1", "h2",
    "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul",
)


def tokens(html: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(TOKEN), F.lit(0))


def is_raw(token: Column) -> Column:
    return F.rlike(token, F.lit(r"(?is)\A<(?:script|style)\b[^>]*+>.*</"))


def is_tag(token: Column) -> Column:
    return F.rlike(token, F.lit(r"(?s)\A</?[a-zA-Z].*>\z"))


def is_markup(token: Column) -> Column:
    return F.rlike(token, F.lit(r"(?s)\A<[!?].*>\z"))


def tag_name(token: Column) -> Column:
    return F.lower(F.regexp_extract(token, r"^</?([a-zA-Z][^\s/>]*)", 1))


def attribute(tag: Column, name: str) -> Column:
    """Value of an attribute, null if absent."""
    quoted = rf"""(?is)\s{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))"""
    value = F.concat(*[F.regexp_extract(tag, quoted, i) for i in (1, 2, 3)])
    return F.when(F.rlike(tag, F.lit(quoted)), value)


# -- entities ----------------------------------------------------------------


@cache
def _entity_tables() -> tuple[str, str]:
    """Named references as JSON, and the names that also work without a semicolon, longest first."""
    odd = {f"#{n};": bytes([n]).decode("cp1252", errors="replace") for n in range(128, 160)}
    bare = sorted((name for name in html5 if not name.endswith(";")), key=lambda n: (-len(n), n))
    return json.dumps({**html5, **odd}), "|".join(bare)


def decode_entity(token: Column) -> Column:
    """Text of one character reference; anything unknown stays as written."""
    table, bare = _entity_tables()
    known = F.from_json(F.lit(table), "map<string,string>")
    name = F.substring(token, F.lit(2), F.length(token) - 1)
    digits = F.regexp_extract(token, "^&#([0-9]+)", 1)
    hexes = F.regexp_extract(token, "^&#[xX]([0-9a-fA-F]+)", 1)
    number = F.coalesce(digits.try_cast("int"), F.conv(F.nullif(hexes, F.lit("")), 16, 10).try_cast("int"))

    def numeric(n: Column) -> Column:
        odd = F.try_element_at(known, F.concat(F.lit("#"), n.cast("string"), F.lit(";")))
        bad = n.isNull() | (n == 0) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
        plain = F.decode(F.unhex(F.lpad(F.hex(n.cast("bigint")), 8, "0")), "UTF-32")
        return F.when(bad, "�").when(n.between(128, 159), odd).otherwise(plain)

    def named(prefix: Column) -> Column:
        tail = F.substring(token, F.length(prefix) + 2, F.length(token))
        return F.when(prefix != "", F.concat(F.try_element_at(known, prefix), tail))

    return (
        F.when(token == "&amp;", "&").when(token == "&lt;", "<").when(token == "&gt;", ">")
        .when(token == "&quot;", '"').when(token == "&nbsp;", "\u00a0").when(token == "&#39;", "'")
        .when(F.rlike(token, F.lit("^&#")), let(number, numeric))
        .otherwise(F.coalesce(
            F.try_element_at(known, name),
            let(F.regexp_extract(name, f"^({bare})", 1), named),
            token,
        ))
    )


def is_entity(token: Column) -> Column:
    return token.startswith("&") & (F.length(token) > 1)


# -- plain text --------------------------------------------------------------


def html_to_text(html: Column) -> Column:
    """Readable text: block tags break lines, script and style text stays, blank runs shrink to one line."""

    def shown(t: Column) -> Column:
        breaks = F.when(t.endswith("/>"), "\n\n").otherwise("\n")
        return (
            F.when(is_entity(t), decode_entity(t))
            .when(~t.startswith("<"), t)
            .when(is_raw(t), F.regexp_extract(t, r"(?s)\A<[^>]*+>(.*)</", 1))
            .when(is_tag(t), F.when(tag_name(t).isin(*LINE_TAGS), breaks).otherwise(""))
            .when(is_markup(t), "")
            .otherwise(t)
        )

    text = F.array_join(F.transform(tokens(html), shown), "")
    lines = F.regexp_replace(text, "\r\n|[\r\u000b\f\u001c\u001d\u001e\u0085\u2028\u2029]", "\n")
    blank = r"[\s\x1c-\x1f&&[^\n]]"
    bare = F.regexp_replace(lines, rf"(?U)(?<!{blank}){blank}++(?=\n|\z)", "")
    return strip(F.regexp_replace(bare, r"\n{3,}", "\n\n"))


# -- nesting -----------------------------------------------------------------


def _fix(at: Column, before: Column, drop: bool) -> Column:
    return F.struct(at.alias("at"), before.alias("before"), F.lit(drop).alias("drop"))


_STATE = "struct<stack:array<string>,fixes:array<struct<at:int,before:array<string>,drop:boolean>>>"


def _popped(stack: Column, name: Column) -> Column:
    """Tags above and including the innermost ``name``, innermost first."""
    return F.slice(F.reverse(stack), F.lit(1), F.array_position(F.reverse(stack), name).cast("int"))


def _implied(stack: Column, name: Column) -> Column:
    """What a start tag closes by itself: an open paragraph, the previous item, cell or row."""
    top = F.coalesce(F.try_element_at(stack, F.lit(-1)), F.lit(""))
    # Only inline tags may lie between the new tag and the paragraph it ends.
    inline = F.exists(_popped(stack, F.lit("p")), lambda t: t.isin("li", "td", "th", "table", "ul", "ol", "div", "blockquote"))
    paragraph = name.isin(*BLOCK_TAGS) & F.array_contains(stack, "p") & ~inline
    sibling = (
        F.when(name == "li", F.when(top == "li", "li"))
        .when(name.isin("td", "th"), F.when(top.isin("td", "th"), top))
        .when(name == "tr", F.when(top.isin("td", "th"), "tr").when(top == "tr", "tr"))
    )
    none = F.array().cast("array<string>")
    return F.when(paragraph, _popped(stack, F.lit("p"))).when(
        sibling.isNotNull() & F.array_contains(stack, sibling), _popped(stack, sibling)
    ).otherwise(none)


def repair(found: Column) -> Column:
    """Balance the tags: close what is left open, drop end tags without a start.

    The fold carries only the open tags and the places to mend, both short.
    """

    def state(stack: Column, fixes: Column) -> Column:
        return F.struct(stack.alias("stack"), fixes.alias("fixes")).cast(_STATE)

    def opened(acc: Column, i: Column, name: Column) -> Column:
        def with_closed(closed: Column) -> Column:
            rest = F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - F.size(closed))
            stack = F.when(name.isin(*VOID_TAGS), rest).otherwise(F.concat(rest, F.array(name)))
            fixes = F.when(F.size(closed) > 0, F.concat(acc["fixes"], F.array(_fix(i, closed, False)))).otherwise(acc["fixes"])
            return state(stack, fixes)

        return let(_implied(acc["stack"], name), with_closed)

    def ended(acc: Column, i: Column, name: Column) -> Column:
        none = F.array().cast("array<string>")

        def with_popped(popped: Column) -> Column:
            rest = F.slice(acc["stack"], F.lit(1), F.size(acc["stack"]) - F.size(popped))
            above = F.slice(popped, F.lit(1), F.size(popped) - 1)
            mended = F.concat(acc["fixes"], F.array(_fix(i, above, False)))
            return state(rest, F.when(F.size(popped) > 1, mended).otherwise(acc["fixes"]))

        stray = state(acc["stack"], F.concat(acc["fixes"], F.array(_fix(i, none, True))))
        known = F.array_contains(acc["stack"], name)
        return F.when(known, let(_popped(acc["stack"], name), with_popped)).otherwise(stray)

    def step(acc: Column, i: Column, toks: Column) -> Column:
        t = F.get(toks, i)
        tag = t.startswith("<") & is_tag(t) & ~is_raw(t)
        by_name = let(tag_name(t), lambda n: F.when(t.startswith("</"), ended(acc, i, n)).otherwise(opened(acc, i, n)))
        return F.when(tag, by_name).otherwise(acc)

    def mend(toks: Column) -> Column:
        start = state(F.array().cast("array<string>"), F.array().cast(
            "array<struct<at:int,before:array<string>,drop:boolean>>"))
        steps = F.filter(F.sequence(F.lit(0), F.size(toks)), lambda i: i < F.size(toks))
        return let(F.aggregate(steps, start, lambda acc, i: step(acc, i, toks)), lambda done: merged(toks, done))

    def closers(names: Column) -> Column:
        return F.transform(names, lambda n: F.concat(F.lit("</"), n, F.lit(">")))

    def merged(toks: Column, done: Column) -> Column:
        index = F.map_from_entries(F.transform(done["fixes"], lambda f: F.struct(f["at"], f)))

        def one(t: Column, i: Column, fixes: Column) -> Column:
            fix = F.try_element_at(fixes, i)
            kept = F.when(F.coalesce(fix["drop"], F.lit(False)), F.array().cast("array<string>")).otherwise(F.array(t))
            return F.when(fix.isNull(), F.array(t)).otherwise(F.concat(closers(fix["before"]), kept))

        whole = let(index, lambda fixes: F.flatten(F.transform(toks, lambda t, i: one(t, i, fixes))))
        return F.concat(whole, closers(F.reverse(done["stack"])))

    return let(found, mend)


# -- sanitising --------------------------------------------------------------

# Elements removed with their content, renamed, and allowed.
REMOVED = ("script", "style", "iframe", "form", "button")
REMOVED_EMPTY = ("embed", "input", "link")
RENAMED = {"strong": "b", "em": "i", "del": "strike", "s": "strike", "p": "div"}
ALLOWED = (
    "b", "i", "strike", "u", "h1", "h2", "h3", "ul", "ol", "li", "a", "img", "pre", "code", "table", "tr", "td", "th",
    "thead", "tbody", "br", "div", "blockquote",
)
_ATTRIBUTE = r"""(?s)\s([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+))?"""


def escape(text: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        text = F.replace(text, F.lit(char), F.lit(entity))
    return text


def _clean_tag(token: Column) -> Column:
    name = tag_name(token)
    renamed = F.when(F.rlike(name, F.lit("^h[4-9]$")), "div")
    for old, new in RENAMED.items():
        renamed = renamed.when(name == old, new)

    def attribute_text(a: Column) -> Column:
        key = F.lower(F.regexp_extract(a, _ATTRIBUTE, 1))
        value = F.regexp_replace(F.regexp_extract(a, _ATTRIBUTE, 2), r"""^["']|["']$""", "")
        return F.concat(F.lit(" "), key, F.lit('="'), F.replace(value, F.lit('"'), F.lit("&quot;")), F.lit('"'))

    pairs = F.filter(
        F.regexp_extract_all(token, F.lit(_ATTRIBUTE), F.lit(0)), lambda a: ~F.rlike(a, F.lit(r"(?i)^\son[a-z]+(?:\s*=|$)"))
    )
    attributes = F.array_join(F.transform(pairs, attribute_text), "")

    def built(n: Column) -> Column:
        start = F.concat(F.lit("<"), n, attributes, F.when(n.isin("br", "img"), "/>").otherwise(">"))
        end = F.when(n.isin("br", "img"), "").otherwise(F.concat(F.lit("</"), n, F.lit(">")))
        return F.when(~n.isin(*ALLOWED), "").when(token.startswith("</"), end).otherwise(start)

    return let(renamed.otherwise(name), built)


def sanitize(html: Column) -> Column:
    """Allowed tags only, without event handlers; dangerous elements go with their content."""
    pairs, singles = "|".join(REMOVED), "|".join(REMOVED_EMPTY)
    safe = F.regexp_replace(F.coalesce(html, F.lit("")), rf"(?is)<({pairs})\b[^>]*+>.*?</\1\s*+>", "")
    safe = F.regexp_replace(safe, rf"(?is)<(?:{pairs})\b[^>]*+>.*\z|</?(?:{pairs}|{singles})\b[^>]*+>", "")

    def shown(t: Column) -> Column:
        return (
            F.when(is_entity(t), escape(decode_entity(t)))
            .when(is_markup(t), t)
            .when(is_tag(t), _clean_tag(t))
            .otherwise(escape(t))
        )

    # Text before any element belongs to a paragraph.
    first = F.when(F.rlike(safe, F.lit(rf"(?U)\A{SPACE}*+(?:{NOT_SPACE}(?<!<)|<(?![a-zA-Z!/]))")), F.concat(F.lit("<p>"), safe))
    cleaned = let(repair(tokens(first.otherwise(safe))), lambda toks: F.array_join(F.transform(toks, shown), ""))
    return F.when(strip(F.coalesce(html, F.lit(""))) == "", "").otherwise(cleaned)
