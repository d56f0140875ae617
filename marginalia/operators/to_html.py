"""Markdown to HTML within the row: one pattern cuts a document into its blocks, each becomes HTML by its kind.

Nothing is spread by line, so no line is sorted or exchanged. The patterns run through a document once, without going back.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.html import escape
from marginalia.session import stored

# The parts of a heading and of a list item, as patterns of one line.
HEADING = r"^(#{1,6})\s*(.*?)\s*#*\s*$"
ITEM = r"^([ \t]*)([-*+]|\d+\.)\s+(.*)$"

# Within a document a line is what follows a line end; a return before the line end says that the next line has the same number.
# White space, what a dot finds, the rest of a line, and what a dollar finds. Where a class of characters may not go back it stands in a
# group: Java walks through that faster than through a possessive class. The signs stand for themselves to keep the pattern short, as
# Spark compares it with the last one for each document.
_SPACE, _ANY, _REST = "[ \t\x0b\x0c]", "(?>.*)", "(?>[^\n]*)"
_END = "(?=\n|\\z|[\r\u0085\u2028\u2029]\r?+(?:\n|\\z))"

# What a line of each kind begins with.
_FENCE = rf"{_SPACE}{{0,3}}+```"
_BLANK = r" *+(?=\r?+(?:\n|\z))"
_TASK = rf"{_SPACE}*+- \[[ xX]\] "
_HEADING = rf"#{_ANY}{_END}"
_RULE = rf" {{0,3}}+(?:(?:\*[ \t]*+){{3,}}+|(?:-[ \t]*+){{3,}}+|(?:_[ \t]*+){{3,}}+){_END}"
_QUOTE = r" {0,3}+>"
_AFTER = rf"{_SPACE}++{_ANY}{_END}"
_ITEM = rf"[ \t]*+(?:[-*+]|\d++\.){_AFTER}"
_DEEP = r"(?= {0,3}+\t| {4})"
# Columns are divided by a line of dashes; the line before it holds a bar.
_TABLE_RULE = rf"{_SPACE}*+(?:\|{_SPACE}*+)?+:?+-++:?+{_SPACE}*+(?:\|{_SPACE}*+:?+-++:?+{_SPACE}*+)*+(?:\|{_SPACE}*+)?+{_END}"
_TABLE = rf"(?=(?>[^\n|]*)\|{_REST}\n{_TABLE_RULE})"
# A fence that never closes is ordinary text.
_CODE_BLOCK = rf"{_FENCE}{_REST}(?:\n(?!{_FENCE}){_REST})*+\n{_FENCE}{_REST}"
# A line of a table or of text; a task or a rule wins over a list item.
_OTHER = rf"(?!{_CODE_BLOCK}|{_BLANK}|{_TASK}|{_HEADING}|{_RULE}|{_QUOTE}|{_ITEM}){_REST}"
_TEXT = rf"(?!{_TABLE}){_OTHER}"


def _list_block() -> str:
    """Items with their wrapped lines. Blank lines do not end a list if an item follows; an item of the other kind does,
    unless it or the item before it is indented. A wrapped line counts as one of an unordered item."""

    def line(start: str) -> str:
        return rf"(?!{_TASK}|{_RULE}){start}{_REST}"

    gap = rf"(?:\n{_BLANK}\r?+)*+\n"
    bullet, number = line(rf" {{0,3}}+[-*+]{_AFTER}"), line(rf" {{0,3}}+\d++\.{_AFTER}")
    deep = line(rf"{_DEEP}{_ITEM}")
    bullets = rf"(?:\n{_TEXT}|{gap}{bullet})*+"
    numbers = rf"(?:{gap}{number})*+(?:\n{_TEXT}{bullets})?+"
    after_deep = rf"(?:\n{_TEXT}{bullets}|{gap}{bullet}{bullets}|{gap}{number}{numbers})?+"
    return rf"(?:\n{bullet}{bullets}|\n{number}{numbers}|(?=\n{deep}))(?:{gap}{deep}{after_deep})*+"


# Blocks of a document that begins with a line end; blank lines belong to none. Tables are the first group.
BLOCK = (
    rf"\n(?:{_CODE_BLOCK}|{_TASK}{_REST}(?:\n{_TASK}{_REST})*+|{_HEADING}{_REST}|{_RULE}{_REST}|{_QUOTE}{_REST}(?:\n(?:{_QUOTE}{_REST}|{_TEXT}))*+)"
    rf"|{_list_block()}|\n(?:({_TABLE}{_OTHER}(?:\n{_OTHER})*+)|{_TEXT}(?:\n{_TEXT})*+)"
)
# A table whose line of dashes is a rule or an item, and so no part of it.
_BARE_TABLE = rf"\|[^\n|]*+\n(?={_TABLE_RULE})(?:{_RULE}|{_ITEM})"
# An item with its wrapped lines, in a list.
_ENTRY = rf"\n{_ITEM}{_REST}(?:\n(?!{_BLANK}|{_ITEM}){_REST}|(?<=\r)\n{_ITEM}{_REST})*+"

#: Bytes of text, with ``LINE_COST`` for each line, that one task takes: sorted and grouped, its lines take some ten times as much memory.
TASK_BYTES, LINE_COST = 64 << 20, 64

# A length beyond that of any text.
_ALL = (1 << 31) - 1

# Private-use marks for code spans and protected signs while the rest of a line is formatted.
_CODE = ("\ue010", "\ue011")
_STAR, _UNDER = "\ue012", "\ue013"
# Text without any of these has no spans; only with the first ones can it hold more than stressed words.
_MARKS = rf"[{_CODE[0]}-{_UNDER}]"
_SIGNS = rf"[`&<\\\[~{_CODE[0]}-{_UNDER}]"
_STRESSED = r"[*_\n]"



def _given(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times; a fold over nothing, as taking an element of an array would ask for the type of the whole body each time."""
    return F.aggregate(F.array().cast("array<int>"), value, lambda given, _: given, body)


def _either(test: Column, first: Column, second: Column) -> Column:
    """One of two values, without the list of cases that ``when`` walks through for each text."""
    return F.call_function("if", test, first, second)


def _task_html(line: Column) -> Column:
    def built(bare: Column) -> Column:
        state = _either(F.substring(bare, 4, 1) == " ", F.lit("unchecked"), F.lit("checked"))
        return F.concat(F.lit('<li class="'), state, F.lit('">'), escape(F.substring(bare, 7, _ALL)), F.lit("</li>"))

    return _given(F.regexp_replace(line, r"^\s+", ""), built)


def _code_escaped(text: Column) -> Column:
    """Inside code nothing is formatted, so its stars and underscores are hidden."""
    return F.translate(escape(text), "*_", _STAR + _UNDER)


def _where(sign: str) -> Callable[[Callable[[Column], Column]], Callable[[Column], Column]]:
    """Makes a step pass texts as they are that do not hold the sign it looks for."""
    return lambda step: lambda text: _given(text, lambda t: _either(F.contains(t, F.lit(sign)), step(t), t))


def _replaced(sign: str, *rules: tuple[str, str]) -> Callable[[Column], Column]:
    return _where(sign)(lambda text: reduce(lambda out, rule: F.regexp_replace(out, *rule), rules, text))


def _in_turn(*steps: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda text: reduce(lambda out, step: step(out), steps, text)


def _spans_of_code(text: Column) -> Column:
    parts = F.regexp_extract_all(text, F.lit("`[^`]+`|[^`]+|`"), F.lit(0))
    return F.array_join(
        F.transform(
            parts,
            lambda p: F.when(
                F.rlike(p, F.lit("(?s)^`[^`]+`$")),
                F.concat(F.lit(_CODE[0]), _code_escaped(F.substring(p, F.lit(2), F.length(p) - 2)), F.lit(_CODE[1])),
            ).otherwise(p),
        ),
        "",
    )


def _shown(text: Column) -> Column:
    """Marks back to what they stand for."""

    def shown(marked: Column) -> Column:
        out = F.translate(marked, _STAR + _UNDER, "*_")
        return F.replace(F.replace(out, F.lit(_CODE[0]), F.lit("<code>")), F.lit(_CODE[1]), F.lit("</code>"))

    return _given(text, lambda t: _either(F.rlike(t, F.lit(_MARKS)), shown(t), t))


@_where("\\")
def _escaped(text: Column) -> Column:
    """Escaped stars and underscores must survive the emphasis rules."""
    return F.replace(F.replace(text, F.lit("\\*"), F.lit(_STAR)), F.lit("\\_"), F.lit(_UNDER))


_marked = _in_turn(
    _where("`")(_spans_of_code),
    _replaced("&", (r"&(?!#?\w+;)", "&amp;")),
    _replaced("<", (r"<(?![a-zA-Z/!])", "&lt;")),
    _escaped,
    _replaced("<", (r"<((?:https?|ftp)://[^\s>]+)>", '<a href="$1">$1</a>')),
    _replaced("](", (r"!\[([^\]]*)\]\(([^)\s]*)\)", '<img alt="$1" src="$2" />'), (r"\[([^\]]*)\]\(([^)\s]*)\)", '<a href="$2">$1</a>')),
    _replaced("~~", (r"~~(.+?)~~", "<strike>$1</strike>")),
    _replaced("\\", (r"\\([\\`*_{}\[\]()#+.!-])", "$1")),
)
_stressed = _in_turn(
    _replaced("***", (r"(?s)\*\*\*(?=\S)(.+?)(?<=\S)\*\*\*", "<b><i>$1</i></b>")),
    _replaced("**", (r"(?s)\*\*(?=\S)(.+?)(?<=\S)\*\*", "<b>$1</b>")),
    _replaced("__", (r"(?s)(?<!\w)__(?=\S)(.+?)(?<=\S)__(?!\w)", "<b>$1</b>")),
    _replaced("*", (r"(?s)\*(?=[^\s*])(.+?)(?<=[^\s*])\*", "<i>$1</i>")),
    _replaced("_", (r"(?s)(?<!\w)_(?=\S)(.+?)(?<=\S)_(?!\w)", "<i>$1</i>")),
    _replaced("  \n", (r" {2,}\n", "<br />\n")),
)


def inline(text: Column) -> Column:
    """Spans of one block: code, images, links, bold, italic, strike; stray & and < become entities."""

    def formatted(text: Column) -> Column:
        # Nothing but a word or number as code is common in tables.
        only_code = text.startswith("`") & F.rlike(text, F.lit(r"\A`[\w .,:;/()+=-]+`\z"))
        code = F.concat(F.lit("<code>"), F.substring(text, F.lit(2), F.length(text) - 2), F.lit("</code>"))
        return _either(only_code, code, _in_turn(_marked, _stressed, _shown)(text))

    stressed = lambda t: _either(F.rlike(t, F.lit(_STRESSED)), _stressed(t), t)
    return _given(text, lambda t: _either(F.rlike(t, F.lit(_SIGNS)), formatted(t), stressed(t)))


def _spread(rows: DataFrame) -> DataFrame:
    """Documents (doc, text) by key over as many tasks as their lines need, for work that makes rows of lines; the conversion makes none."""
    rows = stored(rows, "markdown")
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n")))
    size = rows.agg(F.sum(F.octet_length("text") + (breaks + 1) * LINE_COST)).first()[0] or 0
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(max(least, -(-size // TASK_BYTES)), "doc")


def _text(block: Column) -> Column:
    return F.replace(F.substring(block, 2, _ALL), F.lit("\r"), F.lit(""))


def _lines(block: Column) -> Column:
    return F.split(_text(block), "\n", -1)


def _item(entry: Column) -> Column:
    """``depth, ordered, text`` of an item with its wrapped lines."""
    indent = F.replace(F.regexp_extract(entry, r"\A\n([ \t]*)", 1), F.lit("\t"), F.lit("    "))
    depth = F.when(F.rlike(entry, F.lit(rf"\A\n{_DEEP}")), F.floor(F.length(indent) / 4).cast("int")).otherwise(0)

    def content(line: Column) -> Column:
        return F.trim(F.when(F.rlike(line, F.lit(ITEM)), F.regexp_extract(line, ITEM, 3)).otherwise(line))

    def joined(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("\n")), F.array_join(F.transform(F.split(text, "\n", -1), content), "\n")).otherwise(F.trim(F.regexp_extract(text, ITEM, 3)))

    ordered = F.rlike(entry, F.lit(r"\A\n[ \t]*+\d"))
    return F.struct(depth.alias("depth"), ordered.alias("ordered"), inline(_given(_text(entry), joined)).alias("text"))


def _list_html(items: Column) -> Column:
    """Lists from ``(depth, ordered, text)``; where the depth changes, a list opens or closes."""

    def tag(ordered: Column) -> Column:
        return F.when(ordered, "ol").otherwise("ul")

    def close(stack: Column, keep: Column) -> Column:
        gone = F.reverse(F.slice(stack, keep + 1, F.greatest(F.lit(0), F.size(stack) - keep)))
        return F.array_join(F.transform(gone, lambda t: F.concat(F.lit("</li>\n</"), t, F.lit(">\n"))), "")

    def step(acc: Column, item: Column) -> Column:
        deepest = F.size(acc["stack"])
        level = F.least(item["depth"], deepest) + 1
        deeper = level > deepest
        opened = F.concat(F.when(deepest > 0, "\n").otherwise(""), F.lit("<"), tag(item["ordered"]), F.lit(">\n<li>"))
        nexted = F.concat(close(acc["stack"], level), F.lit("</li>\n<li>"))
        html = F.concat(acc["html"], F.when(deeper, opened).otherwise(nexted), item["text"])
        stack = F.when(deeper, F.concat(acc["stack"], F.array(tag(item["ordered"])))).otherwise(F.slice(acc["stack"], F.lit(1), level))
        return F.struct(stack.alias("stack"), html.alias("html"))

    def flat(items: Column) -> Column:
        kind = tag(items[0]["ordered"])
        texts = F.array_join(F.transform(items, lambda item: item["text"]), "</li>\n<li>")
        return F.concat(F.lit("<"), kind, F.lit(">\n<li>"), texts, F.lit("</li>\n</"), kind, F.lit(">"))

    start = F.struct(F.array().cast("array<string>").alias("stack"), F.lit("").alias("html"))
    nested = F.aggregate(
        items, start, step, lambda acc: F.regexp_replace(F.concat(acc["html"], close(acc["stack"], F.lit(0))), r"\s+\z", "")
    )
    return F.when(F.exists(items, lambda item: item["depth"] > 0), nested).otherwise(flat(items))


def _cells(row: Column) -> Column:
    def bare(row: Column) -> Column:
        barred = row.startswith("|") & row.endswith("|") & (F.length(row) > 1) & ~F.contains(row, F.lit("\\"))
        return _either(barred, F.substring(row, F.lit(2), F.length(row) - 2), F.regexp_replace(row, r"^\||(?<!\\)\|$", ""))

    def cut(bare: Column) -> Column:
        # A pattern of one sign is not compiled again for each row.
        return _either(F.contains(bare, F.lit("\\")), F.split(bare, r"(?<!\\)\|", -1), F.split(bare, r"\|", -1))

    return F.transform(_given(_given(F.trim(row), bare), cut), lambda c: inline(F.replace(F.trim(c), F.lit("\\|"), F.lit("|"))))


def _row_html(cells: Column, tag: str, width: Column) -> Column:
    # Short rows are filled up, long ones cut, to the width of the header.
    filled = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.get(cells, i), F.lit("")))
    even = _either(F.size(cells) == width, cells, filled)
    return F.concat(F.lit(f"<tr>\n<{tag}>"), F.array_join(even, f"</{tag}>\n<{tag}>"), F.lit(f"</{tag}>\n</tr>"))


def _table_html(lines: Column) -> Column:
    def built(rows: Column) -> Column:
        width = F.size(rows[0])
        shown = F.transform(F.slice(rows, F.lit(2), F.size(rows)), lambda cells: _row_html(cells, "td", width))
        body = _either(F.size(rows) > 1, F.concat(F.lit("<tbody>\n"), F.array_join(shown, "\n"), F.lit("\n</tbody>\n")), F.lit(""))
        return F.concat(F.lit("<table>\n<thead>\n"), _row_html(rows[0], "th", width), F.lit("\n</thead>\n"), body, F.lit("</table>"))

    # The second line only divides.
    return _given(F.transform(F.filter(lines, lambda _, i: i != 1), _cells), built)


def _code_html(lines: Column) -> Column:
    code = F.array_join(F.slice(lines, F.lit(2), F.size(lines) - 2), "\n")
    return _given(code, lambda c: F.concat(F.lit("<pre><code>"), escape(c), F.when(c == "", "").otherwise("\n"), F.lit("</code></pre>")))


def _block_html(block: Column, is_table: Column) -> Column:
    """HTML of a block, which begins with a line end and is of the first kind that its first line fits."""
    text = _text(block)

    def starts(pattern: str, sign: str = "") -> Column:
        """Whether the first line fits; a sign without which it cannot is quicker to look for."""
        fits = F.rlike(block, F.lit(rf"\A\n{pattern}"))
        return F.contains(block, F.lit(sign)) & fits if sign else fits

    def worded(title: Column) -> Column:
        """A heading, a quote or text around its spans."""
        level = F.length(F.regexp_extract(text, HEADING, 1))
        heading = _given(level, lambda n: F.when(n > 3, "div").otherwise(F.concat(F.lit("h"), n.cast("string"))))
        tag = _either(is_heading, heading, F.lit("div"))
        shown = _given(tag, lambda tag: F.concat(F.lit("<"), tag, F.lit(">"), title, F.lit("</"), tag, F.lit(">")))
        return _either(is_quote, F.concat(F.lit("<blockquote>\n"), shown, F.lit("\n</blockquote>")), shown)

    is_heading, is_quote = starts(_HEADING, "\n#"), starts(_QUOTE, ">")
    words = (
        F.when(is_heading, F.regexp_extract(text, HEADING, 2)).when(is_quote, F.trim(F.regexp_replace(text, r"(?m)^ {0,3}> ?", ""))).otherwise(F.trim(text))
    )
    block_level = F.rlike(text, F.lit(r"(?i)^<(?:div|ul|ol|table|pre|h[1-6]|blockquote|p|hr)\b"))
    return (
        F.when(starts(_CODE_BLOCK, "```"), _given(_lines(block), _code_html))
        .when(starts(_TASK, "- ["), F.concat(F.lit('<ul class="checklist">'), F.array_join(F.transform(_lines(block), _task_html), ""), F.lit("</ul>")))
        .when(~is_heading & starts(_RULE), "<hr />")
        .when(~is_heading & ~is_quote & starts(_ITEM), _given(F.transform(F.regexp_extract_all(block, F.lit(_ENTRY), F.lit(0)), _item), _list_html))
        .when(~is_heading & ~is_quote & (starts(_TABLE, "|") | is_table), _given(_lines(block), _table_html))
        .when(block_level, text)
        .otherwise(_given(inline(words), worded))
    )


def _placed(parts: Column) -> Column:
    """Each block after what stands between it and the one before: two lists of different kinds must not run together."""

    def placed(part: Column, i: Column) -> Column:
        before = F.coalesce(F.get(parts, i - 1), F.lit(""))
        apart = (before.endswith("</ul>") & part.startswith("<ol")) | (before.endswith("</ol>") & part.startswith("<ul"))
        between = F.when(i == 0, "").when(apart, "<div><br></div>").otherwise("\n")
        return F.concat(between, part)

    ordered = F.exists(parts, lambda part: part.startswith("<ol") | part.endswith("</ol>"))
    return F.when(ordered, F.array_join(F.transform(parts, placed), "")).otherwise(F.array_join(parts, "\n"))


def _merged(texts: Column) -> Column:
    """Texts of one key as one: the first lines of all, then the second ones. Lines of one number are told by a return."""

    def dealt(texts: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.array_max(F.transform(texts, F.size)) - 1)
        return F.transform(numbers, lambda i: F.array_join(F.array_sort(F.transform(texts, lambda t: F.get(t, i))), "\r\n"))

    lines = F.transform(texts, lambda t: F.split(t, "\n", -1))
    return F.when(F.size(texts) == 1, texts[0]).otherwise(F.array_join(_given(lines, dealt), "\n"))


def _by_key(rows: DataFrame) -> DataFrame:
    """Documents (doc, text) with one row a key; rows that are sorted by key already, as after a join, are not sorted again."""
    same = Window.partitionBy("doc")
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    rows = rows.select("doc", "row", F.collect_list("text").over(same).alias("texts"), F.min("row").over(same).alias("first"))
    return rows.where(F.col("row") == F.col("first")).select("doc", _merged(F.col("texts")).alias("text"))


def markdown_to_html(rows: DataFrame, key: str, markdown: str) -> DataFrame:
    """``key, html`` for documents with a unique key."""
    text = F.coalesce(F.col(markdown), F.lit(""))
    text = F.when(F.contains(text, F.lit("\r")), F.regexp_replace(text, "\r\n?", "\n")).otherwise(text)
    rows = _by_key(rows.select(F.col(key).alias("doc"), text.alias("text")))
    rows = rows.select("doc", F.concat(F.lit("\n"), "text").alias("text"))
    blocks = F.regexp_extract_all("text", F.lit(BLOCK), F.lit(0))
    tables = F.when(F.rlike("text", F.lit(_BARE_TABLE)), F.regexp_extract_all("text", F.lit(BLOCK), F.lit(1))).otherwise(F.array().cast("array<string>"))
    parts = _given(tables, lambda tables: F.transform(blocks, lambda block, i: _block_html(block, F.coalesce(F.get(tables, i) != "", F.lit(False)))))
    # Only markup that stood in the text as it is can end otherwise.
    trimmed = _given(_given(parts, _placed), lambda html: F.when(html.endswith(">"), html).otherwise(F.trim(F.regexp_replace(html, r"\A\s+|\s+\z", ""))))
    return rows.select(F.col("doc").alias(key), trimmed.alias("html"))
