"""HTML to Markdown as one pass of running windows over each document's tokens.

A document is spread by its key once. Running sums over its tokens then give every token its list,
quote and table, tokens group into lines, and lines group back into the document; all of it groups
within the key and adds no exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import html as H
from marginalia.functions.exprs import SPACE, let, strip
from marginalia.sources.layout import spread_by

# Private-use marks for inline spans until their line is complete.
_BOLD, _ITALIC, _STRIKE = ("\ue010", "\ue011"), ("\ue012", "\ue013"), ("\ue014", "\ue015")
_CODE, _LINK, _HREF_END = ("\ue016", "\ue017"), ("\ue018", "\ue019"), "\ue01a"
_BREAK, _CELL, _HEAD = "\ue01b", "\ue01c", "\ue01d"
_OPEN_CODE, _CLOSE_CODE = "\ue01e", "\ue01f"
_ANY_SPAN = "[\ue010-\ue01a]"

_SPANS = {"b": _BOLD, "strong": _BOLD, "i": _ITALIC, "em": _ITALIC, "strike": _STRIKE, "s": _STRIKE, "del": _STRIKE}
_CODE_TAGS = ("code", "kbd", "samp")
_LINE_BREAKERS = H.BLOCK_TAGS + ("li", "tr", "thead", "tbody", "tfoot", "title", "body", "html", "head", "caption")
UNKNOWN_ATTACHMENT = "![attachment](attachment:unknown)"

# How the source marks headings and code. Order matters.
_REWRITES = [
    (r"(?is)<b>([^<]*)<span\b[^>]*font-size:\s*24p[xt][^>]*>([^<]*)</span>[^<]*</b>", "<h1>$2</h1>"),
    (r"(?is)<b>([^<]*)<span\b[^>]*font-size:\s*18p[xt][^>]*>([^<]*)</span>[^<]*</b>", "<h2>$2</h2>"),
    (r"(?is)(?<!<td>)<div>\s*<b>([^<]+)</b>\s*</div>", "<h3>$1</h3>"),
    (
        r"(?is)<div>\s*<font\b[^>]*courier[^>]*>\s*<tt>(.*?)</tt>\s*</font>\s*</div>",
        f"{_OPEN_CODE}$1{_CLOSE_CODE}",
    ),
    (r"(?is)<font\b[^>]*courier[^>]*>\s*<tt>(.*?)</tt>\s*</font>", f"{_OPEN_CODE}$1{_CLOSE_CODE}"),
    (rf"{_CLOSE_CODE}\s*{_OPEN_CODE}", "\n"),
    (_OPEN_CODE, "<pre><code>"),
    (_CLOSE_CODE, "</code></pre>"),
    (r"(?is)<font\b[^>]*courier[^>]*>(.*?)</font>", "<code>$1</code>"),
    (
        r"(?is)<h([1-3])>([^<]*)</h\1>\s*<strike>\s*<h\1>([^<]*)</h\1>\s*</strike>\s*<h\1>([^<]*)</h\1>",
        "<h$1>$2<strike>$3</strike>$4</h$1>",
    ),
]


# Without any of these words only a bold line can need rewriting.
_KEYWORDS = r"(?i)font-size|<font|<strike"
# Typefaces whose blocks are code.
_CODE_FACES = ("menlo", "courier", "monospace")
_BOLD_LINE = _REWRITES[2]


def _rewritten(html: Column, rules: list[tuple[str, str]]) -> Column:
    for pattern, replacement in rules:
        html = F.regexp_replace(html, pattern, replacement)
    return html


def _prepared(html: Column) -> Column:
    return F.when(F.rlike(html, F.lit(_KEYWORDS)), _rewritten(html, _REWRITES)).otherwise(_rewritten(html, [_BOLD_LINE]))


def _in_code_face(token: Column) -> Column:
    """Whether a token opens a block that is set in a typeface for code."""
    style = F.lower(F.coalesce(H.attribute(token, "style"), F.lit("")))
    faced = F.exists(F.array(*[F.lit(f) for f in _CODE_FACES]), lambda f: F.contains(style, f))
    return ~token.startswith("</") & H.tag_name(token).isin("div", "p") & faced


def _code_blocks(found: Column) -> Column:
    """Blocks in a typeface for code become preformatted, each up to the first end of a block of its name."""

    def step(acc: Column, token: Column) -> Column:
        name = H.tag_name(token)
        opens = (acc["inside"] == "") & _in_code_face(token)
        ends = (acc["inside"] != "") & token.startswith("</") & (name == acc["inside"])
        shown = F.when(opens, "<pre>").when(ends, "</pre>").otherwise(token)
        inside = F.when(opens, name).when(ends, "").otherwise(acc["inside"])
        return F.struct(inside.alias("inside"), F.array_append(acc["out"], shown).alias("out"))

    start = F.struct(F.lit("").alias("inside"), F.expr("cast(array() as array<string>)").alias("out"))
    return F.aggregate(found, start, step, lambda acc: acc["out"])


def _tokens(rows: DataFrame, key: str, html: str) -> DataFrame:
    text = _prepared(F.coalesce(F.col(html), F.lit("")))
    repaired = let(text, lambda t: let(H.repair(H.tokens(t)), lambda found: F.when(
        F.rlike(t, F.lit("(?i)" + "|".join(_CODE_FACES))), _code_blocks(found)).otherwise(found)))
    # The empty token at the end keeps a row for a document without any.
    found = F.concat(repaired, F.array(F.lit("")))
    rows = spread_by(rows.select(F.col(key).alias("doc"), F.col(html)), "doc")
    rows = rows.select("doc", F.posexplode(found).alias("pos", "token"))
    tag = H.is_tag(F.col("token")) & ~H.is_raw(F.col("token"))
    rows = rows.withColumn("name", F.when(tag, H.tag_name(F.col("token"))).otherwise(""))
    return rows.withColumn("end", F.col("token").startswith("</"))


def _placed(rows: DataFrame) -> DataFrame:
    """Depths, list items, table rows and line numbers by running sums."""
    order = Window.partitionBy("doc").orderBy("pos")
    sofar = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    name, end = F.col("name"), F.col("end")
    delta = F.when(end, -1).otherwise(1)

    def depth(*names: str) -> Column:
        return F.sum(F.when(name.isin(*names), delta).otherwise(0)).over(sofar)

    rows = rows.withColumns({
        "lists": depth("ul", "ol"),
        "quotes": depth("blockquote"),
        "pre": depth("pre"),
        "tables": depth("table"),
        "code": depth(*_CODE_TAGS),
        "heading": F.max(F.when(F.rlike(name, F.lit("^h[1-6]$")) & ~end, F.struct("pos", F.substring(name, 2, 1).cast("int").alias("n")))).over(sofar)["n"],
        "in_heading": depth("h1", "h2", "h3", "h4", "h5", "h6"),
        "hidden": depth("noscript", "template"),
    })
    # The list a token belongs to is the one opened last at its depth.
    at_depth = Window.partitionBy("doc", "lists").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = name.isin("ul", "ol") & ~end
    first = F.coalesce(F.regexp_extract(H.attribute(F.col("token"), "start"), r"^\s*(\d{1,9})\s*$", 1).try_cast("int"), F.lit(1))
    rows = rows.withColumn("list", F.max(F.when(opens, F.struct("pos", "name", first.alias("first")))).over(at_depth))
    in_list = Window.partitionBy("doc", "lists", "list.pos").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("number", F.sum(F.when((name == "li") & ~end, 1).otherwise(0)).over(in_list))
    shown = (F.col("number") + F.coalesce("list.first", F.lit(1)) - 1).cast("string")
    marker = F.when(F.col("list.name") == "ol", F.concat(shown, F.lit(". "))).otherwise("- ")
    rows = rows.withColumn("marker", marker)
    width = F.when(name == "li", delta * F.length("marker")).otherwise(0)
    breaks = (F.col("pre") == 0) & (F.col("tables") == 0) & name.isin(*_LINE_BREAKERS)
    # Inside a table only its rows break lines, and preformatted text only at its edges.
    breaks = breaks | name.isin("pre", "table") | ((F.col("tables") > 0) & (name == "tr"))
    rows = rows.withColumns({
        "indent": F.sum(width).over(sofar),
        "line": F.sum(breaks.cast("int")).over(sofar),
        "table": F.coalesce(F.max(F.when((name == "table") & ~end, F.col("pos"))).over(sofar), F.lit(-1)),
        "items": F.sum(F.when((name == "li") & ~end, 1).otherwise(0)).over(sofar),
        "items_before": F.coalesce(F.sum(F.when((name == "li") & ~end, 1).otherwise(0)).over(before), F.lit(0)),
    })
    return rows


def _fragment() -> Column:
    """What a token adds to its line."""
    token, name, end = F.col("token"), F.col("name"), F.col("end")
    pre = F.col("pre") > 0
    verbatim = pre | (F.col("code") > 0)
    text = F.when(H.is_entity(token), H.decode_entity(token)).otherwise(token)
    flat = F.regexp_replace(F.regexp_replace(text, r"([*_])", r"\\$1"), rf"(?U){SPACE}+", " ")
    span = F.lit("")
    for tag, (start, stop) in _SPANS.items():
        span = F.when(name == tag, F.when(end, stop).otherwise(start)).otherwise(span)
    href = F.coalesce(H.attribute(token, "href"), F.lit(""))
    title = F.nullif(H.attribute(token, "title"), F.lit(""))
    titled = F.when((href != "") & title.isNotNull(), F.concat(
        href, F.lit(' "'), F.replace(title, F.lit('"'), F.lit('\\"')), F.lit('"'))).otherwise(href)
    link = F.when(end, _LINK[1]).otherwise(F.concat(F.lit(_LINK[0]), titled, F.lit(_HREF_END)))
    image = F.concat(
        F.lit("!["), F.coalesce(H.attribute(token, "alt"), F.lit("")), F.lit("]("),
        F.coalesce(H.attribute(token, "src"), F.lit("")), F.lit(")"),
    )
    # An embedded object is known by its id alone.
    embedded = F.concat(F.lit("![attachment](attachment:"), F.coalesce(H.attribute(token, "id"), F.lit("unknown")), F.lit(")"))
    state = F.lower(F.coalesce(H.attribute(token, "class"), F.lit("")))
    box = F.when(end, "").when(state == "checked", "[x] ").when(state == "unchecked", "[ ] ").otherwise("")
    code = F.when(end, _CODE[1]).otherwise(_CODE[0])
    cell = F.when(end, "").when(name == "th", _HEAD).otherwise(_CELL)
    return (
        F.when(name == "", F.when(H.is_markup(token) | H.is_raw(token), "").when(verbatim, text).otherwise(flat))
        .when(pre, F.when(name == "br", "\n").otherwise(""))
        .when(name.isin(*_CODE_TAGS), code)
        .when(name == "a", link)
        .when(name == "img", image)
        .when(name == "object", F.when(end, "").otherwise(embedded))
        .when(name == "li", box)
        .when(name.isin("td", "th"), cell)
        .when((F.col("tables") > 0) & name.isin("br", *H.BLOCK_TAGS), " ")
        .when(name == "br", _BREAK)
        .when(name == "hr", "---")
        .otherwise(span)
    )


def _wrapped(text: Column, marks: tuple[str, str], sign: str) -> Column:
    """Turn a marked span into Markdown, with the white space outside the signs."""
    start, stop = marks
    text = F.regexp_replace(text, rf"(?<={start})[ {_BREAK}]*{_BREAK}|{_BREAK}[ {_BREAK}]*(?={stop})", "")
    text = F.regexp_replace(text, rf"{start}(\s*){stop}", "$1")
    return F.regexp_replace(text, rf"{start}(\s*)([^{start}{stop}]*?)(\s*){stop}", f"$1{sign}$2{sign}$3")


def _inline(text: Column) -> Column:
    text = _wrapped(text, _CODE, "`")
    for marks, sign in ((_STRIKE, "~~"), (_ITALIC, "*"), (_BOLD, "**")):
        text = _wrapped(text, marks, sign)
    start, stop = _LINK
    text = F.regexp_replace(text, rf"{start}[^{_HREF_END}]*{_HREF_END}(\s*){stop}", "$1")
    text = F.regexp_replace(text, rf"{start}([^{_HREF_END}]+){_HREF_END}\1{stop}", "<$1>")
    text = F.regexp_replace(text, rf"{start}{_HREF_END}([^{stop}]*){stop}", "$1")
    text = F.regexp_replace(text, rf"{start}([^{_HREF_END}]+){_HREF_END}(\s*)([^{stop}]*?)(\s*){stop}", "$2[$3]($1)$4")
    # Marks whose partner is on another line have no Markdown form.
    text = F.regexp_replace(text, _ANY_SPAN, "")
    text = strip(F.regexp_replace(text, " +", " "))
    return F.regexp_replace(F.regexp_replace(text, rf"^(?:\s*{_BREAK})+|(?:{_BREAK}\s*)+$", ""), rf" *{_BREAK} *", "  \n")


def _lines(rows: DataFrame) -> DataFrame:
    """One row per line with its text and its place."""
    shown = F.when((F.col("hidden") == 0), _fragment()).otherwise("")
    rows = rows.withColumn("part", shown)
    grouped = rows.groupBy("doc", "line").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part"))), lambda x: x["part"]), "").alias("raw"),
        *[F.max(c).alias(c) for c in ("pre", "tables", "quotes", "lists", "table", "indent", "items", "items_before")],
        F.max("in_heading").alias("in_heading"),
        F.max("heading").alias("heading"),
        F.max_by("marker", "pos").alias("marker"),
        F.max(F.when((F.col("name") == "pre") & ~F.col("end"), H.attribute(F.col("token"), "lang"))).alias("given_lang"),
        F.max(F.when((F.col("name") == "code") & ~F.col("end"), H.attribute(F.col("token"), "class"))).alias("code_class"),
        F.max((F.col("name") == "hr").cast("int")).alias("rule"),
        F.max((F.col("name") == "li").cast("int") * (~F.col("end")).cast("int")).alias("starts"),
    )
    # The language of a block is named by the class of the code in it, or by the block itself.
    named = F.when(F.col("code_class").startswith("language-"), F.substring("code_class", F.lit(10), F.length("code_class")))
    grouped = grouped.withColumn("lang", F.coalesce(F.nullif(named, F.lit("")), "given_lang"))
    raw = F.regexp_replace("raw", r"\A\n|\n\z", "")
    text = F.when(F.col("pre") > 0, raw).when((F.col("tables") > 0), F.col("raw")).otherwise(_inline(F.col("raw")))
    lines = grouped.withColumn("text", text)
    has_cell = F.rlike("raw", F.lit(f"[{_CELL}{_HEAD}]"))
    kept = F.when(F.col("tables") > 0, has_cell).when(F.col("pre") > 0, F.col("raw") != "").otherwise(F.col("text") != "")
    # A line that holds nothing but an object without an id says nothing.
    bare = (F.col("lists") == 0) & (F.col("quotes") == 0) & (F.col("in_heading") == 0) & (F.col("pre") == 0)
    kept = kept & ~(bare & (F.col("text") == UNKNOWN_ATTACHMENT))
    last = Window.partitionBy("doc").orderBy("line")
    # The first line of an item with any text carries the marker.
    lines = lines.withColumn("kept", kept).withColumn("item_no", F.when(F.col("lists") > 0, F.col("items")))
    lines = lines.withColumn("rank", F.row_number().over(Window.partitionBy("doc", "item_no").orderBy(F.col("kept").desc(), "line")))
    first_row = Window.partitionBy("doc", "table", F.col("tables") > 0).orderBy(F.col("kept").desc(), "line")
    lines = lines.withColumn("row_no", F.row_number().over(first_row))
    lines = lines.withColumn("doc_line", F.row_number().over(last))
    return lines.where(F.col("kept") | (F.col("doc_line") == 1))


def _table_row(raw: Column) -> Column:
    cells = F.filter(F.split(raw, f"(?=[{_CELL}{_HEAD}])", -1), lambda c: F.rlike(c, F.lit(f"[{_CELL}{_HEAD}]")))

    def clean(cell: Column) -> Column:
        return F.replace(_inline(F.regexp_replace(cell, f"[{_CELL}{_HEAD}]", "")), F.lit("|"), F.lit("\\|"))

    return F.transform(cells, lambda c: F.struct(c.startswith(_HEAD).alias("head"), clean(c).alias("text")))


def _bordered(texts: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(texts, " | "), F.lit(" |"))


def _first_row(cells: Column) -> Column:
    """Header row and rule; a first row that is no header gets an empty one above it."""
    texts = F.transform(cells, lambda c: c["text"])
    bold = r"\*\*(.+?)\*\*"
    headed = F.forall(cells, lambda c: c["head"]) | F.forall(cells, lambda c: F.rlike(c["text"], F.lit(bold)))
    plain = F.transform(cells, lambda c: F.when(
        ~c["head"], F.regexp_extract(c["text"], bold, 1)).otherwise(c["text"]))
    rule = _bordered(F.transform(cells, lambda c: F.lit("---")))
    blank = F.concat(F.lit("|"), F.array_join(F.transform(cells, lambda c: F.lit("  ")), "|"), F.lit("|"))
    return F.when(headed, F.concat_ws("\n", _bordered(plain), rule)).otherwise(
        F.concat_ws("\n", blank, rule, _bordered(texts))
    )


def html_to_markdown(rows: DataFrame, key: str, html: str) -> DataFrame:
    """``key, markdown`` for documents with a unique key."""
    lines = _lines(_placed(_tokens(rows, key, html)))
    is_row = F.col("tables") > 0
    row = let(_table_row(F.col("raw")), lambda cells: F.when(
        F.col("row_no") == 1, _first_row(cells)).otherwise(_bordered(F.transform(cells, lambda c: c["text"]))))
    fence = F.concat(F.lit("```"), F.coalesce("lang", F.lit("")), F.lit("\n"), F.col("text"), F.lit("\n```"))
    sharp = F.concat(F.repeat(F.lit("#"), F.col("heading")), F.lit(" "), F.regexp_replace("text", r"\s*\n\s*", " "))
    body = F.when(is_row, row).when(F.col("pre") > 0, fence).when(F.col("in_heading") > 0, sharp).otherwise(F.col("text"))
    listed = F.col("lists") > 0
    leads = listed & (F.col("rank") == 1)
    pad = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.col("indent") - F.when(leads, F.length("marker")).otherwise(0)).cast("int"))
    hanging = F.repeat(F.lit(" "), F.greatest(F.lit(0), F.col("indent")).cast("int"))
    item = F.concat(pad, F.when(leads, F.col("marker")).otherwise(""), F.replace(F.col("body"), F.lit("\n"), F.concat(F.lit("\n"), hanging)))
    quote = F.repeat(F.lit("> "), F.col("quotes").cast("int"))
    lines = lines.withColumn("body", F.when(F.col("kept"), body).otherwise(""))
    lines = lines.withColumn("body", F.when(listed & F.col("kept"), item).otherwise(F.col("body")))
    lines = lines.withColumn("body", F.when((F.col("quotes") > 0) & F.col("kept"), F.concat(quote, F.replace(
        F.col("body"), F.lit("\n"), F.concat(F.lit("\n"), quote)))).otherwise(F.col("body")))
    order = Window.partitionBy("doc").orderBy("line")
    lines = lines.where(F.col("kept") | (F.col("doc_line") == 1))
    together = (
        (listed & (F.lag("lists").over(order) > 0) & leads)
        | (is_row & (F.lag("tables").over(order) > 0) & (F.lag("table").over(order) == F.col("table")))
    )
    gap = F.when(together, "\n").otherwise("\n\n")
    lines = lines.withColumn("body", F.concat(gap, "body"))
    whole = lines.groupBy("doc").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "body"))), lambda x: x["body"]), "").alias("markdown")
    )
    return whole.select(F.col("doc").alias(key), strip(F.regexp_replace("markdown", r"\n{3,}", "\n\n")).alias("markdown"))
