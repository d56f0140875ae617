"""Bodies in the format asked for: rendering, parsing, checklist state from style runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import html as H
from marginalia.functions.exprs import count_newlines, strip
from marginalia.functions.wire import STYLE_CHECKBOX
from marginalia.operators.from_html import html_to_markdown
from marginalia.operators.to_html import markdown_to_html

FORMATS = ("markdown", "html", "text")
_EMPTY_HEADING = r"\A\s*#+[^\S\n]*\n\s*"


def _checked(fmt: str) -> None:
    if fmt not in FORMATS:
        raise ValueError(f"unknown format {fmt!r}; one of {', '.join(FORMATS)}")


def render_bodies(rows: DataFrame, key: str, html: str, fmt: str = "markdown", decoded: DataFrame | None = None) -> DataFrame:
    """``key, body`` of stored HTML; ``decoded`` adds checklist state as ``key, text, runs``."""
    _checked(fmt)
    if fmt == "html":
        return rows.select(key, F.col(html).alias("body"))
    if fmt == "text":
        return rows.select(key, H.html_to_text(F.col(html)).alias("body"))
    shown = html_to_markdown(rows, key, html)
    bare = F.regexp_replace(F.regexp_replace("markdown", _EMPTY_HEADING, ""), r"\A\n+", "")
    shown = shown.select(key, bare.alias("markdown"))
    if decoded is not None:
        shown = apply_style_runs(shown, decoded, key)
    return shown.select(key, F.col("markdown").alias("body"))


def plain_html(text: Column) -> Column:
    """Text as one escaped block with its line ends; nothing for none."""
    escaped = F.replace(F.replace(H.escape(text), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    wrapped = F.concat(F.lit("<div>"), F.replace(escaped, F.lit("\n"), F.lit("<br>")), F.lit("</div>"))
    return F.when(F.coalesce(text, F.lit("")) == "", "").otherwise(wrapped)


def parse_bodies(rows: DataFrame, key: str, body: str, fmt: str = "markdown") -> DataFrame:
    """``key, html`` to store for bodies given in a format."""
    _checked(fmt)
    if fmt == "markdown":
        return markdown_to_html(rows, key, body)
    if fmt == "html":
        return rows.select(key, H.sanitize(F.col(body)).alias("html"))
    return rows.select(key, plain_html(F.col(body)).alias("html"))


def apply_style_runs(documents: DataFrame, decoded: DataFrame, key: str) -> DataFrame:
    """Mark ``- text`` lines as done or open where a checkbox run covers the same text.

    The n-th run over a text meets the n-th Markdown line with that text, an equi-join on text and
    number. A run names its lines by counting the line ends before it.
    """
    runs = decoded.select(key, "text", F.inline("runs")).where(F.col("style_type") == STYLE_CHECKBOX)
    end = F.col("offset") + F.col("length")
    first = count_newlines(F.substring("text", F.lit(1), F.col("offset")))
    last = count_newlines(F.substring("text", F.lit(1), F.greatest(F.lit(0), end - 1)))
    covered = runs.where("length > 0").select(
        key, "offset", "is_checked", F.split("text", "\n").alias("lines"), F.explode(F.sequence(first, last)).alias("line")
    )
    content = strip(F.coalesce(F.get("lines", F.col("line")), F.lit("")))
    covered = covered.select(key, "offset", "line", F.coalesce("is_checked", F.lit(False)).alias("done"), content.alias("content"))
    nth = Window.partitionBy(key, "content").orderBy("offset", "line")
    covered = covered.withColumn("n", F.row_number().over(nth)).select(key, "content", "n", "done")

    lines = documents.select(key, F.posexplode(F.split("markdown", "\n", -1)).alias("pos", "shown"))
    item = strip(F.col("shown"))
    lines = lines.withColumn("content", F.when(item.startswith("- "), strip(F.substring(item, F.lit(3), F.length(item)))))
    order = Window.partitionBy(key, "content").orderBy("pos")
    lines = lines.withColumn("n", F.when(F.col("content").isNotNull(), F.row_number().over(order)))
    lines = lines.join(covered, [key, "content", "n"], "left")
    box = F.when(F.col("done"), "- [x] ").otherwise("- [ ] ")
    marked = F.when(F.col("done").isNotNull(), F.concat(
        F.substring_index("shown", "- ", 1), box, F.substring(F.col("shown"), F.length(F.substring_index("shown", "- ", 1)) + 3, F.length("shown"))
    )).otherwise(F.col("shown"))
    whole = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", marked.alias("shown")))).alias("all"))
    return whole.select(key, F.array_join(F.transform("all", lambda x: x["shown"]), "\n").alias("markdown"))
