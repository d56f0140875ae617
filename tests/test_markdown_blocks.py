"""Markdown becomes HTML within the row: no line of its own is made, sorted or exchanged."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.operators import to_html


def html(spark, rows):
    frame = spark.createDataFrame(rows, "k int, markdown string")
    return {r["k"]: r["html"] for r in to_html.markdown_to_html(frame, "k", "markdown").collect()}


def test_lines_get_no_rows_of_their_own(spark):
    rows = spark.range(100).select((F.col("id") * 7 % 100).alias("k"), F.lit("# a\n\n- b\n- c").alias("markdown"))
    plan = to_html.markdown_to_html(rows, "k", "markdown")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan
    # One exchange and one sort, by key and with a row a document.
    assert plan.count("Exchange") == 1 and plan.count("Sort [") == 1


def test_joined_documents_are_not_dealt_again(spark):
    left, right = (spark.range(100).select((F.col("id") * 7 % 100).alias(k), F.lit("a").alias(v)) for k, v in (("k", "x"), ("l", "y")))
    rows = left.hint("merge").join(right, F.col("k") == F.col("l")).select("k", F.concat("x", "y").alias("markdown"))
    plan = to_html.markdown_to_html(rows, "k", "markdown")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("Sort [") == 2


def test_blocks(spark):
    cases = {
        # Lists: blank lines, kinds, depths, wrapped lines.
        "- a\n\n- b": "<ul>\n<li>a</li>\n<li>b</li>\n</ul>",
        "- a\n1. b": "<ul>\n<li>a</li>\n</ul><div><br></div><ol>\n<li>b</li>\n</ol>",
        "- a\n    1. b\n    2. c\n- d": "<ul>\n<li>a\n<ol>\n<li>b</li>\n<li>c</li>\n</ol>\n</li>\n<li>d</li>\n</ul>",
        "1. a\nw\n2. b": "<ol>\n<li>a\nw</li>\n</ol>\n<ol>\n<li>b</li>\n</ol>",
        "- a\n\nb": "<ul>\n<li>a</li>\n</ul>\n<div>b</div>",
        # A rule or a task is no item; one more dash makes a rule.
        "- a\n---\n- [x] b\n- c": '<ul>\n<li>a</li>\n</ul>\n<hr />\n<ul class="checklist"><li class="checked">b</li></ul>\n<ul>\n<li>c</li>\n</ul>',
        # Fences pair in turn; the last of an odd number is text.
        "```\na *b*\n```\n```\nc": "<pre><code>a *b*\n</code></pre>\n<div>```\nc</div>",
        "> a\nb\n> c\n\nd": "<blockquote>\n<div>a\nb\nc</div>\n</blockquote>\n<div>d</div>",
        # The line below the header may be a rule or an item.
        "|a\n---": "<table>\n<thead>\n<tr>\n<th>a</th>\n</tr>\n</thead>\n</table>\n<hr />",
        "a | b\n--- | ---\n1 \\| 2 | `x`\n3": "<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1 | 2</td>\n"
        "<td><code>x</code></td>\n</tr>\n<tr>\n<td>3</td>\n<td></td>\n</tr>\n</tbody>\n</table>",
        # A dot does not find a line separator, a dollar stands before the last one.
        "- a\u2028b": "<div>- a\u2028b</div>",
        "- a\u2028": "<ul>\n<li>a</li>\n</ul>",
        "<p>x</p> \t": "<p>x</p>",
        "\n \n": "",
        "": "",
    }
    keys = list(cases)
    assert {keys[k]: v for k, v in html(spark, list(enumerate(keys))).items()} == cases


def test_texts_of_one_key_are_merged_by_line(spark):
    assert html(spark, [(1, "- a\n- b\n\nc"), (1, "- a\n- b\n\nc"), (None, "x"), (None, "y")]) == {
        1: "<ul>\n<li>a\na</li>\n<li>b\nb</li>\n</ul>\n<div>c\nc</div>", None: "<div>x\ny</div>"}


def test_long_documents(spark):
    n = 20_000
    text = "- a\n" * n + "\n" + "b\n" * n + "```\n" + "c\n" * n + "```\n" + "\n" * n + "> d\n" * n + "|e|\n|-|\n" + "|f|\n" * n
    found = html(spark, [(1, text)])[1]
    assert [found.count(x) for x in ("<li>a</li>", "\nb", "\nc", "\nd", "<td>f</td>")] == [n, n - 1, n - 1, n - 1, n]
