"""Registered queries: document conversion and body decoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions import html as H
from marginalia.functions import wire
from marginalia.functions.exprs import let
from marginalia.operators import from_html, rendering, to_html
from marginalia.plans import corpus
from marginalia.plans.registry import query
from marginalia.sources.layout import spread

_TOKEN = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>|<[!?][^>]*>|</?[a-zA-Z][^>]*>"
    r"|&(?:#[0-9]+|[a-zA-Z][a-zA-Z0-9]*);?|[^<&]+|[<&]"
)
_NAME = "lower(regexp_extract(t, '^</?([a-zA-Z][^\\s/>]*)', 1))"
_DECODED = """CASE t WHEN '&amp;' THEN '&' WHEN '&amp' THEN '&' WHEN '&am' THEN '&am' WHEN '&lt;' THEN '<' WHEN '&gt;' THEN '>'
  WHEN '&quot;' THEN '"' WHEN '&copy;' THEN '©' WHEN '&middot;' THEN '·' WHEN '&nbsp;' THEN chr(160) ELSE t END"""
_TAGS = ", ".join(f"'{t}'" for t in H.LINE_TAGS)


@query(rf"""
WITH toks AS (SELECT page_id, regexp_extract_all(html, '{_TOKEN}') AS toks FROM pages),
joined AS (SELECT page_id, array_to_string(list_transform(toks, lambda t: CASE
    WHEN starts_with(t, '&') AND length(t) > 1 THEN {_DECODED}
    WHEN NOT starts_with(t, '<') THEN t
    WHEN regexp_matches(t, '(?is)^<(script|style)\b') THEN regexp_extract(t, '(?s)^<[^>]*>(.*)</', 1)
    WHEN regexp_matches(t, '(?s)^<[!?].*>$') THEN ''
    WHEN regexp_matches(t, '(?s)^</?[a-zA-Z].*>$') THEN (CASE WHEN {_NAME} IN ({_TAGS}) THEN chr(10) ELSE '' END)
    ELSE t END), '') AS body FROM toks)
SELECT page_id, trim(regexp_replace(regexp_replace(body, '[ \t]+(\n|$)', '\1', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'),
  ' ' || chr(9) || chr(10)) AS body FROM joined
""")
def html_to_text(spark, sf_dir):
    pages = spread(corpus.table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", H.html_to_text(F.col("html")).alias("body"))


# The pages leave one paragraph and its bold text open; the SQL closes them by pattern first.
_CLOSED = r"""regexp_replace(regexp_replace(html, '(<p><b>[^<]*<br>)(<p>|</article>)', '\1</b></p>\2', 'g'), '(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>', '', 'g')"""


@query(rf"""
WITH toks AS (SELECT page_id, regexp_extract_all({_CLOSED}, '{_TOKEN}') AS toks FROM pages)
SELECT page_id, array_to_string(list_transform(toks, lambda t: CASE
    WHEN starts_with(t, '&') AND length(t) > 1 THEN replace(replace(replace({_DECODED}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
    WHEN NOT starts_with(t, '<') THEN replace(replace(replace(t, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')
    WHEN regexp_matches(t, '(?s)^<[!?].*>$') THEN t
    WHEN {_NAME} = 'p' THEN replace(lower(t), 'p', 'div')
    WHEN {_NAME} = 'br' THEN '<br/>'
    WHEN {_NAME} IN ('b', 'h1', 'ul', 'li', 'a', 'div') THEN t
    ELSE '' END), '') AS clean FROM toks
""")
def sanitize_html(spark, sf_dir):
    pages = spread(corpus.table(spark, sf_dir, "pages").select("page_id", "html"))
    return pages.select("page_id", H.sanitize(F.col("html")).alias("clean"))


@query(rf"""
WITH toks AS (SELECT page_id, regexp_extract_all({_CLOSED}, '{_TOKEN}') AS toks FROM pages),
flat AS (SELECT page_id, array_to_string(list_transform(toks, lambda t: CASE
    WHEN starts_with(t, '&') AND length(t) > 1 THEN {_DECODED}
    WHEN NOT starts_with(t, '<') THEN regexp_replace(regexp_replace(t, '([*_])', '\\\1', 'g'), '\s+', ' ', 'g')
    WHEN regexp_matches(t, '(?s)^<[!?].*>$') THEN ''
    WHEN t = '</a>' THEN chr(57345)
    WHEN {_NAME} = 'a' THEN chr(57344) || regexp_extract(t, 'href="([^"]*)"', 1) || chr(57346)
    WHEN t IN ('<b>', '</b>') THEN '**' WHEN {_NAME} = 'br' THEN ''
    WHEN t = '<li>' THEN chr(10) || '- ' WHEN t = '</li>' THEN ''
    WHEN t = '<h1>' THEN chr(10) || chr(10) || '# '
    WHEN {_NAME} IN ('p', 'div', 'ul', 'nav', 'article', 'footer', 'h1', 'title', 'body', 'head', 'html') THEN chr(10) || chr(10)
    ELSE '' END), '') AS body FROM toks),
linked AS (SELECT page_id, regexp_replace(body, '\x{{E000}}([^\x{{E002}}]*)\x{{E002}}([^\x{{E001}}]*)\x{{E001}}', '[\2](\1)', 'g') AS body FROM flat),
lines AS (SELECT page_id, list_transform(string_split(body, chr(10)), lambda l: trim(l)) AS lines FROM linked)
SELECT page_id, trim(regexp_replace(replace(array_to_string(lines, chr(10)), ' **' || chr(10), '**' || chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), chr(10)) AS markdown
FROM lines
""")
def html_to_markdown(spark, sf_dir):
    return from_html.html_to_markdown(corpus.table(spark, sf_dir, "pages"), "page_id", "html")


@query(r"""
WITH items AS (
  SELECT l_orderkey, string_agg('<li>part <b>' || l_partkey || '</b></li>', chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS list,
    string_agg('<tr>' || chr(10) || '<td>' || l_partkey || '</td>' || chr(10) || '<td><code>' || l_linestatus || '</code></td>' || chr(10) || '</tr>',
      chr(10) ORDER BY l_linenumber, l_partkey, l_suppkey) AS cells
  FROM lineitem GROUP BY 1
)
SELECT o_orderkey, '<h1>Order ' || o_orderkey || '</h1>' || chr(10)
  || '<div>Status <i>' || o_orderstatus || '</i> &amp; <strike>old</strike> <a href="/c/' || o_custkey || '">customer</a></div>' || chr(10)
  || '<ul>' || chr(10) || list || chr(10) || '</ul>' || chr(10)
  || '<table>' || chr(10) || '<thead>' || chr(10) || '<tr>' || chr(10) || '<th>part</th>' || chr(10) || '<th>state</th>' || chr(10) || '</tr>' || chr(10)
  || '</thead>' || chr(10) || '<tbody>' || chr(10) || cells || chr(10) || '</tbody>' || chr(10) || '</table>' || chr(10)
  || '<blockquote>' || chr(10) || '<div>' || o_orderpriority || '</div>' || chr(10) || '</blockquote>' || chr(10)
  || '<pre><code>x &lt; ' || o_custkey || chr(10) || '</code></pre>' || chr(10)
  || '<ul class="checklist"><li class="checked">paid</li><li class="unchecked">sent &amp; done</li></ul>' AS html
FROM orders JOIN items ON l_orderkey = o_orderkey
""")
def markdown_to_html(spark, sf_dir):
    items = corpus.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"))).alias("all")
    )

    def joined(line) -> Column:
        return F.array_join(F.transform("all", line), "\n")

    orders = corpus.table(spark, sf_dir, "orders").join(items, F.col("l_orderkey") == F.col("o_orderkey"))
    page = F.concat_ws(
        "\n",
        F.concat(F.lit("# Order "), F.col("o_orderkey"), F.lit(" #")),
        F.concat(F.lit("Status *"), "o_orderstatus", F.lit("* & ~~old~~ [customer](/c/"), F.col("o_custkey"), F.lit(")")),
        joined(lambda x: F.concat(F.lit("* part **"), x["l_partkey"], F.lit("**"))),
        F.lit(""),
        F.lit("part | state\n--- | ---"),
        joined(lambda x: F.concat(F.lit("| "), x["l_partkey"], F.lit(" | `"), x["l_linestatus"], F.lit("` |"))),
        F.lit(""),
        F.concat(F.lit("> "), "o_orderpriority"),
        F.concat(F.lit("\n```sql\nx < "), F.col("o_custkey"), F.lit("\n```")),
        F.lit("- [x] paid\n- [ ] sent & done"),
    )
    return to_html.markdown_to_html(orders.select("o_orderkey", page.alias("page")), "o_orderkey", "page")


def _varint(n: Column) -> Column:
    """Protobuf variable-length form of a number below 2**21."""
    byte = lambda v: F.lpad(F.hex(v.cast("bigint")), 2, "0")
    low, mid, high = n % 128, F.floor(n / 128) % 128, F.floor(n / 16384)
    return F.unhex(
        F.when(n < 128, byte(low)).when(n < 16384, F.concat(byte(low + 128), byte(mid)))
        .otherwise(F.concat(byte(low + 128), byte(mid + 128), byte(high)))
    )


def _field(tag: str, payload: Column) -> Column:
    size = lambda p: let(F.octet_length(p), _varint)
    return let(payload, lambda p: F.concat(F.unhex(F.lit(tag)), size(p), p))


@query("""
SELECT conv_id, turn, text, CASE WHEN length(text) > 0 THEN 2 ELSE 0 END AS runs,
       role = 'user' AS done, CASE WHEN turn % 2 = 0 THEN 103 ELSE 4 END AS style, 5 AS second_offset
FROM conversations
""")
def decode_bodies(spark, sf_dir):
    turns = spread(corpus.table(spark, sf_dir, "conversations"))
    text = F.encode("text", "UTF-8")
    done = F.when(F.col("role") == "user", F.unhex(F.lit("1001"))).otherwise(F.unhex(F.lit("1000")))
    check = F.concat(F.unhex(F.lit("0867")), _field("2a", F.concat(F.unhex(F.lit("0a0175")), done)))
    style = F.when(F.col("turn") % 2 == 0, check).otherwise(F.concat(F.unhex(F.lit("0804")), _field("2a", done)))
    runs = F.concat(_field("2a", F.unhex(F.lit("0805"))), _field("2a", F.concat(F.unhex(F.lit("0803")), _field("12", style))))
    note = F.concat(_field("12", text), runs)
    blob = _field("12", F.concat(F.unhex(F.lit("1001")), _field("1a", note)))
    rows = turns.select("conv_id", "turn", F.col("role"), wire.body_struct(wire.pick_blob(F.unhex(F.lit("")), blob)).alias("b"))
    second = F.element_at("b.runs", 2)
    checked = F.when(second["style_type"] == 103, second["is_checked"]).otherwise(F.col("role") == "user")
    return rows.select(
        "conv_id", "turn", F.col("b.text").alias("text"), F.size("b.runs").alias("runs"), checked.alias("done"),
        second["style_type"].alias("style"), second["offset"].alias("second_offset"),
    )


@query("""
WITH marks AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_linestatus = 'F' AS done,
    row_number() OVER (PARTITION BY l_orderkey, l_partkey % 3 ORDER BY l_linenumber, l_partkey, l_suppkey) AS n FROM lineitem)
SELECT l_orderkey, '# List' || chr(10) || string_agg('- [' || CASE WHEN done THEN 'x' ELSE ' ' END || '] item ' || (l_partkey % 3), chr(10)
    ORDER BY l_linenumber, l_partkey, l_suppkey) AS markdown
FROM marks GROUP BY 1
""")
def style_runs(spark, sf_dir):
    items = corpus.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(
        F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_linestatus"))).alias("all")
    )
    label = lambda x: F.concat(F.lit("item "), (x["l_partkey"] % 3).cast("string"))
    # Every entry is seven characters with its line end.
    runs = F.transform("all", lambda x, i: F.struct(
        (i * 7).cast("int").alias("offset"), F.lit(7).alias("length"), F.lit(103).alias("style_type"),
        (x["l_linestatus"] == "F").alias("is_checked"),
    ))
    decoded = items.select("l_orderkey", F.array_join(F.transform("all", label), "\n").alias("text"), runs.alias("runs"))
    shown = F.concat(F.lit("# List\n"), F.array_join(F.transform("all", lambda x: F.concat(F.lit("- "), label(x))), "\n"))
    return rendering.apply_style_runs(items.select("l_orderkey", shown.alias("markdown")), decoded, "l_orderkey")
