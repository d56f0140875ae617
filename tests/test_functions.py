"""Scalar functions: identifiers, text, words, conversions, bodies."""

from __future__ import annotations

import gzip
import sqlite3

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marginalia.config import ChunkerConfig, load_config
from marginalia.functions import html as H
from marginalia.functions import ids, terms, wire
from marginalia.functions import text as tx
from marginalia.operators import chunking, from_html, to_html

relaxed = settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
TEXTS = st.lists(st.text(st.characters(codec="utf-8", exclude_categories=("Cs", "Cn")), max_size=60), min_size=5, max_size=30)


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, fn, kind="string"):
    rows = column(spark, values, kind).select("i", fn(F.col("v")).alias("o")).collect()
    return [r["o"] for r in sorted(rows, key=lambda r: r["i"])]


# -- identifiers ---------------------------------------------------------------


@pytest.mark.parametrize("raw, want", [
    ("p12", ("note", 12)), (" f7 ", ("folder", 7)), ("x-coredata://U/ICNote/p3", ("note", 3)),
    ("x-coredata://U/ICFolder/p9", ("folder", 9)),
])
def test_parse_id(spark, raw, want):
    assert ids.parse_id(raw) == want
    assert apply(spark, [raw], ids.id_kind) == [want[0]]
    assert apply(spark, [raw], ids.id_pk) == [want[1]]


@pytest.mark.parametrize("raw", ["", "12", "q3", "p", "p1x", "x-coredata://U/ICOther/p3"])
def test_parse_id_refuses(spark, raw):
    with pytest.raises(ValueError):
        ids.parse_id(raw)
    assert apply(spark, [raw], ids.id_kind) == [None]


@given(st.integers(0, 10**9))
def test_cursor_round_trip(offset):
    assert ids.decode_cursor(ids.encode_cursor(offset)) == offset


@pytest.mark.parametrize("bad", ["!!", "LTE=", "eDE="])
def test_cursor_refuses(bad):
    with pytest.raises(ValueError):
        ids.decode_cursor(bad)
    assert ids.decode_cursor(None) == 0


def test_settings():
    assert load_config({}).chunker.chunk_size == 1000
    assert load_config({"MARGINALIA_MAX_CHUNK_TOKENS": "100"}).chunker.chunk_size == 250
    assert load_config({"MARGINALIA_MODEL": "bge-base-en-v1.5"}).dim == 768
    for bad in ({"MARGINALIA_DIM": "x"}, {"MARGINALIA_INDEX_INTERVAL": "0.5"}, {"MARGINALIA_PROVIDER": "no"}):
        with pytest.raises(ValueError):
            load_config(bad)


# -- counting and highlighting ---------------------------------------------------


def brute_snippets(text, query, window, spans):
    if not text or not query:
        return []
    low, q, out, at, last = text.lower(), query.lower(), [], 0, None
    while len(out) < spans and (hit := low.find(q, at)) >= 0:
        at = hit + 1
        start, end = max(0, hit - window), min(len(text), hit + len(query) + window)
        if last is not None and start < last + window:
            continue
        out.append((start, end))
        last = end
    show = lambda s, e: "…" * (s > 0) + " ".join(text[s:e].split()) + "…" * (e < len(text))
    if out:
        return [show(*span) for span in out]
    return [" ".join(text[: 2 * window].split()) + "…" * (len(text) > 2 * window)] if text[: 2 * window] else []


@pytest.mark.parametrize("window, spans", [(100, 3), (3, 3), (0, 2), (5, 1)])
def test_snippets(spark, window, spans):
    texts = ["", "x", "abc" * 30, "the cat sat\non the  mat, the end " * 9, "ABC and abc", "no hit here " * 40, "aabcabc" + "z" * 50 + "abc"]
    got = apply(spark, texts, lambda c: tx.snippets(c, "abc", window, spans))
    assert got == [brute_snippets(t, "abc", window, spans) for t in texts]


@relaxed
@given(TEXTS, st.sampled_from(["a", "aa", "é", " ", "0"]))
def test_count_matches(spark, texts, query):
    assert apply(spark, texts, lambda c: tx.count_matches(c, query)) == [t.lower().count(query) for t in texts]


def test_regex_engines(spark):
    texts = ["École x12", "nothing", "aa bb aa", "tail\n"]
    assert apply(spark, texts, lambda c: tx.regex_first_match(c, r"école \w+")) == ["École x12", None, None, None]
    assert tx.java_pattern(r"(a)?(?(1)b|c)") is None
    assert apply(spark, texts, lambda c: tx.regex_first_match(c, r"(a)a (?(1)b)b")) == [None, None, "aa bb", None]
    assert apply(spark, texts, lambda c: tx.regex_first_match(c, r"(?P<w_1>aa) bb (?P=w_1)")) == [None, None, "aa bb aa", None]
    assert apply(spark, texts, lambda c: tx.regex_first_match(c, r"l$")) == [None, None, None, "l"]
    with pytest.raises(ValueError, match="invalid regex"):
        tx.java_pattern("(")


def test_tokens():
    assert tx.tokenize(" A Big big cAT ") == ["big", "big", "cat"]
    assert tx.selective_token(["ab", "abc", "xyz"]) == "abc" and tx.selective_token([]) == ""


# -- index terms -----------------------------------------------------------------


def test_terms_match_sqlite(spark):
    words = (
        "relational conditional rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli "
        "vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti "
        "sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference "
        "airliner gyroscopic adjustable defensible irritant replacement adjustment dependent adoption homologou "
        "communism activate angulariti homologous effective bowdlerize probate rate cease controll roll caresses "
        "ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling "
        "hissing fizzed failing filing happy sky yes aying crying dying ies says toys psychology café naïve étés y yy 123s"
    ).split()
    con = sqlite3.connect(":memory:")
    con.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize='porter unicode61')")
    con.execute("CREATE VIRTUAL TABLE v USING fts5vocab(f, 'instance')")
    con.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", list(enumerate(words)))
    expected = dict(con.execute("SELECT doc, term FROM v"))
    rows = terms.with_terms(column(spark, words), "v").collect()
    assert {r["i"]: r["term"] for r in rows} == expected


# -- HTML and Markdown -------------------------------------------------------------


TO_TEXT = {
    "<p>a&amp;b</p><br/>c<br>d": "a&b\n\nc\nd",
    "x &notit; &copy &#65;&#x1F600; &unknown; &amp;lt;": "x ¬it; © A😀 &unknown; &lt;",
    "<script>var t='</p>';a&amp;b</script>z": "var t='</p>';a&amp;bz",
    "a < b & c <3": "a < b & c <3",
    "<ul><li>a<li>b</ul>": "a\nb",
    "<table><tr><td>1</td><td>2</td></tr></table>": "12",
    "\n\n a \n \n\n\n b  \n": "a\n\n b",
    "": "",
}
SANITIZED = {
    "<div onclick='x()' class=\"k\"><strong>S</strong><h5>t</h5><span>u</span></div>": '<div class="k"><b>S</b><div>t</div>u</div>',
    "<p>one<p>two <b>three<p>four": "<div>one</div><div>two <b>three</b></div><div>four</div>",
    "<script>alert(1)</script><iframe src=x></iframe><a href='j\"k'>l</a>": '<a href="j&quot;k">l</a>',
    "hello <em>x</em></u>": "<div>hello <i>x</i></div>",
    "<form><input name=a></form><link rel=x><del>d</del>": "<strike>d</strike>",
    "  ": "",
}
HTML_TO_MD = {
    '<ol start="3"><li>a</li><li>b</li></ol>': "3. a\n4. b",
    '<a href="u" title="T">x</a>': '[x](u "T")',
    '<div style="font-family: Menlo">a<br>b</div>': "```\na\nb\n```",
    '<ul><li class="checked">a</li><li class="unchecked">b</li></ul>': "- [x] a\n- [ ] b",
    'x <object id="A1"></object> y': "x ![attachment](attachment:A1) y",
    '<pre><code class="language-sql">q</code></pre>': "```sql\nq\n```",
    '<div><b><span style="font-size: 24px">Big</span></b></div>': "# Big",
    '<div><b><span style="font-size:18px">Mid</span></b></div>': "## Mid",
    "<div><b>Lone</b></div>": "### Lone",
    "<div><b>bold</b> and <em>it</em> <s>no</s></div>": "**bold** and *it* ~~no~~",
    "<ul><li>a<ul><li>a.1</li></ul></li><li>b</li></ul>": "- a\n  - a.1\n- b",
    "<ol><li>x<ul><li>y</li></ul></li><li>z</li></ol>": "1. x\n   - y\n2. z",
    '<ul><li class="checked">done</li><li class="unchecked">todo</li></ul>': "- [x] done\n- [ ] todo",
    '<p>see <a href="/u">this</a><br>next</p>': "see [this](/u)  \nnext",
    '<div><font face="Courier"><tt>l1</tt></font></div><div><font face="Courier"><tt>l2</tt></font></div>': "```\nl1\nl2\n```",
    '<pre><code class="language-py">x = 1\n  y</code></pre>': "```py\nx = 1\n  y\n```",
    "<table><tr><td>a</td><td>b</td></tr></table>": "|  |  |\n| --- | --- |\n| a | b |",
    "<table><tr><td><b>H</b></td></tr><tr><td>v|w</td></tr></table>": "| H |\n| --- |\n| v\\|w |",
    '<div><object id="k-1"></object></div><div><object></object></div>': "![attachment](attachment:k-1)",
    "<blockquote><p>q1</p><p>q2</p></blockquote>": "> q1\n\n> q2",
    "<h1>A</h1><strike><h1>B</h1></strike><h1>C</h1>": "# A~~B~~C",
    "a_b*c &lt;t&gt;": "a\\_b\\*c <t>",
    "<div> \n </div>": "",
}
MD_TO_HTML = {
    "# One #": "<h1>One</h1>",
    "#### Four": "<div>Four</div>",
    "**b** *i* ~~s~~ `c*d`": "<div><b>b</b> <i>i</i> <strike>s</strike> <code>c*d</code></div>",
    "para\n- a\n- b": "<div>para</div>\n<ul>\n<li>a</li>\n<li>b</li>\n</ul>",
    "- a\n    - b\n        1. c\n- d": "<ul>\n<li>a\n<ul>\n<li>b\n<ol>\n<li>c</li>\n</ol>\n</li>\n</ul>\n</li>\n<li>d</li>\n</ul>",
    "- [x] t & u\n- [ ] v": '<ul class="checklist"><li class="checked">t &amp; u</li><li class="unchecked">v</li></ul>',
    "- a\n\n1. b": "<ul>\n<li>a</li>\n</ul><div><br></div><ol>\n<li>b</li>\n</ol>",
    "```py\nx < 1\n\ny\n```": "<pre><code>x &lt; 1\n\ny\n</code></pre>",
    "```\nnever closed": "<div>```\nnever closed</div>",
    "| a | b |\n|---|---|\n| 1 |": "<table>\n<thead>\n<tr>\n<th>a</th>\n<th>b</th>\n</tr>\n</thead>\n<tbody>\n<tr>\n<td>1</td>\n<td></td>\n</tr>\n</tbody>\n</table>",
    "> q": "<blockquote>\n<div>q</div>\n</blockquote>",
    "a\n\n---\n\nb": "<div>a</div>\n<hr />\n<div>b</div>",
    "[t](u) ![i](s)": '<div><a href="u">t</a> <img alt="i" src="s" /></div>',
    "snake_case_name \\*lit\\*": "<div>snake_case_name *lit*</div>",
    "": "",
}


def test_html_to_text(spark):
    assert dict(zip(TO_TEXT, apply(spark, list(TO_TEXT), H.html_to_text))) == TO_TEXT


def test_sanitize(spark):
    assert dict(zip(SANITIZED, apply(spark, list(SANITIZED), H.sanitize))) == SANITIZED


def test_html_to_markdown(spark):
    keys = list(HTML_TO_MD)
    found = {keys[r["i"]]: r["markdown"] for r in from_html.html_to_markdown(column(spark, keys), "i", "v").collect()}
    assert found == HTML_TO_MD


def test_markdown_to_html(spark):
    keys = list(MD_TO_HTML)
    found = {keys[r["i"]]: r["html"] for r in to_html.markdown_to_html(column(spark, keys), "i", "v").collect()}
    assert found == MD_TO_HTML


@relaxed
@given(st.lists(st.text(st.sampled_from(list("<>/&;#abp \n*_`-|[]()!1.\"'=")), max_size=80), min_size=10, max_size=30))
def test_converters_never_fail(spark, texts):
    rows = column(spark, texts)
    assert from_html.html_to_markdown(rows, "i", "v").count() == len(texts)
    assert to_html.markdown_to_html(rows, "i", "v").count() == len(texts)
    for clean in apply(spark, texts, H.sanitize):
        assert "<script" not in clean


# -- chunker -----------------------------------------------------------------------


def chunks_of(spark, text, **options):
    rows = chunking.chunk_rows(column(spark, [text]), ["i"], "v", ChunkerConfig(**options)).collect()
    return sorted(rows, key=lambda r: r["chunk_index"])


def test_chunker_structure(spark):
    text = (
        "---\nk: v\n---\nintro\n# One\nbody\n\n```\n# not a heading\n\ncode\n```\n##### deep\nstays\n"
        "#\nadopted\n$$\nx # y\n$$ end"
    )
    rows = chunks_of(spark, text, min_chunk_chars=1)
    assert [(r["heading"], r["heading_level"]) for r in rows] == [(None, None), ("One", 1), ("adopted", 1)]
    assert rows[0]["content"] == "intro" and (rows[0]["start_line"], rows[0]["end_line"]) == (4, 4)
    assert rows[1]["content"] == "body\n\n```\n# not a heading\n\ncode\n```\n##### deep\nstays"
    assert rows[2]["content"] == "$$\nx # y\n$$ end"


def test_chunker_packing(spark):
    text = "Aaa bbb. Ccc ddd. Eee fff.\n\n" + "x" * 25 + "\n\nshort\n\ntail"
    got = [r["content"] for r in chunks_of(spark, text, chunk_size=20, min_chunk_chars=1)]
    assert got == ["Aaa bbb. Ccc ddd.", "Eee fff.", "x" * 20, "x" * 5, "short\n\ntail"]


@pytest.mark.parametrize("text", ["", "   \n ", "---\na: b\n---\n", None])
def test_chunker_blank(spark, text):
    assert chunks_of(spark, text, min_chunk_chars=1) == []


@pytest.mark.parametrize("text", ["0 literal mark", "nul \0 byte " * 20, "```" + "y" * 500 + "```", "a" * 60_000])
def test_chunker_adversarial(spark, text):
    rows = chunks_of(spark, text, chunk_size=100, min_chunk_chars=1)
    assert [r["chunk_index"] for r in rows] == list(range(len(rows)))
    assert "".join(r["content"] for r in rows).replace(" ", "") == text.strip().replace(" ", "")


@relaxed
@given(st.lists(st.text(st.sampled_from(list("abcA .!?\n#-$`é")), max_size=300), min_size=10, max_size=25))
def test_chunker_invariants(spark, texts):
    config = ChunkerConfig(chunk_size=80, min_chunk_chars=5, preserve_code_blocks=False, preserve_latex_blocks=False)
    for row in column(spark, texts).select("v", chunking.chunk_array(F.col("v"), config).alias("c")).collect():
        assert [c["chunk_index"] for c in row["c"]] == list(range(len(row["c"])))
        for c in row["c"]:
            assert 5 <= len(c["content"]) <= 80 and len(c["content_hash"]) == 32
            assert c["start_line"] <= c["end_line"]


# -- note bodies -------------------------------------------------------------------


def varint(n):
    return bytes([n]) if n < 128 else bytes([n % 128 + 128]) + varint(n // 128)


def field(number, value):
    if isinstance(value, int):
        return varint(number << 3) + varint(value)
    return varint(number << 3 | 2) + varint(len(value)) + value


def note_blob(text, runs):
    note = field(2, text.encode())
    for length, style, done in runs:
        styled = b"" if style is None else field(2, field(1, style) + (b"" if done is None else field(5, field(1, b"u") + field(2, int(done)))))
        note += field(5, field(1, length) + styled)
    return field(2, field(2, 1) + field(3, note))


def test_decode_body(spark):
    plain = note_blob("Title\nmilk\n", [(6, 0, None), (5, 103, True), (1, None, None)])
    good = [gzip.compress(plain), plain]
    bad = [gzip.compress(plain)[:-9], b"\x1f\x8bjunk", b"\xff\xff\xff", b"", None]
    rows = apply(spark, good + bad, wire.body_struct, "binary")
    for row in rows[:2]:
        assert row["text"] == "Title\nmilk\n"
        assert [(r["offset"], r["style_type"], r["is_checked"]) for r in row["runs"]] == [(0, 0, None), (6, 103, True), (11, -1, None)]
    assert all(row["text"] is None for row in rows[2:])
    assert apply(spark, [good[0], *bad], wire.body_text, "binary") == ["Title\nmilk\n", "", "", "", "", ""]
