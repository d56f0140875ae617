"""Heading-aware chunking of Markdown, entirely in column expressions.

Each document is cut inside its own row: regular expressions find front matter, protected blocks,
headings and sentence ends, and one ``aggregate`` packs the pieces. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.config import ChunkerConfig
from marginalia.functions import ids
from marginalia.functions.exprs import SPACE, count_newlines, let, strip

# Private-use characters around the number of a protected block.
OPEN, CLOSE = "\ue000", "\ue001"

# What counts as front matter, protected block, heading, paragraph and sentence end.
FRONT_MATTER = rf"(?sU)\A---\n.*?\n---{SPACE}*\n?"
CODE_BLOCK = r"```[\s\S]*?```"
LATEX_BLOCK = r"\$\$[\s\S]*?\$\$"
HEADING = rf"(?mdU)^#{{1,6}}{SPACE}+.+?{SPACE}*$"
PARAGRAPH_BREAK = rf"(?U)\n{SPACE}*\n+"
SENTENCE_BREAK = rf"(?U)(?<=[.!?]){SPACE}+(?=[A-ZÀ-ſ])"

_PIECE = "struct<run:int,sep:int,body:string>"
_PACK = "struct<done:array<string>,open:string,used:int,run:int>"
_SECTION = "struct<heading:string,level:int,body:string>"
# Runs: paragraphs share one, the sentences of a paragraph share its number, cuts stand alone.
_PARAGRAPHS, _CUT = -1, -2


def _shield(text: Column, pattern: str, first: Column | int) -> Column:
    """Replace the matches of ``pattern`` by numbered placeholders."""
    gaps = F.split(text, pattern, -1)

    def numbered(gap: Column, i: Column, n: Column) -> Column:
        mark = F.concat(F.lit(OPEN), (i + first).cast("string"), F.lit(CLOSE))
        return F.when(i < n - 1, F.concat(gap, mark)).otherwise(gap)

    return let(gaps, lambda g: F.array_join(F.transform(g, lambda gap, i: numbered(gap, i, F.size(g))), ""))


def _unshield(text: Column, blocks: Column, n_code: Column) -> Column:
    """Put blocks back: formulas first, then the code they may hold."""
    pattern = f"{OPEN}(\\d+){CLOSE}"

    def fill(body: Column, lowest: Column | int) -> Column:
        gaps, marks = F.split(body, pattern, -1), F.regexp_extract_all(body, F.lit(pattern), F.lit(1))

        def mended(gap: Column, i: Column, numbers: Column) -> Column:
            number = F.get(numbers, i)
            block = F.when(number.try_cast("int") >= lowest, F.get(blocks, number.try_cast("int")))
            kept = F.concat(F.lit(OPEN), number, F.lit(CLOSE))
            return F.concat(gap, F.coalesce(block, kept, F.lit("")))

        return let(marks, lambda m: F.array_join(F.transform(gaps, lambda gap, i: mended(gap, i, m)), ""))

    whole = let(fill(text, n_code), lambda t: fill(t, 0))
    return F.when(F.contains(text, F.lit(OPEN)), whole).otherwise(text)


def _section(heading: Column, level: Column, body: Column) -> Column:
    return F.struct(heading.alias("heading"), level.alias("level"), body.alias("body")).cast(_SECTION)


def _sections(text: Column, depth: int) -> Column:
    """One element per qualifying heading, after the text that precedes the first."""
    gaps, heads = F.split(text, HEADING, -1), F.regexp_extract_all(text, F.lit(HEADING), F.lit(0))
    nothing = F.lit(None)

    def add(acc: Column, i: Column, gap: Column, head: Column) -> Column:
        marks = F.regexp_extract(head, "^#+", 0)
        level = F.length(marks)
        title = strip(F.substring(head, level + 1, F.length(head)))
        fresh = F.concat(acc, F.array(_section(title, level, gap)))
        # A deeper heading stays in the body of the section it appears in.
        last = F.element_at(acc, -1)
        grown = F.concat(
            F.slice(acc, 1, F.size(acc) - 1),
            F.array(_section(last["heading"], last["level"], F.concat(last["body"], head, gap))),
        )
        return F.when(level <= depth, fresh).otherwise(grown)

    def walk(g: Column, h: Column) -> Column:
        start = F.array(_section(nothing, nothing, g[0]))
        steps = F.filter(F.sequence(F.lit(0), F.size(h)), lambda i: i < F.size(h))
        return F.aggregate(steps, start, lambda acc, i: add(acc, i, F.get(g, i + 1), F.get(h, i)))

    found = let(gaps, lambda g: let(heads, lambda h: walk(g, h)))
    return F.transform(found, lambda s: _section(s["heading"], s["level"], strip(s["body"])))


def _piece(run: Column | int, sep: int, body: Column) -> Column:
    run = run if isinstance(run, Column) else F.lit(run)
    return F.struct(run.alias("run"), F.lit(sep).alias("sep"), body.alias("body")).cast(_PIECE)


def _cuts(text: Column, size: int) -> Column:
    parts = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{size}}}"), F.lit(0))
    return F.transform(parts, lambda p: _piece(_CUT, 0, p))


def _nonblank(parts: Column) -> Column:
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def _sentences(paragraph: Column, number: Column, size: int) -> Column:
    parts = F.split(paragraph, SENTENCE_BREAK, -1)

    def one(sentence: Column) -> Column:
        return F.when(F.length(sentence) > size, _cuts(sentence, size)).otherwise(F.array(_piece(number, 1, sentence)))

    several = F.flatten(F.transform(_nonblank(parts), one))
    return F.when(F.size(parts) > 1, several).otherwise(_cuts(paragraph, size))


def _pieces(body: Column, size: int) -> Column:
    def one(paragraph: Column, i: Column) -> Column:
        small = F.array(_piece(_PARAGRAPHS, 2, paragraph))
        return F.when(F.length(paragraph) > size, _sentences(paragraph, i, size)).otherwise(small)

    return F.flatten(F.transform(_nonblank(F.split(body, PARAGRAPH_BREAK, -1)), one))


def _pack(pieces: Column, size: int) -> Column:
    """Join neighbouring pieces of one run while they fit; a separator is charged to each piece."""

    def state(done: Column, body: Column, used: Column, run: Column) -> Column:
        return F.struct(done.alias("done"), body.alias("open"), used.alias("used"), run.alias("run")).cast(_PACK)

    def close(acc: Column) -> Column:
        return F.when(acc["open"].isNull(), acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["open"])))

    def step(acc: Column, p: Column) -> Column:
        cost = F.length(p["body"]) + p["sep"]
        glue = F.when(p["sep"] == 2, "\n\n").otherwise(" ")
        fits = (acc["run"] == p["run"]) & (p["run"] != _CUT) & (acc["used"] + cost <= size)
        joined = state(acc["done"], F.concat(acc["open"], glue, p["body"]), acc["used"] + cost, p["run"])
        return F.when(fits, joined).otherwise(state(close(acc), p["body"], cost, p["run"]))

    empty = state(F.array().cast("array<string>"), F.lit(None), F.lit(0), F.lit(_CUT))
    return F.aggregate(pieces, empty, step, close)


def _bodies(body: Column, size: int) -> Column:
    return F.when(F.length(body) <= size, F.array(body)).otherwise(_pack(_pieces(body, size), size))


def _located(document: Column, content: Column) -> Column:
    """Lines above the first place where ``content`` occurs; null if it occurs nowhere."""
    before = F.call_function("substring_index", document, content, F.lit(1))
    found = let(before, lambda b: F.when(F.length(b) < F.length(document), count_newlines(b)))
    return F.when(content != "", found)


def chunk_array(text: Column, config: ChunkerConfig = ChunkerConfig()) -> Column:
    """Chunks of one text, numbered from 0; empty for blank text.

    Every intermediate value is bound with ``let``: a plain column used inside a lambda would be
    inlined by the optimizer and computed again for each element.
    """
    plain = F.replace(F.replace(F.coalesce(text, F.lit("")), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    none = F.array().cast("array<string>")

    def blocks_in(body: Column, pattern: str, wanted: bool) -> Column:
        return F.regexp_extract_all(body, F.lit(pattern), F.lit(0)) if wanted else none

    def shielded(body: Column, found: Column, pattern: str, first: Column | int) -> Column:
        return F.when(F.size(found) > 0, _shield(body, pattern, first)).otherwise(body)

    def of_document(doc: Column) -> Column:
        front = F.regexp_extract(doc, FRONT_MATTER, 0)
        return let(front, lambda f: let(F.substring(doc, F.length(f) + 1, F.length(doc)), lambda b: of_body(doc, f, b)))

    def of_body(doc: Column, front: Column, body: Column) -> Column:
        def hide_latex(code: Column, rest: Column) -> Column:
            formulas = blocks_in(rest, LATEX_BLOCK, config.preserve_latex_blocks)
            return let(formulas, lambda x: let(
                F.concat(code, x),
                lambda blocks: of_sections(
                    doc, front, blocks, F.size(code), shielded(rest, x, LATEX_BLOCK, F.size(code))
                ),
            ))

        fences = blocks_in(body, CODE_BLOCK, config.preserve_code_blocks)
        return let(fences, lambda c: let(shielded(body, c, CODE_BLOCK, 0), lambda rest: hide_latex(c, rest)))

    def of_sections(doc: Column, front: Column, blocks: Column, n_code: Column, body: Column) -> Column:
        def contents(section: Column) -> Column:
            whole = F.transform(
                _bodies(section["body"], config.chunk_size), lambda b: strip(_unshield(b, blocks, n_code))
            )
            kept = F.filter(whole, lambda b: F.length(b) >= config.min_chunk_chars)
            return F.transform(kept, lambda b: _section(section["heading"], section["level"], b))

        # Text without a heading counts only if there is any.
        sections = let(body, lambda b: _sections(b, config.heading_split_depth))
        named = F.filter(sections, lambda s: s["heading"].isNotNull() | (s["body"] != ""))
        parts = F.flatten(F.transform(named, contents))
        return let(count_newlines(front), lambda offset: F.transform(parts, lambda p, i: finish(doc, offset, p, i)))

    def finish(doc: Column, offset: Column, part: Column, i: Column) -> Column:
        def numbered(above: Column) -> Column:
            end = above + 1 + count_newlines(part["body"])
            return F.struct(
                i.alias("chunk_index"),
                part["heading"].alias("heading"),
                part["level"].alias("heading_level"),
                part["body"].alias("content"),
                ids.content_hash(part["heading"], part["body"]).alias("content_hash"),
                F.coalesce(above + 1, offset).alias("start_line"),
                F.coalesce(end, offset).alias("end_line"),
            )

        return let(_located(doc, part["body"]), numbered)

    return let(plain, of_document)


def chunk_rows(rows: DataFrame, keys: list[str], text: str, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """One row per chunk, carrying ``keys``."""
    return rows.select(*keys, F.inline(chunk_array(F.col(text), config)))


def embedding_text(heading: Column, content: Column) -> Column:
    """What is embedded for a chunk: its heading, a blank line, its content."""
    return F.when(F.coalesce(heading, F.lit("")) != "", F.concat_ws("\n\n", heading, content)).otherwise(content)
