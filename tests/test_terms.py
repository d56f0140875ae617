"""Which words can have a term, told from their first letters."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia.functions import terms
from marginalia.operators import fulltext as ft

# Words that the rules rewrite, not only cut.
REWRITTEN = (
    "relational conditional valency hesitancy digitizer conformably radically differently vilely analogously vietnamization predication "
    "operator feudalism decisiveness hopefulness callousness formality sensitivity sensibility possibilities probability ability abilities "
    "analogy analogies ponies cities happy sky by flying dying tied agreed conflated troubled sized hopping filing rolling controlling "
    "triplicate formative formalize electricity electrical hopeful goodness revival adjustment probate rate cease agility stability bleed "
    "nobly nobility noble nobilities humble humbly yellow yes eyes e i ible able syllable syllabled éres Élan ﬁn x́y naïveté"
).split()


def test_words_begin_with_the_letters_kept_of_their_term(spark):
    rows = terms.with_terms(spark.createDataFrame([(w.lower(),) for w in REWRITTEN], "word string"), "word")
    rows = rows.select("word", "term", terms.fold(F.col("word")).alias("plain")).collect()
    assert len(rows) == len(REWRITTEN)
    assert [r["word"] for r in rows if not r["plain"].startswith(terms.kept_letters(r["term"]))] == []


def test_words_like_keeps_places(spark):
    text = "Thin thïngs, athing: ́thing THÍng ethos thé x ér"
    found = spark.createDataFrame([(text,), (None,)], "text string").select(
        terms.words(F.col("text")).alias("all"), terms.words_like(F.col("text"), ["thing", "er"]).alias("some"), terms.words_like(F.col("text"), []).alias("none")).collect()
    assert found[0]["some"] == ["", "thïngs", "", "thing", "thíng", "", "", "", "ér"]
    assert [w for w, s in zip(found[0]["all"], found[0]["some"], strict=True) if s and s != w] == []
    assert found[0]["none"] == [""] * 9 and found[1]["some"] == []


def test_a_search_keeps_only_words_that_can_match(spark):
    nodes = spark.createDataFrame([("a", "Thin ice", "things thinned the thing"), ("b", "", "these others"), ("c", None, None)], "id string, title string, body string")
    postings, stats = ft.searchable(nodes, "things")
    assert {r["term"]: (r["title_n"], r["body_n"]) for r in postings.collect()} == {"thing": (0, 2)}
    assert stats.first().asDict() == ft.build_stats(nodes).first().asDict()
    postings, _ = ft.searchable(nodes, "things", positions=True)
    assert [(r["node_id"], r["length"], r["title_at"], r["body_at"]) for r in postings.collect()] == [("a", 6, [], [0, 3])]


def test_terms_are_counted_without_postings(spark):
    nodes = spark.createDataFrame([("a", "Thing", "things thing other"), ("b", "other", None)], "id string, title string, body string")
    by = lambda rows: sorted(map(tuple, rows.select("term", "notes", "uses").collect()))
    assert by(ft.count_terms(nodes)) == by(ft.term_stats(ft.build_postings(nodes))) == [("other", 2, 2), ("thing", 1, 3)]
