"""What providers refuse: the table of learned capacities, and second tries within a pass."""

from __future__ import annotations

from pyspark.sql import functions as F

from marginalia import schema
from marginalia.config import ChunkerConfig
from marginalia.functions import ids
from marginalia.operators import capacity
from marginalia.operators.embedding import HashedEmbedder
from marginalia.operators.indexing import Index

LONG = " ".join(f"Sentence number {k} of a rather long note stands here." for k in range(80))


def source(spark, bodies):
    columns = "id string, z_pk bigint, title string, folder string, modified_at bigint, locked boolean, pinned boolean, body string"
    return spark.createDataFrame([(f"n{k}", k, f"Title {k}", "Work", 1, False, False, b) for k, b in bodies.items()], columns)


def known(index):
    return {r["provider"]: (r["advertised"], r["discovered"]) for r in index.capacity().collect()}


def test_refused_chunks_are_cut_and_tried_again(spark, tmp_path):
    index, config = Index(spark, str(tmp_path / "i")), ChunkerConfig()
    picky = HashedEmbedder(8, max_chars=700)
    done = index.reindex(source(spark, {1: LONG, 2: "Short text of a note, which every provider takes at once."}), picky, config)
    assert done["chunks_failed"] == 0 and index.failed().count() == 0 and done["failures"].count() == 0
    assert index.chunks().agg(F.max(F.length("content"))).first()[0] <= capacity.FLOOR_CHARS
    # Nothing of the note is lost by cutting it shorter.
    parts = index.chunks().where("node_id = 'n1'").orderBy("chunk_index").select("chunk_index", "content").collect()
    assert [p["chunk_index"] for p in parts] == list(range(len(parts)))
    assert " ".join(p["content"] for p in parts) == LONG
    advertised, first = known(index)["hashed"]
    assert advertised is None and 256 <= first < 440 and index.status()["max_tokens"] == first
    # What was learned stays through a pass in which nothing is refused, and never rises; the settings are not taken for changed.
    again = index.reindex(source(spark, {1: LONG, 2: "Another short text of this note, which every provider takes too."}), picky, config)
    assert known(index)["hashed"] == (None, first) and again["chunks_embedded"] == 1 and len(index.store.segments()) == 2
    index.compact()
    assert known(index)["hashed"] == (None, first)


def test_what_no_cut_helps_is_a_failure_and_the_floor_holds(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    done = index.reindex(source(spark, {1: LONG, 2: "Short text of a note, which stays below all limits here."}), HashedEmbedder(8, max_chars=100), ChunkerConfig())
    assert done["chunks_failed"] == index.failed().where("reason = 'too-long'").count() > 1
    assert index.chunks().select("node_id").distinct().collect() == [("n2",)]
    assert known(index)["hashed"] == (None, 256)


def test_advertised_capacity_sizes_chunks_and_providers_keep_their_rows(spark, tmp_path):
    index = Index(spark, str(tmp_path / "i"))
    notes = source(spark, {1: LONG})
    index.reindex(notes, HashedEmbedder(8, identity="told", max_tokens=200), ChunkerConfig())
    assert index.chunks().agg(F.max(F.length("content"))).first()[0] <= 500
    index.reindex(notes, HashedEmbedder(8, identity="other"), ChunkerConfig())
    assert index.chunks().agg(F.max(F.length("content"))).first()[0] > 500
    assert known(index) == {"told": (200, None), "other": (None, None)}


def test_upsert_of_capacities(spark):
    stored = spark.createDataFrame([("a", 512, 400, 1, 1), ("b", 512, None, None, 1), ("c", None, 300, 1, 1), ("d", 99, 98, 1, 1)], schema.CAPACITY)
    asked = capacity.advertised_tokens(spark.createDataFrame([("a", 600), ("b", None), ("e", 128)], "provider string, advertised int"), 7)
    learned = spark.createDataFrame([("a", 450), ("b", 333), ("c", 256), ("e", 256)], "provider string, learned int")
    rows = capacity.upserted(stored, asked, learned, 7).withColumn("effective", capacity.effective()).orderBy("provider").collect()
    assert [tuple(r) for r in rows] == [
        ("a", 600, 400, 1, 7, 400), ("b", 512, 333, 7, 7, 333), ("c", None, 256, 7, 1, 256), ("d", 99, 98, 1, 1, 98), ("e", 128, 256, 7, 7, 128)]
    none = capacity.upserted(stored.limit(0), asked.limit(0), learned.limit(0), 7)
    assert none.collect() == [] and none.columns == stored.columns


def test_without_a_refusal_capacity_stays(spark):
    rows = spark.sql("select * from values (1, cast(null as int)), (2, 2000), (3, 300), (4, 1) t(k, observed)")
    found = rows.select("k", ids.ratcheted_tokens(F.lit(512), F.col("observed")).alias("after")).collect()
    assert {r["k"]: r["after"] for r in found} == {1: 512, 2: 512, 3: 270, 4: 256}
