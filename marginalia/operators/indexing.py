"""The incremental index: diff by content hash, embed what changed, sweep what is gone."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.config import CHARS_PER_TOKEN, ChunkerConfig
from marginalia.functions import ids
from marginalia.operators import blockmax, capacity, fulltext
from marginalia.operators.chunking import chunk_array, embedding_text
from marginalia.operators.embedding import Embedder, embed
from marginalia.sources.layout import spread
from marginalia.sources.snapshots import Snapshots
from marginalia.sources.sorted_files import ROWS_PER_FILE

# Fixed value: what the failure table says about a locked note.
LOCKED_ERROR = "note is password-protected; body inaccessible"
STATS = (
    "indexed", "skipped", "deleted", "chunks_embedded", "chunks_skipped", "chunks_failed",
)


#: What a later segment can replace of a note: its own row; its chunks and postings; its failures.
PARTS = ("node", "text", "failure")
#: States of chunks whose vector is known: in its place, or elsewhere in the note.
REUSED = ("kept", "moved")
#: Segments that readers put together at most; a pass that would leave more folds them into one.
MAX_SEGMENTS = 16


class DimensionMismatch(ValueError):
    """The stored vectors have another width than the provider's."""


# -- pure table operators ----------------------------------------------------


def to_nodes(source: DataFrame) -> DataFrame:
    """Node rows of an index source; a locked note has an empty body."""
    body = F.coalesce(F.when(~F.col("locked"), F.col("body")), F.lit(""))
    rows = source.withColumn("body", body).withColumn("title", F.coalesce("title", F.lit("")))
    hashed = rows.withColumn("content_hash", ids.content_hash(F.col("title"), F.col("body")))
    return hashed.select("id", "z_pk", "title", "folder", "modified_at", "locked", "pinned", "content_hash", "body")


def _stand_in(title: Column, folder: Column) -> Column:
    named = F.when(F.coalesce(folder, F.lit("")) != "", F.concat(F.lit("folder: "), folder))
    return F.concat_ws("\n", title, named)


def _fallback() -> Column:
    """A note that yields no chunk stays findable by its title and folder."""
    content = _stand_in(F.col("title"), F.col("folder"))
    return F.array(
        F.struct(
            F.lit(0).alias("chunk_index"),
            F.lit(None).cast("string").alias("heading"),
            F.lit(None).cast("int").alias("heading_level"),
            content.alias("content"),
            ids.content_hash(F.col("title"), content).alias("content_hash"),
            F.lit(1).alias("start_line"),
            F.lit(1).alias("end_line"),
        )
    )


def to_chunks(nodes: DataFrame, config: ChunkerConfig = ChunkerConfig()) -> DataFrame:
    """Chunks of all unlocked nodes."""
    rows = nodes.where(~F.col("locked")).withColumn("chunks", chunk_array(F.col("body"), config))
    filled = F.when(F.size("chunks") > 0, F.col("chunks")).otherwise(_fallback())
    rows = rows.select(F.col("id").alias("node_id"), F.inline(filled))
    return rows.withColumn("id", ids.chunk_key(F.col("node_id"), F.col("chunk_index")))


def diff_chunks(current: DataFrame, previous: DataFrame) -> DataFrame:
    """Current chunks with ``state``: ``kept`` when id and hash are unchanged, else ``new`` or ``changed``."""
    old = previous.select("id", F.col("content_hash").alias("_old"), F.col("embedding"))
    state = (
        F.when(F.col("_old").isNull(), "new").when(F.col("_old") != F.col("content_hash"), "changed").otherwise("kept")
    )
    rows = current.join(old, "id", "left").withColumn("state", state)
    return rows.withColumn("embedding", F.when(F.col("state") == "kept", F.col("embedding"))).drop("_old")


def reused_vectors(diffed: DataFrame, previous: DataFrame) -> DataFrame:
    """Chunks whose text stood elsewhere in the same note before take its vector, with the state ``moved``."""
    old = previous.groupBy("node_id", "content_hash").agg(F.first("embedding").alias("_vector"))
    rows = diffed.join(old, ["node_id", "content_hash"], "left")
    moved = F.col("state").isin("new", "changed") & F.col("_vector").isNotNull()
    return rows.select(*[
        F.when(moved, F.col("_vector")).otherwise(F.col("embedding")).alias(c) if c == "embedding"
        else F.when(moved, "moved").otherwise(F.col("state")).alias(c) if c == "state" else F.col(c)
        for c in diffed.columns])


def changed_nodes(nodes: DataFrame, previous: DataFrame, failed: DataFrame, chunks: DataFrame) -> DataFrame:
    """The nodes that differ from the stored ones, with ``texts`` and ``known``.

    ``texts`` says that chunks and postings have to be made again: text, title or lock differ, a chunk failed, or the note moved and its only
    chunk is the stand-in that names its folder. Otherwise only the node's own row changed. ``known`` says that a row is stored.
    """
    own = ("title", "content_hash", "locked", "folder", "modified_at", "pinned", "z_pk")
    old = previous.select(F.col("id").alias("_id"), *[F.col(c).alias(f"_{c}") for c in own], F.col("words").alias("_words"))
    again = failed.where("reason <> 'locked'").select(F.col("node_id").alias("_failed")).distinct()
    rows = nodes.join(old, nodes.id == F.col("_id"), "left").join(again, nodes.id == F.col("_failed"), "left")

    def differs(*names: str) -> Column:
        out = F.lit(False)
        for c in names:
            out = out | ~F.col(c).eqNullSafe(F.col(f"_{c}"))
        return out

    anew = F.col("_id").isNull() | differs("title", "content_hash", "locked") | F.col("_failed").isNotNull()
    some = rows.withColumn("texts", anew).where(anew | differs("folder", "modified_at", "pinned", "z_pk"))
    moved = some.where(~F.col("texts") & differs("folder")).select("id", _stand_in(F.col("_title"), F.col("_folder")).alias("_stand_in"))
    named = chunks.select("node_id", "content").join(moved, (chunks.node_id == moved.id) & (F.col("content") == F.col("_stand_in")))
    named = named.select(F.col("node_id").alias("_named")).distinct()
    rows = some.join(named, F.col("id") == F.col("_named"), "left")
    return rows.select(*nodes.columns, (F.col("texts") | F.col("_named").isNotNull()).alias("texts"), F.col("_id").isNotNull().alias("known"), F.col("_words").alias("old_words"))


def stale_chunks(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Stored chunks whose position no longer exists."""
    return previous.join(current.select("id"), "id", "left_anti")


def tombstones(previous_nodes: DataFrame, nodes: DataFrame) -> DataFrame:
    """Stored nodes that the source no longer has."""
    return previous_nodes.join(nodes.select("id"), "id", "left_anti")


def embed_chunks(diffed: DataFrame, embedder: Embedder) -> DataFrame:
    """Vectors for new and changed chunks; of kept chunks the provider sees a null and does nothing."""
    kept = F.col("state").isin(*REUSED)
    wanted = F.when(~kept, embedding_text(F.col("heading"), F.col("content")))
    rows = diffed.withColumn("_r", embed(wanted, embedder))
    return rows.withColumns({
        "embedding": F.when(kept, F.col("embedding")).otherwise(F.col("_r.vector")),
        "reason": F.when(~kept, F.col("_r.reason")), "error": F.when(~kept, F.col("_r.error")),
    }).drop("_r")


def failures(attempts: DataFrame, nodes: DataFrame, now: int) -> DataFrame:
    """Chunks without a vector, and one placeholder per locked note."""
    failed = attempts.where(F.col("reason").isNotNull()).select(
        F.col("id").alias("chunk_id"), "node_id", "reason", F.col("error").alias("error_message")
    )
    locked = nodes.where("locked").select(
        ids.chunk_key(F.col("id"), F.lit(0)).alias("chunk_id"),
        F.col("id").alias("node_id"),
        F.lit("locked").alias("reason"),
        F.lit(LOCKED_ERROR).alias("error_message"),
    )
    return failed.unionByName(locked).withColumn("failed_at", F.lit(now).cast("bigint"))


def pass_stats(attempts: DataFrame, stale: DataFrame, nodes: DataFrame, gone: DataFrame) -> DataFrame:
    """Counters of one pass in one row; per note, removals are set against skips but not below zero."""
    reused = F.col("state").isin(*REUSED)
    kept = F.count(F.when(reused, 1))
    tried = ~reused
    per_note = attempts.groupBy("node_id").agg(
        kept.alias("kept"),
        F.count(F.when(tried & F.col("reason").isNull(), 1)).alias("embedded"),
        F.count(F.when(tried & F.col("reason").isNotNull(), 1)).alias("failed"),
    )
    removed = stale.groupBy("node_id").agg(F.count("*").alias("removed"))
    skipped = F.greatest(F.lit(0), F.col("kept") - F.coalesce("removed", F.lit(0)))
    chunk_sums = per_note.join(removed, "node_id", "left").agg(
        F.coalesce(F.sum("embedded"), F.lit(0)).alias("chunks_embedded"),
        F.coalesce(F.sum(skipped), F.lit(0)).alias("chunks_skipped"),
        F.coalesce(F.sum("failed"), F.lit(0)).alias("chunks_failed"),
    )
    note_sums = nodes.agg(
        F.count(F.when(~F.col("locked"), 1)).alias("indexed"), F.count(F.when(F.col("locked"), 1)).alias("skipped")
    )
    deleted = gone.agg(F.count("*").alias("deleted"))
    one = F.lit(1).alias("_k")
    parts = [d.select("*", one) for d in (note_sums, deleted, chunk_sums)]
    return parts[0].join(parts[1], "_k").join(parts[2], "_k").select(*STATS)


# -- the pass ----------------------------------------------------------------


@dataclass
class Index:
    """An index stored in segments under ``root``; with ``version``, that one only."""

    spark: SparkSession
    root: str
    version: int | None = None
    max_segments: int = MAX_SEGMENTS
    rows_per_file: int = ROWS_PER_FILE

    def __post_init__(self):
        self.store = Snapshots(self.spark, self.root)

    def pinned(self) -> Index:
        """The index as it stands now: all its tables are of one version, whatever is published meanwhile."""
        return Index(self.spark, self.root, self.store.current(), self.max_segments, self.rows_per_file)

    def _stored_nodes(self) -> DataFrame:
        return self.store.merged("nodes", "id", "node", f"{schema.NODES}, words bigint", self.version)

    def nodes(self) -> DataFrame:
        return self._stored_nodes().drop("words")

    def chunks(self) -> DataFrame:
        return self.store.merged("chunks", "node_id", "text", schema.CHUNKS, self.version)

    def few_nodes(self, node_ids: list[str]) -> DataFrame:
        """The rows of a page's notes, read from the files that hold them."""
        wanted = {"id": node_ids}
        return self.store.few("nodes", "id", "node", f"{schema.NODES}, words bigint", "id", wanted, self.version).drop("words")

    def few_chunks(self, chunk_ids: list[str], node_ids: list[str]) -> DataFrame:
        """The rows of a page's chunks, whose notes are ``node_ids``, read from the files that hold them."""
        wanted = {"id": chunk_ids, "node_id": node_ids}
        return self.store.few("chunks", "node_id", "text", schema.CHUNKS, "id", wanted, self.version)

    def failed(self) -> DataFrame:
        return self.store.merged("failed_chunks", "node_id", "failure", schema.FAILED, self.version)

    def postings(self) -> DataFrame:
        return self.store.merged("postings", "node_id", "text", schema.POSTINGS, self.version)

    def top_words(self, terms: list[str], k: int) -> blockmax.Found:
        """The best notes that hold all terms; see :func:`blockmax.top_words`. Cells are those of each segment."""
        here = self.pinned() if self.version is None else self
        postings = here.store.merged("postings", "node_id", "text", f"{schema.POSTINGS}, cell bigint", here.version, "segment")
        tables = here.store.each("blocks", blockmax.SCHEMA.replace("segment int, ", ""), here.version, "segment")
        hits = None
        if len(here.store.segments(here.version)) > 1:
            # Blocks also count what later segments have replaced.
            hits = postings.where(F.col("term").isin(terms)).groupBy("term").agg(F.count("*").alias("hits"))
        return blockmax.top_words(postings, tables, here.stats(), terms, k, hits)

    def stats(self) -> DataFrame:
        """Number of notes and their mean length, from totals that every pass carries on."""
        totals = self.store.read("corpus", version=self.version)
        return totals.select("notes", (F.col("words") / F.when(F.col("notes") > 0, F.col("notes"))).alias("mean_length"))

    def capacity(self) -> DataFrame:
        """What is known of each provider's capacity; see :mod:`marginalia.operators.capacity`."""
        return self.store.read("capacity", schema.CAPACITY, self.version)

    def metadata(self) -> dict[str, str]:
        rows = self.store.read("metadata", schema.METADATA, self.version)
        latest = rows.groupBy("key").agg(F.max_by("value", "updated_at").alias("value"))
        return {r["key"]: r["value"] for r in latest.collect()}

    def reindex(
        self, source: DataFrame, embedder: Embedder, config: ChunkerConfig = ChunkerConfig(), keys: DataFrame | None = None,
        force: bool = False,
    ) -> dict:
        """One pass; publishes a new version and returns its counters.

        The pass writes one segment: rows of changed notes, and the keys whose earlier rows it replaces. With ``keys`` (a column
        ``id``) only these notes are compared, and those of them that the source lacks are taken for deleted; the counters are of these
        notes then. Chunks are no longer than the provider is known to take. Notes with a chunk that it refuses as too long are cut anew, to
        what it was seen to take and then to the least that is ever learned, before a chunk counts as failed. ``force``, a change of provider or of the chunker makes all rows anew, in one segment. Chunks that failed are not
        stored, so the next pass over their note tries them again.
        """
        now = int(time.time())
        version = self.store.begin()
        # The pass builds on what is current now; if another one publishes meanwhile, this one does not.
        here = self.pinned()
        known = here.metadata()
        here._check_width(known, embedder)
        same_provider = known.get("embedder") in (None, embedder.identity)
        anew = force or here.version is None or not same_provider or known.get("chunker") != repr(config)
        old_nodes, previous = here._stored_nodes(), here.chunks()
        reusable = previous if same_provider and not force else previous.where(F.lit(False))
        rows = to_nodes(spread(source))
        if keys is not None and not anew:
            asked = keys.select("id").distinct()
            rows, old_nodes = (t.join(asked, "id", "left_semi") for t in (rows, old_nodes))

        if anew:
            changed = rows.withColumns({"texts": F.lit(True), "known": F.lit(False), "old_words": F.lit(None).cast("bigint")})
        else:
            changed = changed_nodes(rows, old_nodes, here.failed(), previous)
        words = F.size(fulltext.words(F.col("title"))) + F.size(fulltext.words(F.col("body")))
        changed = self.store.write(changed.withColumn("words", words.cast("bigint")), version, "changed")
        gone = self.store.write(tombstones(old_nodes, rows).select("id", "words"), version, "gone")
        texts = changed.where("texts")

        self.store.write_sorted(changed.drop("texts", "known", "old_words"), version, "nodes", "id", self.rows_per_file)
        before = [] if anew else self.store.segments(here.version)
        replaced = changed.where("known").select("id", F.explode(F.when(F.col("texts"), F.array(*map(F.lit, PARTS))).otherwise(F.array(F.lit("node")))).alias("part"))
        # What a note that is gone left in the table of failures stays there.
        lost = gone.select("id", F.explode(F.array(F.lit("node"), F.lit("text"))).alias("part"))
        self.store.write(replaced.unionByName(lost), version, "replaced")

        asked_of = capacity.advertised_tokens(
            self.spark.createDataFrame([(embedder.identity, getattr(embedder, "max_tokens", None))], "provider string, advertised int"), now)
        nothing = self.spark.createDataFrame([], "provider string, learned int")
        capacities = self.store.write(capacity.upserted(here.capacity(), asked_of, nothing, now).coalesce(1), version, "advertised")
        fitting = capacity.within(config, capacities, embedder.identity)

        touched = texts.select(F.col("id").alias("node_id"))
        stored = reusable.join(touched, "node_id", "left_semi")
        # The chunker is one large expression: what is planned on top of it starts from a table.
        pieces = self.store.write(to_chunks(texts, fitting), version, "pieces")
        diffed = reused_vectors(diff_chunks(pieces, stored), stored)
        # Every later table reads the stored attempts, so each chunk is embedded once.
        attempts = self.store.write(embed_chunks(diffed, embedder), version, "attempts")
        attempts, learned = self._tried_again(attempts, texts, stored, embedder, fitting, version)
        self.store.write(capacity.upserted(capacities, asked_of, learned, now).coalesce(1), version, "capacity")
        self.store.write_sorted(_stored(attempts), version, "chunks", "id", self.rows_per_file)
        failed = failures(attempts, texts, now)
        if anew:
            failed = failed.unionByName(here.failed().join(rows.select(F.col("id").alias("node_id")), "node_id", "left_anti"))
        self.store.write(failed, version, "failed_chunks")
        self._write_postings(fulltext.build_postings(texts), version)
        self._write_totals(None if anew else here, changed, gone, version)
        settings = [
            ("embedder", embedder.identity), ("dim", str(embedder.dim)), ("indexed_at", str(now)), ("chunker", repr(config))]
        self.store.write(self.spark.createDataFrame([(k, v, now) for k, v in settings], schema.METADATA), version, "metadata")

        counters = pass_stats(attempts, stale_chunks(stored, attempts), rows, gone).first().asDict()
        if keys is None and not anew:
            # Chunks of notes that were not touched.
            left = previous.join(touched.unionByName(gone.select(F.col("id").alias("node_id"))), "node_id", "left_anti")
            counters["chunks_skipped"] += left.count()
        # All of them, with whole messages, as a table.
        counters["failures"] = attempts.where(F.col("reason").isNotNull()).select(F.col("id").alias("chunk_id"), "reason", "error")
        self.store.publish(version, before)
        if len(before) >= self.max_segments:
            self.compact()
        return counters

    def _tried_again(
        self, attempts: DataFrame, texts: DataFrame, stored: DataFrame, embedder: Embedder, config: ChunkerConfig, version: int
    ) -> tuple[DataFrame, DataFrame]:
        """The attempts, with those of notes that had a chunk refused made anew from shorter chunks; and what was learned."""
        learned = self._learned(attempts, embedder, version, 0)
        for again in (1, 2):
            row = learned.first()
            if row is None:
                break
            chars = capacity.FLOOR_CHARS if again == 2 else int(row["learned"] * CHARS_PER_TOKEN)
            shorter = capacity.shortened(config, chars)
            if shorter == config:
                continue
            refused = self.store.write(attempts.where("reason = 'too-long'").select("node_id").distinct(), version, f"refused_{again}")
            if refused.isEmpty():
                break
            notes = texts.join(refused.withColumnRenamed("node_id", "id"), "id", "left_semi")
            pieces = self.store.write(to_chunks(notes, shorter), version, f"pieces_{again}")
            tried = embed_chunks(reused_vectors(diff_chunks(pieces, stored), stored), embedder)
            # One table, so that each chunk is embedded once.
            tried = self.store.write(tried, version, f"tried_{again}")
            attempts = attempts.join(refused, "node_id", "left_anti").select(*tried.columns).unionByName(tried)
            learned = self._learned(tried, embedder, version, again, learned)
        return attempts, learned

    def _learned(self, attempts: DataFrame, embedder: Embedder, version: int, again: int, before: DataFrame | None = None) -> DataFrame:
        """One row, if anything was refused: the provider and the tokens learned so far."""
        rows = capacity.refused_tokens(attempts.withColumn("provider", F.lit(embedder.identity)))
        if before is not None:
            rows = rows.unionByName(before).groupBy("provider").agg(F.min("learned").alias("learned"))
        return self.store.write(rows.coalesce(1), version, f"learned_{again}")

    def compact(self) -> None:
        """Fold all segments of the current version into one."""
        here = self.pinned()
        version = self.store.begin()
        self.store.write_sorted(here._stored_nodes(), version, "nodes", "id", self.rows_per_file)
        self.store.write_sorted(here.chunks(), version, "chunks", "id", self.rows_per_file)
        self.store.write(here.failed(), version, "failed_chunks")
        self._write_postings(here.postings(), version)
        self.store.write(self.store.read("corpus", version=here.version), version, "corpus")
        self.store.write(self.store.read("metadata", schema.METADATA, here.version), version, "metadata")
        self.store.write(here.capacity(), version, "capacity")
        self.store.publish(version)

    def _check_width(self, known: dict[str, str], embedder: Embedder) -> None:
        same_provider = known.get("embedder") == embedder.identity
        if same_provider and known.get("dim") not in (None, str(embedder.dim)) and not self.chunks().isEmpty():
            raise DimensionMismatch(f"index holds {known['dim']} dimensions, provider gives {embedder.dim}")

    def _write_postings(self, postings: DataFrame, version: int) -> None:
        """Ranges over (term, cell, node) keep the scan of a term narrow, and split a term that many notes hold."""
        notes = self.spark.read.parquet(self.store.path(version, "nodes")).count()
        columns = [F.col(c) for c in ("term", "node_id", "length", "title_at", "body_at")]
        order = ("term", "cell", "node_id")
        # Ranges are drawn from a first reading of the rows, so what makes them must not run again for that.
        found = self.store.write(blockmax.in_cells(postings.select(*columns), notes), version, "found")
        rows = found.repartitionByRange(*order).sortWithinPartitions(*order)
        self.store.write(blockmax.blocks(self.store.write(rows, version, "postings")).repartitionByRange("term").sortWithinPartitions("term"), version, "blocks")

    def _write_totals(self, here: Index | None, changed: DataFrame, gone: DataFrame, version: int) -> None:
        """Notes and words of the whole index: what was before, plus new rows, minus those they replace and those gone."""
        sums = changed.agg(
            (F.count("*") - F.count_if("known")).alias("notes"),
            (F.coalesce(F.sum("words"), F.lit(0)) - F.coalesce(F.sum("old_words"), F.lit(0))).alias("words"))
        parts = sums.unionByName(gone.agg((-F.count("*")).alias("notes"), (-F.coalesce(F.sum("words"), F.lit(0))).alias("words")))
        if here is not None:
            parts = parts.unionByName(self.store.read("corpus", version=here.version))
        else:
            parts = sums
        self.store.write(parts.agg(F.sum("notes").alias("notes"), F.sum("words").alias("words")), version, "corpus")

    def status(self) -> dict:
        here = self.pinned()
        counts = {
            name: frame.count()
            for name, frame in (("nodes", here.nodes()), ("chunks", here.chunks()), ("failed_chunks", here.failed()))
        }
        known = here.metadata()
        taken = here.capacity().where(F.col("provider") == known.get("embedder")).select(capacity.effective()).first()
        return {
            **counts,
            "max_tokens": taken[0] if taken else None,
            "last_indexed_at": int(known["indexed_at"]) if "indexed_at" in known else None,
            "embedder": known.get("embedder"),
            "dim": int(known["dim"]) if "dim" in known else None,
        }


def _stored(attempts: DataFrame) -> DataFrame:
    rows = attempts.where(F.col("reason").isNull())
    return rows.select(
        "id", "node_id", "chunk_index", "heading", "heading_level", "content", "content_hash", "start_line", "end_line",
        "embedding",
    )
