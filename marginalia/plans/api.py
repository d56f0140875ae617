"""The engine's front door: typed arguments in, pages and envelopes out."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.config import EngineConfig
from marginalia.functions import ids
from marginalia.operators import catalog as cat
from marginalia.operators import blockmax, closure, fulltext, lexical, listing, mutations, overlays, retrieval
from marginalia.operators.embedding import Embedder, create_embedder, embed_query
from marginalia.operators.indexing import Index
from marginalia.operators.rendering import FORMATS, plain_html, render_bodies
from marginalia.session import stored
from marginalia.sources.notestore import decoded_bodies
from marginalia.sources.sorted_files import ROWS_PER_FILE

RECENT = 50
# Fixed value: what stands for the body of a locked note.
LOCKED_BODY = "[locked — unlock this note to read its contents]"


@dataclass
class Page:
    """One page of results; ``next_cursor`` is set exactly when there are more."""

    results: list[dict] = field(default_factory=list)
    returned: int = 0
    has_more: bool = False
    next_cursor: str | None = None
    total_estimate: int | None = None


def _counted(name: str, value: int, least: int = 1) -> int:
    if value < least:
        raise ValueError(f"{name} starts at {least}; got {value}")
    return value


def _page(rows: list[dict], limit: int, offset: int, total: int | None = None) -> Page:
    more = len(rows) > limit
    return Page(rows[:limit], min(len(rows), limit), more, ids.encode_cursor(offset + limit) if more else None, total)


@dataclass
class NotesEngine:
    """Queries over one corpus of notes, and edits that replace its tables."""

    spark: SparkSession
    notes: DataFrame
    folders: DataFrame
    accounts: DataFrame | None = None
    changes: DataFrame | None = None
    attachments: DataFrame | None = None
    overlay: DataFrame | None = None
    config: EngineConfig = field(default_factory=EngineConfig)
    embedder: Embedder | None = None
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)
    _base: DataFrame | None = field(default=None, init=False, repr=False)
    _edits: DataFrame | None = field(default=None, init=False, repr=False)
    _merged: DataFrame | None = field(default=None, init=False, repr=False)
    _tree: DataFrame | None = field(default=None, init=False, repr=False)
    _tree_of: tuple | None = field(default=None, init=False, repr=False)
    _layout: listing.Layout | None = field(default=None, init=False, repr=False)
    _laid: DataFrame | None = field(default=None, init=False, repr=False)
    _hidden: DataFrame | None = field(default=None, init=False, repr=False)

    def _provider(self) -> Embedder:
        """The given embedder or the configured one; there is none by default."""
        self.embedder = self.embedder or create_embedder(self.config)
        return self.embedder

    # -- catalog -------------------------------------------------------------

    def folder_frame(self, include_counts: bool = False) -> DataFrame:
        """All visible folders, the trash included, with overlays applied."""
        rows = cat.list_folders(
            self.folders, self.notes if include_counts else None, self.accounts, self.changes, include_trash=True, tree=self.tree()
        )
        if self.overlay is None:
            return rows
        alive = overlays.active(self.overlay, self.clock())
        return overlays.apply_renames(overlays.without_removed(rows, alive), alive)

    def tree(self) -> DataFrame:
        """The closure of the visible folders. It is walked once; edits of folders made here change its rows."""
        if self._tree_of is None or self._tree_of[0] is not self.folders or self._tree_of[1] is not self.changes:
            self._keep_tree(closure.folder_tree(cat.visible_folders(self.folders, self.changes)))
        return self._tree

    def _keep_tree(self, tree: DataFrame) -> None:
        self._tree, self._tree_of = stored(tree, "tree"), (self.folders, self.changes)

    def list_folders(self, include_counts: bool = False, include_trash: bool = False) -> list[dict]:
        rows = self.folder_frame(include_counts)
        rows = rows if include_trash else rows.where(~F.col("is_trash"))
        return [r.asDict() for r in rows.drop("pk", "parent_pk").orderBy("path").collect()]

    def _scope(self, folders: DataFrame, folder_path: str | None) -> DataFrame | None:
        if not folder_path:
            return None
        scope = folders.where(cat.in_scope(F.col("path"), folder_path)).select("pk")
        if scope.isEmpty():
            raise ValueError(f"unknown folder path {folder_path!r}")
        return scope

    def _selected(self, folders, folder_path, include_trash, after, before) -> DataFrame:
        return cat.select_notes(
            self.notes, self.folders, self.changes, self._scope(folders, folder_path), include_trash,
            ids.parse_instant(after), ids.parse_instant(before),
        )

    @staticmethod
    def _summary(rows: DataFrame, folders: DataFrame, *extra: str) -> DataFrame:
        return cat.with_path(rows, folders).select(
            ids.short_id(F.col("pk")).alias("id"), "title", "folder",
            ids.display_time(F.col("modified")).alias("modified"), "pinned", "locked", "shared", *extra,
        )

    def lay_out(self, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
        """Write the notes to ``path`` in the order of listings; from now on these are the base, and pages and totals read what they need.

        Edits are kept beside the layout. Call it again, with another path, to take in many of them.
        """
        self._layout = listing.Layout.written(self.notes, path, rows_per_file)
        self.notes = self._laid = self._layout.notes
        self._hidden = None

    def _laid_out(self) -> bool:
        """Whether the notes are those of the layout, with or without edits made here."""
        return self._layout is not None and (self.notes is self._laid or (self.notes is self._merged and self._base is self._laid))

    def _behind(self, cursor: str | None, *names: str) -> tuple[dict | None, int]:
        """The last row of the page before, or an offset where the cursor holds a plain number."""
        if cursor is None:
            return None, 0
        try:
            row = ids.decode_state(cursor, *names)
        except ValueError:
            return None, ids.decode_cursor(cursor)
        if not all(isinstance(v, (int, float)) for v in row.values()):
            raise ValueError(f"invalid cursor: {cursor!r}")
        return row, 0

    def _listed(self, homes, after, before, limit, behind=None, offset=0, open_only=False) -> tuple[DataFrame, Callable[[], int]]:
        """A page of notes with ``late`` and one row more, and what counts all of them."""
        low, high = (None if t is None else -ids.micros(t) for t in (before, after))
        if self._laid_out() and not offset:
            edits, hidden = (self._edits, self._hidden) if self.notes is self._merged else (None, None)
            page = self._layout.page(homes, limit, behind, edits, hidden, open_only, low, high)
            return page, lambda: self._layout.total(homes, edits, hidden, low, high)
        rows = cat.within(self.notes, after, before).where(F.col("title").isNotNull() & cat.not_marked())
        rows = rows.join(homes.withColumnRenamed("pk", "folder_pk"), "folder_pk", "left_semi")
        shown = (rows.where(~F.col("locked")) if open_only else rows).drop("body").withColumn("late", listing.late())
        order = [F.col("late"), F.col("pk")]
        return cat.page(shown.where(listing.behind(behind, "late", "pk")), order, limit, offset), rows.count

    def list_notes(
        self, folder_path: str | None = None, limit: int = 20, cursor: str | None = None, include_trash: bool = False,
        modified_after: str | None = None, modified_before: str | None = None,
    ) -> Page:
        """Notes by time, latest first. The cursor names the last note shown, so a page costs the same wherever it lies."""
        limit, (behind, offset) = _counted("limit", limit), self._behind(cursor, "late", "pk")
        folders = self.folder_frame()
        homes = cat.homes(self.folders, self.changes, self._scope(folders, folder_path), include_trash)
        page, total = self._listed(homes, ids.parse_instant(modified_after), ids.parse_instant(modified_before), limit, behind, offset)
        # Sorted anew by a column of its own: a second sort by the same columns is taken for redundant, though the join may reorder rows.
        shown = self._summary(retrieval.ranked(page, F.col("late"), F.col("pk")), folders, "late", "pk", "rank").orderBy("rank")
        return self._keyed_page([r.asDict() for r in shown.drop("rank").collect()], limit, ("late", "pk"), ("late", "pk"), total())

    @staticmethod
    def _keyed_page(rows: list[dict], limit: int, key: tuple, hide: tuple, total: int | None = None) -> Page:
        """A page whose cursor holds the ``key`` of its last row; ``hide`` names columns for the cursor alone."""
        more = len(rows) > limit
        cursor = ids.encode_state(**{k: rows[limit - 1][k] for k in key}) if more else None
        results = [{k: v for k, v in r.items() if k not in hide} for r in rows[:limit]]
        return Page(results, len(results), more, cursor, total)

    def recent(self, limit: int = RECENT) -> list[dict]:
        """The latest readable notes."""
        folders = self.folder_frame()
        page, _ = self._listed(cat.homes(self.folders, self.changes), None, None, limit, open_only=True)
        shown = self._summary(retrieval.ranked(page, F.col("late"), F.col("pk")), folders, "rank")
        return [r.asDict() for r in shown.where(F.col("rank") <= limit).orderBy("rank").drop("rank").collect()]

    # -- lexical search ------------------------------------------------------

    def search_notes(
        self, query: str, folder_path: str | None = None, search_body: bool = True, fuzzy: bool = False,
        mode: str = "substring", limit: int = 10, cursor: str | None = None, include_body: bool = False,
        max_body_chars: int = 1200, include_trash: bool = False, modified_after: str | None = None,
        modified_before: str | None = None, previews: int | None = None,
    ) -> Page:
        """Notes that match, best first.

        ``include_body`` adds the first ``max_body_chars`` characters of each body on the page, or of the first ``previews``.
        """
        if not query.strip():
            return Page()
        limit, (behind, offset) = _counted("limit", limit), self._behind(cursor, "worse", "late", "pk")
        folders = self.folder_frame()
        rows = self._selected(folders, folder_path, include_trash, modified_after, modified_before)
        hits = lexical.after(lexical.match_notes(rows, query, mode, fuzzy, search_body), behind)
        page = lexical.with_snippets(cat.page(hits, lexical.ranking(), limit, offset), search_body)
        page = retrieval.ranked(page, *lexical.ranking())
        chars = _counted("max_body_chars", max_body_chars, 0)
        wanted = F.lit(include_body and chars > 0) & ~F.col("locked")
        if previews is not None:
            wanted = wanted & (F.col("rank") <= _counted("previews", previews, 0))
        page = page.withColumn("body_preview", F.when(wanted, F.substring("body", 1, chars)))
        shown = self._summary(page, folders, "score", "match_count", "snippets", "body_preview", "rank", "worse", "late", "pk")
        found = [r.asDict() for r in shown.orderBy("rank").drop("rank").collect()]
        return self._keyed_page(found, limit, ("worse", "late", "pk"), ("worse", "late", "pk"))

    # -- single notes --------------------------------------------------------

    def get_note(self, note_id: str | list[str], format: str = "markdown", fast: bool = False):
        """One note, or a list of any length with a ``skipped`` entry for each that failed."""
        if isinstance(note_id, str):
            found = self._details([note_id], format, fast)[0]
            if found.get("action") == "skipped":
                raise ValueError(found["error"])
            return found
        return self._details(note_id, format, fast) if note_id else []

    def note_frame(self, requests: DataFrame, format: str = "markdown", fast: bool = False) -> DataFrame:
        """The notes that ``requests`` (request_no, note_id) name, with their bodies in ``format``; as many as there are.

        A request without a note keeps its row, with a null ``pk``. The html of a note is rendered where the table has a
        column ``html``; elsewhere the stored text stands in, escaped for html. Checklist states come from the stored
        blobs where the table has them.
        """
        if format not in FORMATS:
            raise ValueError(f"unknown format {format!r}; one of {', '.join(FORMATS)}")
        if fast and format != "text":
            raise ValueError("fast reads the stored text, so it goes with format='text' only")
        asked = requests.select(
            "request_no", F.col("note_id").alias("asked"), F.when(ids.id_kind(F.col("note_id")) == "note", ids.id_pk(F.col("note_id"))).alias("pk"))
        keys = asked.select("pk").where(F.col("pk").isNotNull()).distinct()
        rows = self.notes.where(cat.not_marked() & F.col("title").isNotNull()).join(keys, "pk", "left_semi")
        shown = self._summary(rows, self.folder_frame(), "pk", "body")
        if self.attachments is not None:
            counts = cat.attachment_counts(self.attachments.join(keys.withColumnRenamed("pk", "note_pk"), "note_pk", "left_semi"))
            shown = shown.join(counts.withColumnRenamed("note_pk", "pk"), "pk", "left").fillna(0, ["attachments"])
        if not fast and ("html" in rows.columns or format == "html"):
            open_rows = rows.where(~F.coalesce("locked", F.lit(False)))
            if "html" not in rows.columns:
                open_rows = open_rows.withColumn("html", plain_html(F.col("body")))
            states = decoded_bodies(open_rows) if {"blob", "mergeable"} <= set(rows.columns) else None
            bodies = render_bodies(open_rows, "pk", "html", format, states).select("pk", F.col("body").alias("rendered"))
            shown = shown.join(bodies, "pk", "left").withColumn("body", F.coalesce("rendered", "body")).drop("rendered")
        body = F.when(F.col("locked"), LOCKED_BODY).otherwise(F.coalesce("body", F.lit("")))
        found = shown.withColumn("body", body).withColumn("format", F.lit(format)).withColumnRenamed("pk", "_pk")
        return asked.join(found, F.col("pk") == F.col("_pk"), "left").drop("pk").withColumnRenamed("_pk", "pk")

    def _details(self, wanted: list[str], fmt: str, fast: bool) -> list[dict]:
        requests = self.spark.createDataFrame(list(enumerate(wanted)), "request_no bigint, note_id string")
        out = []
        for r in self.note_frame(requests, fmt, fast).orderBy("request_no").collect():
            row = r.asDict()
            asked, pk = row.pop("asked"), row.pop("pk")
            del row["request_no"]
            out.append(row if pk is not None else {"id": asked, "action": "skipped", "error": f"no such note: {asked!r}"})
        return out

    # -- semantic search -----------------------------------------------------

    @property
    def index(self) -> Index:
        if not self.config.index_root:
            raise ValueError("no index_root configured")
        return Index(self.spark, self.config.index_root)

    def reindex_semantic(self) -> dict:
        source = cat.index_source(self.notes, self.folders, self.changes)
        return self.index.reindex(source, self._provider(), self.config.chunker)

    def semantic_index_status(self) -> dict:
        return self.index.status()

    def _enriched(self, index: Index, hits: DataFrame) -> list[dict]:
        """A page of hits with the fields of their notes, in order of ``rank``."""
        hits = retrieval.held(hits)
        nodes = index.few_nodes([r["node_id"] for r in hits.select("node_id").collect()]).select(
            F.col("id").alias("node_id"), "title", "folder", "pinned", "locked",
            ids.display_time(F.timestamp_seconds("modified_at")).alias("modified"),
        )
        rows = nodes.join(hits, "node_id").orderBy("rank").drop("rank")
        return [r.asDict() for r in rows.withColumnRenamed("node_id", "id").collect()]

    def semantic_search(self, query: str, limit: int = 20, unique: str = "notes", cursor: str | None = None) -> Page:
        if not query.strip():
            return Page(total_estimate=0)
        limit, offset = _counted("limit", limit), ids.decode_cursor(cursor)
        index, vector = self.index.pinned(), embed_query(self._provider(), query)
        hits = retrieval.semantic(index.chunks(), vector, limit + 1, unique, offset, index.few_chunks)
        shown = hits.select("node_id", F.col("id").alias("chunk_id"), "heading", "start_line", "end_line", "excerpt", "score", "distance", "cosine", "rank")
        return _page(self._enriched(index, shown), limit, offset)

    def fulltext_search(self, query: str, limit: int = 20, cursor: str | None = None) -> Page:
        limit, offset = _counted("limit", limit), ids.decode_cursor(cursor)
        index = self.index.pinned()
        terms = blockmax.words_of(self.spark, query)
        if terms:
            # Whole words: only blocks of notes that can reach the page are scored.
            found = index.top_words(terms, offset + limit + 1).hits
        else:
            found = fulltext.search(index.postings(), index.stats(), query)
        page = retrieval.held(fulltext.top(found, limit + 1, offset))
        if page.isEmpty():
            return Page()
        nodes = index.few_nodes([r["node_id"] for r in page.select("node_id").collect()])
        shown = fulltext.with_excerpts(page, nodes, query, limit + 1)
        return _page([r.asDict() for r in shown.orderBy(*fulltext.best_first()).collect()], limit, offset)

    def hybrid_search(
        self, query: str, limit: int = 20, unique: str = "notes", cursor: str | None = None, depth: int = retrieval.HYBRID_DEPTH
    ) -> Page:
        """Fused results of the first ``depth`` places of both lists. The cursor carries the depth of the first page to the others."""
        if not query.strip():
            return Page(total_estimate=0)
        state = ids.decode_state(cursor, "offset", "depth") or {"offset": 0, "depth": _counted("depth", depth)}
        limit, offset, depth = _counted("limit", limit), _counted("offset", state["offset"], 0), _counted("depth", state["depth"])
        index, vector = self.index.pinned(), embed_query(self._provider(), query)
        fused = retrieval.hybrid(
            index.chunks(), index.postings(), index.stats(), vector, query, limit + 1, unique, depth, offset)
        page = retrieval.held(fused)
        keys = page.select("chunk_id", "node_id").where(F.col("chunk_id").isNotNull()).collect()
        chunks = index.few_chunks([r["chunk_id"] for r in keys], [r["node_id"] for r in keys]).select(
            F.col("id").alias("chunk_id"), "heading", "start_line", "end_line",
            F.substring("content", 1, retrieval.EXCERPT_CHARS).alias("excerpt"),
        )
        found = _page(self._enriched(index, page.join(chunks, "chunk_id", "left")), limit, offset)
        if found.has_more:
            found.next_cursor = ids.encode_state(offset=offset + limit, depth=depth)
        return found

    # -- edits ---------------------------------------------------------------

    def _requests(self, rows: list[tuple], columns: str) -> DataFrame:
        if not rows:
            raise ValueError("nothing to do: the batch has no items")
        return self.spark.createDataFrame([(i, *row) for i, row in enumerate(rows)], f"request_no bigint, {columns}")

    def _keep(self, changed: DataFrame) -> None:
        """Add changed notes to the table of edits; the notes are the base with these rows in place.

        Only the edits are written, whatever the size of the base. :meth:`folded` makes a new base of both.
        """
        if self.notes is not self._merged:
            self._base, self._edits = self.notes, None
        edits = changed if self._edits is None else mutations.overlaid(self._edits, changed)
        self._edits = stored(edits, "edits")
        self.notes = self._merged = mutations.overlaid(self._base, self._edits)
        if self._layout is not None and self._base is self._laid:
            self._hidden = stored(self._layout.hidden(self._edits), "hidden")

    def folded(self, path: str) -> None:
        """Write base and edits to ``path`` as one table, which is the base from now on."""
        self.notes.write.parquet(path)
        self.notes = self.spark.read.schema(self.notes.schema).parquet(path)

    def _apply(self, change: mutations.Change) -> list[dict]:
        outcomes = [r.asDict() for r in change.outcomes.orderBy("request_no").drop("request_no").collect()]
        self._keep(change.changed)
        return outcomes

    def _folder_pk(self, folder_path: str | None) -> int:
        if not folder_path:
            pk = cat.default_folder(self.folders).first()["pk"]
            if pk is None:
                raise ValueError("there is no default folder; name one")
            return pk
        row = cat.find_folder(self.folder_frame(), folder_path).first()
        if row is None:
            raise ValueError(f"unknown folder path {folder_path!r}")
        return row["pk"]

    def create_notes(self, notes: list[tuple[str, str]], folder_path: str | None = None, format: str = "markdown") -> list[dict]:
        requests = self._requests(notes, "title string, body string")
        return self._apply(mutations.create_notes(self.notes, requests, self._folder_pk(folder_path), F.lit(self.clock()), format))

    def update_note(self, note_id: str, body: str, append: bool = False, format: str = "markdown", allow_attachment_loss: bool = False) -> dict:
        requests = self._requests([(note_id, body)], "note_id string, body string")
        change = mutations.update_notes(
            self.notes, self.folders, requests, F.lit(self.clock()), self.attachments, append, format, allow_attachment_loss
        )
        return self._apply(change)[0]

    def rename_notes(self, note_ids: list[str], new_titles: list[str]) -> list[dict]:
        if len(note_ids) != len(new_titles):
            raise ValueError(f"{len(note_ids)} ids but {len(new_titles)} titles")
        requests = self._requests(list(zip(note_ids, new_titles)), "note_id string, new_title string")
        return self._apply(mutations.rename_notes(self.notes, self.folders, requests, F.lit(self.clock())))

    def move_notes(self, note_ids: list[str], folder_path: str) -> list[dict]:
        requests = self._requests([(n,) for n in note_ids], "note_id string")
        goal = self._folder_pk(folder_path)
        return self._apply(mutations.move_notes(self.notes, self.folders, requests, goal, F.lit(self.clock())))

    def delete_notes(self, note_ids: list[str], confirm_shared_delete: bool = False) -> list[dict]:
        requests = self._requests([(n,) for n in note_ids], "note_id string")
        change = mutations.delete_notes(self.notes, self.folders, requests, F.lit(self.clock()), confirm_shared_delete)
        return self._apply(change)

    def create_folder(self, name: str, parent_folder_path: str | None = None) -> dict:
        tree = self.tree()
        folders, pk = mutations.create_folder(self.folders, self.folder_frame(), name, parent_folder_path)
        self.folders = stored(folders, "folders")
        parent = self.folders.where(F.col("pk") == pk).first()["parent_pk"]
        self._keep_tree(closure.added(tree, pk, name, parent))
        return {"id": f"f{pk}", "action": "created", "error": None}

    def rename_folder(self, folder_id: str, new_name: str) -> dict:
        tree = self.tree()
        self.folders = stored(mutations.rename_folder(self.folders, self.folder_frame(), folder_id, new_name), "folders")
        self._keep_tree(closure.renamed(tree, ids.parse_id(folder_id)[1], new_name))
        return {"id": folder_id, "action": "renamed", "error": None}

    def delete_folder(self, folder_id: str, **options) -> dict:
        tree = self.tree()
        if self.overlay is not None:
            options.setdefault("count_changes", overlays.count_deltas(self.overlay, self.clock()))
        folders, _, moved = mutations.delete_folder(self.folders, self.notes, self.folder_frame(), folder_id, **options)
        self._keep(moved)
        self.folders = stored(folders, "folders")
        tree = closure.removed(tree, ids.parse_id(folder_id)[1], options.get("recursive", False))
        # What hung below a hidden folder goes with it, too.
        left = cat.visible_folders(self.folders, self.changes).select("pk")
        self._keep_tree(tree.join(left, "pk", "left_semi"))
        return {"id": folder_id, "action": "deleted", "error": None}
