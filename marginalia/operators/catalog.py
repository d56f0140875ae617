"""Folders and notes: liveness, paths, counts, scopes and ordered pages."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.functions import ids
from marginalia.operators import closure


# -- folders -----------------------------------------------------------------


def not_marked() -> Column:
    return ~F.coalesce(F.col("marked"), F.lit(False))


def delete_logged(rows: DataFrame, changes: DataFrame, entity: int) -> DataFrame:
    """Rows whose deletion is in the change log."""
    return rows.join(_deletes(changes, entity), "pk", "left_semi")


def _deletes(changes: DataFrame, entity: int) -> DataFrame:
    hit = (F.col("entity") == entity) & (F.col("change_type") == schema.CHANGE_DELETE)
    return changes.where(hit).select(F.col("entity_pk").alias("pk"))


def live_folders(folders: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Named, unmarked folders; a logged delete counts only without a server record."""
    live = folders.where(F.col("name").isNotNull() & not_marked())
    if changes is None:
        return live
    confirmed = F.coalesce(F.col("has_server_record"), F.lit(False))
    # A null key never matches, so confirmed folders pass the anti join untouched.
    suspect = F.when(~confirmed, F.col("pk"))
    gone = _deletes(changes, schema.ENTITY_FOLDER).select(F.col("pk").alias("_gone"))
    return live.withColumn("_suspect", suspect).join(gone, F.col("_suspect") == F.col("_gone"), "left_anti").drop("_suspect")


def _is_ghost() -> Column:
    confirmed = F.coalesce(F.col("has_server_record"), F.lit(False))
    return ~confirmed & F.coalesce(F.col("needs_fetch"), F.lit(False))


def visible_folders(folders: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Live folders without placeholders that still wait for their server record."""
    return live_folders(folders, changes).where(~_is_ghost())


def ghost_folders(folders: DataFrame) -> DataFrame:
    return folders.where(F.col("name").isNotNull() & not_marked() & _is_ghost())


def trash_folders(folders: DataFrame) -> DataFrame:
    return folders.where(F.col("folder_type") == schema.FOLDER_TYPE_TRASH).select("pk")


def default_folder(folders: DataFrame) -> DataFrame:
    """The default folder: lowest key among the identifiers with the reserved prefix."""
    return folders.where(F.col("id").startswith("DefaultFolder-")).agg(F.min("pk").alias("pk"))


def folder_is_shared(folders: DataFrame) -> DataFrame:
    return folders.where(F.coalesce(F.col("shared"), F.lit(False)))


def climbed(tree: DataFrame) -> DataFrame:
    """``pk, top, depth`` of every folder of ``pk, parent_pk, name`` that hangs from a root; see :func:`closure.folder_tree`."""
    return closure.folder_tree(tree).select("pk", F.element_at("keys", 1).alias("top"), (F.size("keys") - 1).alias("depth"))


def folder_paths(folders: DataFrame) -> DataFrame:
    """``pk, path, depth`` of every folder that hangs from a root; see :func:`cyclic_folders` for the others."""
    return closure.paths(closure.folder_tree(folders))


def cyclic_folders(folders: DataFrame, paths: DataFrame) -> DataFrame:
    """Folders on or below a parent cycle: they have no path."""
    return folders.join(paths.select("pk"), "pk", "left_anti")


def note_counts(notes: DataFrame) -> DataFrame:
    """Unmarked notes directly in each folder."""
    return (
        notes.where(F.col("title").isNotNull() & not_marked())
        .groupBy("folder_pk")
        .agg(F.count("*").alias("note_count"))
    )


def list_folders(
    folders: DataFrame,
    notes: DataFrame | None = None,
    accounts: DataFrame | None = None,
    changes: DataFrame | None = None,
    include_trash: bool = False,
    tree: DataFrame | None = None,
) -> DataFrame:
    """Visible folders with full path, owner account and, given ``notes``, direct counts.

    ``tree`` is the closure of the visible folders where it is kept; without it, it is made.
    """
    visible = visible_folders(folders, changes)
    paths = closure.paths(closure.folder_tree(visible) if tree is None else tree)
    rows = visible.join(paths, "pk", "left").withColumn(
        "is_trash", F.coalesce(F.col("folder_type") == schema.FOLDER_TYPE_TRASH, F.lit(False))
    )
    if not include_trash:
        rows = rows.where(~F.col("is_trash"))
    if accounts is not None:
        owner = accounts.select(F.col("pk").alias("account_pk"), F.col("name").alias("account"))
        rows = rows.join(owner, "account_pk", "left")
    else:
        rows = rows.withColumn("account", F.lit(None).cast("string"))
    columns = [
        F.col("pk"),
        ids.short_folder_id(F.col("pk")).alias("id"),
        "name",
        "parent_pk",
        "path",
        "is_trash",
        "account",
        F.coalesce(F.col("shared"), F.lit(False)).alias("shared"),
    ]
    if notes is not None:
        counts = note_counts(notes).withColumnRenamed("folder_pk", "pk")
        rows = rows.join(counts, "pk", "left")
        columns.append(F.coalesce(F.col("note_count"), F.lit(0)).cast("bigint").alias("note_count"))
    return rows.select(*columns)


def in_scope(path: Column, folder_path: str) -> Column:
    """The folder itself or anything below it, ignoring case and outer slashes."""
    needle = folder_path.strip("/").lower()
    if not needle:
        return F.lit(False)
    low = F.lower(path)
    return (low == needle) | low.startswith(needle + "/")


def find_folder(listing: DataFrame, folder_path: str) -> DataFrame:
    """First folder with exactly this path."""
    needle = folder_path.strip("/").lower()
    return listing.where(F.lower("path") == needle).orderBy("pk").limit(1)


# -- notes -------------------------------------------------------------------


def lock_state(password: Column, vector: Column, mode: Column) -> Column:
    return (F.coalesce(password, F.lit(0)) != 0) | vector.isNotNull() | mode.isNotNull()


def share_role(shared: Column, zone_owner: Column) -> Column:
    shared = F.coalesce(shared, F.lit(False))
    return F.when(~shared, "unshared").when(zone_owner.isNotNull(), "participant").otherwise("owner")


def live_notes(notes: DataFrame, folders: DataFrame, changes: DataFrame | None = None) -> DataFrame:
    """Titled, unmarked notes in a live folder; a note without a folder is not live."""
    homes = live_folders(folders, changes).select(F.col("pk").alias("folder_pk"))
    titled = notes.where(F.col("title").isNotNull() & not_marked())
    return titled.join(homes, "folder_pk", "left_semi")


def without_trash(notes: DataFrame, folders: DataFrame) -> DataFrame:
    return notes.join(trash_folders(folders).withColumnRenamed("pk", "folder_pk"), "folder_pk", "left_anti")


def within(notes: DataFrame, after: datetime | None = None, before: datetime | None = None) -> DataFrame:
    """Inclusive range of modification times; a missing time falls outside any bound."""
    if after is not None:
        notes = notes.where(F.col("modified") >= F.lit(after))
    if before is not None:
        notes = notes.where(F.col("modified") <= F.lit(before))
    return notes


def homes(
    folders: DataFrame, changes: DataFrame | None = None, scope: DataFrame | None = None, include_trash: bool = False
) -> DataFrame:
    """Keys of the folders whose notes are listed.

    ``scope`` is a frame of folder keys; an explicit scope reaches into the trash without ``include_trash``.
    """
    live = live_folders(folders, changes).select("pk")
    if scope is not None:
        return live.join(scope.select("pk"), "pk", "left_semi")
    return live if include_trash else live.join(trash_folders(folders), "pk", "left_anti")


def select_notes(
    notes: DataFrame,
    folders: DataFrame,
    changes: DataFrame | None = None,
    scope: DataFrame | None = None,
    include_trash: bool = False,
    after: datetime | None = None,
    before: datetime | None = None,
) -> DataFrame:
    """Notes under the listing rules; ``scope`` as for :func:`homes`."""
    # All that depends on the folder is settled among folders first, which leaves one join for the notes.
    own = homes(folders, changes, scope, include_trash)
    titled = within(notes, after, before).where(F.col("title").isNotNull() & not_marked())
    return titled.join(own.withColumnRenamed("pk", "folder_pk"), "folder_pk", "left_semi")


def with_path(notes: DataFrame, paths: DataFrame) -> DataFrame:
    """Add the folder path, blank where the folder has none."""
    names = paths.select(F.col("pk").alias("folder_pk"), F.col("path").alias("folder"))
    return notes.join(names, "folder_pk", "left").withColumn("folder", F.coalesce("folder", F.lit("")))


def recency() -> list[Column]:
    return [F.col("modified").desc_nulls_last(), F.col("pk")]


def page(rows: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page plus a look-ahead row that tells whether another page follows."""
    return rows.orderBy(*order).offset(offset).limit(limit + 1)


def attachment_counts(attachments: DataFrame) -> DataFrame:
    """Attachments per note; deleted ones count too."""
    return attachments.groupBy("note_pk").agg(F.count("*").alias("attachments"))


def note_states(notes: DataFrame, pks: DataFrame, include_marked: bool = False) -> DataFrame:
    """State of the given notes; marked rows are hidden unless asked for."""
    rows = notes if include_marked else notes.where(not_marked())
    return rows.where(F.col("title").isNotNull()).join(pks.select("pk"), "pk", "left_semi").select(
        "pk", "id", "title", "folder_pk", "modified", "marked", "pinned", "locked", "shared",
        share_role(F.col("shared"), F.col("zone_owner")).alias("share_role"),
    )


def index_source(
    notes: DataFrame, folders: DataFrame, changes: DataFrame | None = None, include_all: bool = False
) -> DataFrame:
    """Input of the indexer: node key, leaf folder name, whole seconds, body hidden when locked."""
    leaf = folders.select("pk", F.col("name").alias("folder"))
    if include_all:
        rows = notes.join(leaf.withColumnRenamed("pk", "folder_pk"), "folder_pk", "left")
    else:
        homes = live_folders(folders, changes).select("pk").join(trash_folders(folders), "pk", "left_anti").join(leaf, "pk")
        titled = notes.where(F.col("title").isNotNull() & not_marked())
        rows = titled.join(homes.withColumnRenamed("pk", "folder_pk"), "folder_pk")
    return rows.where(F.col("id").isNotNull()).select(
        "id",
        F.col("pk").alias("z_pk"),
        "title",
        "folder",
        F.coalesce(F.unix_timestamp("modified"), F.lit(0)).cast("bigint").alias("modified_at"),
        F.coalesce(F.col("locked"), F.lit(False)).alias("locked"),
        F.coalesce(F.col("pinned"), F.lit(False)).alias("pinned"),
        F.when(~F.coalesce(F.col("locked"), F.lit(False)), F.col("body")).alias("body"),
    )
