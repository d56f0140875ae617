"""A note store's wide entity table, normalised to notes, folders, accounts and changes."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import schema
from marginalia.functions import ids, wire
from marginalia.operators.catalog import lock_state
from marginalia.sources import sqlite_store

ENTITIES, BODIES, CHANGES, META = "ZICCLOUDSYNCINGOBJECT", "ZICNOTEDATA", "ACHANGE", "Z_METADATA"
# Columns that may name the owner account, best first.
ACCOUNT_KEYS = ("ZACCOUNT8", "ZACCOUNT7", "ZACCOUNT6", "ZACCOUNT5", "ZACCOUNT4", "ZACCOUNT3", "ZACCOUNT2", "ZACCOUNT1", "ZACCOUNT")
ACCOUNT_NAMES = ("ZNAME", "ZNAME2", "ZACCOUNTNAMEFORACCOUNTLISTSORTING")


def optional(rows: DataFrame, name: str, kind: str) -> Column:
    """The column, or nulls where this version of the store lacks it."""
    return F.col(name).cast(kind) if name in rows.columns else F.lit(None).cast(kind)


def first_filled(rows: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of the columns that exists and holds data; one column serves the whole table."""
    for name in names:
        if name in rows.columns and not rows.where(F.col(name).isNotNull()).limit(1).isEmpty():
            return name
    return None


@dataclass
class NoteStore:
    notes: DataFrame
    folders: DataFrame
    accounts: DataFrame
    changes: DataFrame | None
    attachments: DataFrame
    uuid: str | None = None


def _flag(rows: DataFrame, name: str) -> Column:
    return F.coalesce(optional(rows, name, "int"), F.lit(0)) != 0


def normalise(entities: DataFrame, bodies: DataFrame | None = None, changes: DataFrame | None = None) -> NoteStore:
    """Fixed schemas from the entity table, whatever optional columns it has."""
    e = entities
    locked = lock_state(optional(e, "ZISPASSWORDPROTECTED", "int"), optional(e, "ZCRYPTOINITIALIZATIONVECTOR", "binary"), optional(e, "ZLOCKEDNOTESMODE", "int"))
    shared = optional(e, "ZSERVERSHAREDATA", "binary").isNotNull()
    noted = e.where(F.col("ZTITLE1").isNotNull()).select(
        F.col("Z_PK").alias("pk"),
        F.col("ZIDENTIFIER").alias("id"),
        F.col("ZTITLE1").alias("title"),
        F.col("ZFOLDER").alias("folder_pk"),
        F.when(F.col("ZMODIFICATIONDATE1").isNotNull(), ids.catalog_time(F.col("ZMODIFICATIONDATE1"))).alias("modified"),
        _flag(e, "ZMARKEDFORDELETION").alias("marked"),
        _flag(e, "ZISPINNED").alias("pinned"),
        locked.alias("locked"),
        shared.alias("shared"),
        optional(e, "ZZONEOWNERNAME", "string").alias("zone_owner"),
        F.col("ZNOTEDATA").alias("_data"),
        optional(e, "ZMERGEABLEDATA1", "binary").alias("mergeable"),
    )
    if bodies is not None:
        blobs = bodies.select(F.col("Z_PK").alias("_data"), F.col("ZDATA").alias("blob"))
        noted = noted.join(blobs, "_data", "left")
    else:
        noted = noted.withColumn("blob", F.lit(None).cast("binary"))
    # The blob of a locked note never reaches the decoder.
    readable = F.when(~F.col("locked"), F.col("blob"))
    noted = noted.withColumn("body", F.when(~F.col("locked"), wire.body_text(readable))).drop("_data")

    filed = e.where(F.col("ZTITLE2").isNotNull())
    account = first_filled(filed, ACCOUNT_KEYS)
    folders = filed.select(
        F.col("Z_PK").alias("pk"),
        F.col("ZIDENTIFIER").alias("id"),
        F.col("ZTITLE2").alias("name"),
        F.col("ZPARENT").alias("parent_pk"),
        optional(e, "ZFOLDERTYPE", "int").alias("folder_type"),
        (F.col(account) if account else F.lit(None)).cast("bigint").alias("account_pk"),
        _flag(e, "ZMARKEDFORDELETION").alias("marked"),
        optional(e, "ZSERVERRECORDDATA", "binary").isNotNull().alias("has_server_record"),
        _flag(e, "ZNEEDSINITIALFETCHFROMCLOUD").alias("needs_fetch"),
        (shared | optional(e, "ZSHARETARGETMANAGEDOBJECTID", "bigint").isNotNull()).alias("shared"),
    )
    owners = e.where(F.col("Z_ENT") == schema.ENTITY_ACCOUNT)
    name = first_filled(owners, ACCOUNT_NAMES)
    accounts = owners.select(F.col("Z_PK").alias("pk"), (F.col(name) if name else F.lit(None)).cast("string").alias("name"))
    attached = e.where((F.col("Z_ENT") == schema.ENTITY_ATTACHMENT) & optional(e, "ZNOTE", "bigint").isNotNull())
    log = None if changes is None else changes.select(
        F.col("ZENTITY").cast("int").alias("entity"), F.col("ZENTITYPK").alias("entity_pk"),
        F.col("ZCHANGETYPE").cast("int").alias("change_type"),
    )
    return NoteStore(noted, folders, accounts, log, attached.select(optional(e, "ZNOTE", "bigint").alias("note_pk")))


def decoded_bodies(notes: DataFrame) -> DataFrame:
    """``pk, text, runs`` of readable notes, from the mergeable blob or the plain one."""
    blob = wire.pick_blob(F.col("mergeable"), F.col("blob"))
    rows = notes.where(~F.col("locked")).select("pk", wire.body_struct(blob).alias("_b"))
    return rows.where(F.col("_b.text").isNotNull()).select("pk", "_b.text", "_b.runs")


def open_store(spark: SparkSession, path: str) -> NoteStore:
    """Load a store file; a store without a change log lacks only that filter."""
    def table(name: str) -> DataFrame | None:
        return sqlite_store.read_table(spark, path, name) if sqlite_store.table_columns(path, name) else None

    entities = table(ENTITIES)
    if entities is None:
        raise sqlite_store.StoreError(f"{path!r} has no entity table")
    store = normalise(entities, table(BODIES), table(CHANGES))
    meta = table(META)
    row = meta.select("Z_UUID").first() if meta is not None else None
    store.uuid = row[0] if row else None
    return store
