"""The folder tree with the ancestors of each folder, kept up to date under edits.

A row holds a folder's key and the keys and names on the way to it from its root. Paths, scopes and subtrees are read off the row, without a
walk; creating, renaming and deleting change rows in one pass over the table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.session import settled

SCHEMA = "pk bigint, keys array<bigint>, names array<string>"


def folder_tree(folders: DataFrame) -> DataFrame:
    """``pk, keys, names`` of every folder of ``pk, parent_pk, name`` that hangs from a root.

    A folder whose parent is not among ``folders`` is a root. Each step joins a folder's stretch of ancestors to the stretch of its topmost
    one, so the number of joins is the logarithm of the depth. Stretches that meet a key twice are on or below a cycle; they end there
    and are left out.
    """
    tree = settled(folders.select("pk", "parent_pk", "name"))
    known = tree.select(F.col("pk").alias("_known"))
    start = tree.join(known, F.col("parent_pk") == F.col("_known"), "left")
    stretch = settled(start.select(
        "pk", F.col("_known").alias("up"), F.array("pk").alias("keys"), F.array("name").alias("names"), F.lit(False).alias("looped")))
    while stretch.where(F.col("up").isNotNull()).limit(1).count():
        above = stretch.select(*[F.col(c).alias(f"_{c}") for c in stretch.columns])
        rows = stretch.join(above, F.col("up") == F.col("_pk"), "left")
        looped = F.coalesce(F.col("_looped") | F.arrays_overlap("_keys", "keys"), F.lit(False))

        def longer(name: str) -> Column:
            return F.when(looped | F.col("_pk").isNull(), F.col(name)).otherwise(F.concat(f"_{name}", name)).alias(name)

        stretch = settled(rows.select(
            "pk", F.when(~looped, F.col("_up")).alias("up"), longer("keys"), longer("names"), (F.col("looped") | looped).alias("looped")))
    return stretch.where(~F.col("looped")).select("pk", "keys", "names")


def path(names: Column | str = "names") -> Column:
    return F.array_join(names, "/")


def paths(tree: DataFrame) -> DataFrame:
    """``pk, path, depth``, roots at depth 0."""
    return tree.select("pk", path().alias("path"), (F.size("keys") - 1).alias("depth"))


def below(tree: DataFrame, pk: int) -> DataFrame:
    """``pk, depth`` of a folder and all below it."""
    return tree.where(F.array_contains("keys", pk)).select("pk", (F.size("keys") - F.array_position("keys", F.lit(pk))).cast("int").alias("depth"))


def added(tree: DataFrame, pk: int, name: str, parent_pk: int | None) -> DataFrame:
    """The tree with a new folder; without a parent, or with one that is not in the tree, it is a root."""
    row = tree.sparkSession.createDataFrame([(pk, parent_pk, name)], "pk bigint, _parent bigint, _name string")
    up = tree.where(F.col("pk") == F.lit(parent_pk)).select(F.col("pk").alias("_parent"), "keys", "names")
    none = F.array()
    new = row.join(up, "_parent", "left").select(
        "pk", F.concat(F.coalesce("keys", none.cast("array<bigint>")), F.array("pk")).alias("keys"),
        F.concat(F.coalesce("names", none.cast("array<string>")), F.array("_name")).alias("names"))
    return tree.unionByName(new)


def renamed(tree: DataFrame, pk: int, name: str) -> DataFrame:
    """The tree with another name of a folder, in its own path and in those of all below it."""
    at = F.array_position("keys", F.lit(pk))
    return tree.withColumn("names", F.transform("names", lambda old, i: F.when(i + 1 == at, F.lit(name)).otherwise(old)))


def removed(tree: DataFrame, pk: int, recursive: bool = True) -> DataFrame:
    """The tree without a folder; what is below it goes as well, or its children become roots."""
    if recursive:
        return tree.where(~F.array_contains("keys", pk))
    at = F.array_position("keys", F.lit(pk)).cast("int")
    rest = tree.where(F.col("pk") != pk)
    return rest.select("pk", *[F.slice(c, at + 1, F.size("keys")).alias(c) for c in ("keys", "names")])
