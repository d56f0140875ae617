"""The provided tables seen as a corpus of notes, folders and change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia import schema

TRASH_SOURCE = "src19"
ORIGIN = 1704067200


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def path_key(path: Column) -> Column:
    """Folder key: 60 bits of the md5 of its path."""
    return F.conv(F.substring(F.md5(path), 1, 15), 16, 10).cast("bigint")


def title_of(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as notes; ``labels`` say which are locked (toxic) and pinned (good)."""
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels")
    path = F.concat_ws("/", "lang", "source")
    return docs.join(marks, "doc_id", "left").select(
        F.col("doc_id").alias("pk"),
        F.concat(F.lit("doc-"), F.col("doc_id").cast("string")).alias("id"),
        title_of(F.col("text")).alias("title"),
        path_key(path).alias("folder_pk"),
        F.timestamp_seconds(F.lit(ORIGIN) + F.col("doc_id") * 3600).alias("modified"),
        F.lit(False).alias("marked"),
        (F.coalesce("quality", F.lit(0)) == 1).alias("pinned"),
        (F.coalesce("toxic", F.lit(0)) == 1).alias("locked"),
        F.lit(False).alias("shared"),
        F.lit(None).cast("string").alias("zone_owner"),
        F.col("text").alias("body"),
        path.alias("folder_path"),
    )


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, title, body`` of :func:`notes`, which labels do not change unless a document has several: then texts meet them too."""
    docs = table(spark, sf_dir, "documents")
    marks = table(spark, sf_dir, "labels").select("doc_id")
    if not marks.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = docs.join(marks, "doc_id", "left")
    note = F.concat(F.lit("doc-"), F.col("doc_id").cast("string"))
    return docs.select(note.alias("id"), title_of(F.col("text")).alias("title"), F.col("text").alias("body"))


def folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels derived from ``documents``: language, then source."""
    docs = table(spark, sf_dir, "documents")
    child_path = F.concat_ws("/", "lang", "source")
    tops = docs.select("lang").distinct().select(
        path_key(F.col("lang")).alias("pk"),
        F.col("lang").alias("id"),
        F.col("lang").alias("name"),
        F.lit(None).cast("bigint").alias("parent_pk"),
        F.lit(0).alias("folder_type"),
    )
    leaves = docs.select("lang", "source").distinct().select(
        path_key(child_path).alias("pk"),
        child_path.alias("id"),
        F.col("source").alias("name"),
        path_key(F.col("lang")).alias("parent_pk"),
        F.when(F.col("source") == TRASH_SOURCE, schema.FOLDER_TYPE_TRASH).otherwise(0).alias("folder_type"),
    )
    return tops.unionByName(leaves).select(
        "*",
        F.lit(None).cast("bigint").alias("account_pk"),
        F.lit(False).alias("marked"),
        F.lit(True).alias("has_server_record"),
        F.lit(False).alias("needs_fetch"),
        F.lit(False).alias("shared"),
    )


def world_folders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Region, nation and supplier as three levels of one folder tree."""
    region, nation, supplier = (table(spark, sf_dir, n) for n in ("region", "nation", "supplier"))
    rest = "cast(0 as int) folder_type, cast(1 as bigint) account_pk, false marked"
    return (
        region.selectExpr(
            "cast(r_regionkey + 1 as bigint) pk", "concat('region-', r_regionkey) id", "r_name name",
            "cast(null as bigint) parent_pk", *rest.split(", "), "true has_server_record",
            "false needs_fetch", "false shared",
        )
        .unionByName(nation.selectExpr(
            "cast(n_nationkey + 1000 as bigint) pk", "concat('nation-', n_nationkey) id", "n_name name",
            "cast(n_regionkey + 1 as bigint) parent_pk", *rest.split(", "), "true has_server_record",
            "false needs_fetch", "false shared",
        ))
        .unionByName(supplier.selectExpr(
            "s_suppkey + 1000000 pk", "concat('supplier-', s_suppkey) id", "s_name name",
            "cast(s_nationkey + 1000 as bigint) parent_pk", *rest.split(", "), "s_acctbal >= 5000 has_server_record",
            "s_acctbal < 0 needs_fetch", "s_acctbal >= 9000 shared",
        ))
    )


def world_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as notes filed under their supplier's folder."""
    items = table(spark, sf_dir, "lineitem")
    return items.selectExpr(
        "l_orderkey * 10 + l_linenumber pk",
        "concat('line-', l_orderkey, '-', l_linenumber) id",
        "concat('Part ', l_partkey) title",
        "l_suppkey + 1000000 folder_pk",
        "l_shipdate modified",
        "l_returnflag = 'R' marked",
        "false pinned",
        "l_linestatus = 'F' locked",
        "l_discount > 0.05 shared",
        "case when l_tax > 0.04 then 'other' end zone_owner",
        "cast(null as string) body",
    )


def change_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as change log: a costly error deletes the supplier folder of that number."""
    events = table(spark, sf_dir, "events")
    return events.selectExpr(
        "15 entity",
        "user_id + 1000000 entity_pk",
        "case when event_type = 'error' and value > 40 then 2 else 1 end change_type",
    )
