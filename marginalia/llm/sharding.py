"""Shards of near-equal bytes by histogram sort.

Rows have a total order: by key, then by id, then by row number. Shard borders are sought in that order without sorting:
bytes are counted exactly below probes, all partitions adding to one histogram; the bins in which a border lies, and bins too
large for one task, get new probes of their own, until each border is known to ``TOLERANCE`` of a shard. Then the rows
are exchanged once, by bin. A bin knows how many rows of its shard come before it, so slots need no sort of a whole shard.

Equal keys lie side by side, so copies share a shard, unless a border falls within a group of more than the tolerance. A key of
any size is cut by id and row number, so no task depends on how many rows share a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import numbered, shielded, unshielded, written_small

SHARDS = 8
#: Share of a shard by which a border may be off.
TOLERANCE = 0.002
#: Bytes and rows that a bin may hold, and with it a task that sorts one.
BIN_BYTES, BIN_ROWS = 64 << 20, 1 << 20
#: Probes of the first histogram, at least, and of each bin that is cut again.
FIRST_BITS, PROBES = 12, 64
#: What rows are ordered by: the key, the halves of the id, the row number.
ORDER = ("key", "id_high", "id_low", "number")
LAW = "bytes"


def size_of(text: Column) -> Column:
    """UTF-8 bytes of a text, and one for its end; a null text has none of its own."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def _ends() -> list[Column]:
    """Bytes and rows of a bin, and its first and last value of each part of the order."""
    return [
        F.sum("bytes").alias("bytes"), F.count("*").alias("rows"),
        *[F.min(c).alias(f"min_{c}") for c in ORDER], *[F.max(c).alias(f"max_{c}") for c in ORDER],
    ]


def _placed(bins: DataFrame) -> DataFrame:
    """The bins with the bytes and rows before each. Running sums go within, then over, groups of bins of the first bits."""
    group = F.shiftright("min_key", 64 - FIRST_BITS)
    rows = bins.withColumn("group", group)
    inner = Window.partitionBy("group").orderBy(*[f"min_{c}" for c in ORDER])
    outer = Window.orderBy("group")
    sums = rows.groupBy("group").agg(F.sum("bytes").alias("all_bytes"), F.sum("rows").alias("all_rows")).select(
        "group", (F.sum("all_bytes").over(outer) - F.col("all_bytes")).alias("group_bytes"),
        (F.sum("all_rows").over(outer) - F.col("all_rows")).alias("group_rows"))
    return rows.join(sums, "group").select(
        *bins.columns,
        (F.col("group_bytes") + F.sum("bytes").over(inner) - F.col("bytes")).alias("from_byte"),
        (F.col("group_rows") + F.sum("rows").over(inner) - F.col("rows")).alias("from_row"))


def _shard_at(byte: Column, shards: int, total: int) -> Column:
    return F.floor(byte.cast("double") * shards / max(1, total)).cast("long")


def sharded(
    rows: DataFrame, size: Column, key: Column, id_col: str = "doc_id", shards: int = SHARDS, tolerance: float = TOLERANCE,
    bin_bytes: int = BIN_BYTES, bin_rows: int = BIN_ROWS,
) -> DataFrame:
    """The rows with ``shard`` (from 0), ``slot`` (its place there, gapless from 0) and ``size``.

    ``size`` is a positive long, ``key`` a long, spread like a hash of what makes rows equal. A border is off by no more than
    ``tolerance`` of a shard or by one row. Rows of a null id come first among those of their key, repeated rows
    keep any order among themselves, ids that are no whole numbers are ordered by hash. An empty table gives no rows; with fewer rows than
    shards some shards stay empty. Given columns of the names of the new ones give way to them.
    """
    inner, names = shielded(rows)
    given = F.col(f"`{id_col}`")
    whole = given.cast("long") if dict(rows.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint") else F.xxhash64(given)
    whole = F.coalesce(F.when(given.isNotNull(), whole), F.lit(-(2**63)))
    keyed = rows.select(
        "*", size.cast("long").alias("_bytes"), key.cast("long").alias("_key"),
        F.shiftright(whole, 32).alias("_high"), whole.bitwiseAND((1 << 32) - 1).alias("_low"),
    ).toDF(*inner.columns, "bytes", "key", "id_high", "id_low")
    table = numbered(keyed, "sharding", "number")
    total, n = table.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    bits = max(FIRST_BITS, min(30, (4 * max(total // bin_bytes, n // bin_rows)).bit_length()))
    slack = int(tolerance * total / shards)

    at = table.withColumn("bin", F.shiftright("key", 64 - bits))
    bins = written_small(at.groupBy("bin").agg(*_ends()), "bins")
    while True:
        placed = _placed(bins)
        last = F.col("from_byte") + F.col("bytes") - 1
        border = _shard_at(F.col("from_byte"), shards, total) != _shard_at(last, shards, total)
        large = (border & (F.col("bytes") > slack)) | (F.col("bytes") > bin_bytes) | (F.col("rows") > bin_rows)
        # The first part of the order in which the rows of a bin differ is the one to cut by.
        part, low, high = F.lit(None), F.lit(None), F.lit(None)
        for i in reversed(range(len(ORDER))):
            mixed = F.col(f"min_{ORDER[i]}") < F.col(f"max_{ORDER[i]}")
            part = F.when(mixed, F.lit(i)).otherwise(part)
            low, high = F.when(mixed, F.col(f"min_{ORDER[i]}")).otherwise(low), F.when(mixed, F.col(f"max_{ORDER[i]}")).otherwise(high)
        cuts = placed.where(large & part.isNotNull()).select(
            "bin", part.cast("int").alias("part"), low.cast("long").alias("low"),
            (F.call_function("div", high - low, F.lit(PROBES)) + 1).alias("width"))
        cuts = written_small(cuts.withColumn("cut", F.monotonically_increasing_id()), "cuts")
        if not cuts.limit(1).count():
            break
        # Bins cut anew get numbers above all earlier ones.
        base = bins.agg(F.max("bin")).first()[0] + 1
        value = F.element_at(F.array(*ORDER), F.col("part") + 1)
        finer = F.lit(base) + F.col("cut") * PROBES + F.call_function("div", value - F.col("low"), F.col("width"))
        at = at.join(cuts, "bin", "left").withColumn("bin", F.coalesce(finer, F.col("bin"))).drop("part", "low", "width", "cut")
        counted = at.where(F.col("bin") >= base).groupBy("bin").agg(*_ends())
        bins = written_small(bins.join(cuts.select("bin"), "bin", "left_anti").unionByName(counted), "bins")

    middle = F.col("from_byte") + F.floor(F.col("bytes") / 2)
    dealt = placed.select("bin", F.least(_shard_at(middle, shards, total), F.lit(shards - 1)).alias("shard"), "from_row")
    starts = dealt.groupBy("shard").agg(F.min("from_row").alias("shard_row"))
    dealt = written_small(
        dealt.join(starts, "shard").select("bin", F.col("shard").cast("int"), (F.col("from_row") - F.col("shard_row")).alias("first_slot")),
        "shards")
    place = F.row_number().over(Window.partitionBy("bin").orderBy(*ORDER)) - 1
    out = at.join(dealt, "bin").withColumn("slot", F.col("first_slot") + place)
    return unshielded(out, names, {"size": F.col("bytes"), "shard": F.col("shard"), "slot": F.col("slot")})


def shard_documents(docs: DataFrame, shards: int = SHARDS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Whole documents in shards; equal texts, null ones too, share a key, and a null text counts one byte."""
    text = F.col(f"`{text_col}`")
    return sharded(docs, size_of(text), F.xxhash64(text), id_col, shards)


def write_shards(rows: DataFrame, path: str) -> None:
    """The shards as folders ``shard=0``, ...; each task writes the bins it holds in the order of their slots."""
    rows.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
