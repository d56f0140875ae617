"""Pages of notes by key: a cursor holds the key of the last row, and the next page starts behind it.

Notes are listed by time, latest first, then by key. Without a layout a page is the first rows behind the cursor. With one (the notes
sorted in that order, with a table of counts by file and folder) it is read from the few files that hold it, and totals are sums of
that table; so the thousandth page reads no more than the first.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import catalog as cat
from marginalia.sources.sorted_files import ROWS_PER_FILE, read_files, write_sorted

#: Place of a note without a time: after all others.
NO_TIME = (1 << 63) - 1
COUNTS = "file string, folder_pk bigint, rows bigint, open_rows bigint"


def late() -> Column:
    """Sorts like the time of change, latest first and missing times last."""
    return F.coalesce(-F.unix_micros("modified"), F.lit(NO_TIME))


def behind(row: dict | None, *columns: str) -> Column:
    """Rows that come after ``row`` in ascending order of ``columns``; all of them without a row."""
    if row is None:
        return F.lit(True)
    after = F.lit(False)
    for name in reversed(columns):
        after = (F.col(name) > row[name]) | ((F.col(name) == row[name]) & after)
    return after


def _listable() -> Column:
    return F.col("title").isNotNull() & cat.not_marked()


def _open() -> Column:
    return ~F.coalesce(F.col("locked"), F.lit(False))


def _within(first: Column, last: Column, low: int | None, high: int | None) -> Column:
    """Whether a range of ``late`` meets the one from ``low`` to ``high``; a missing time lies outside any bound."""
    high = NO_TIME - 1 if high is None and low is not None else high
    return (F.lit(True) if low is None else last >= low) & (F.lit(True) if high is None else first <= high)


@dataclass
class Layout:
    """Notes under ``path`` in order of ``late`` and ``pk``: tables ``rows``, ``ranges`` (by file) and ``counts`` (by file and folder)."""

    spark: SparkSession
    path: str

    @classmethod
    def written(cls, notes: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> Layout:
        """Lay out all ``notes`` under ``path``, the ones that no listing shows too; ``counts`` covers titled, unmarked notes."""
        path = path.rstrip("/")
        rows = notes.withColumn("late", late())
        back = write_sorted(rows, f"{path}/rows", f"{path}/ranges", "late", "pk", rows_per_file=rows_per_file)
        counts = back.where(_listable()).groupBy(F.col("_metadata.file_name").alias("file"), "folder_pk").agg(
            F.count("*").alias("rows"), F.count_if(_open()).alias("open_rows"))
        counts.write.parquet(f"{path}/counts")
        return cls(notes.sparkSession, path)

    def __post_init__(self):
        self._rows = self.spark.read.parquet(f"{self.path}/rows")
        self._ranges = self.spark.read.parquet(f"{self.path}/ranges")
        self._counts = self.spark.read.schema(COUNTS).parquet(f"{self.path}/counts")

    @property
    def notes(self) -> DataFrame:
        return self._rows.drop("late")

    def hidden(self, edits: DataFrame) -> DataFrame:
        """Listable rows of the layout that ``edits`` replaces, each with its file. It scans keys and flags once for a table of edits."""
        slim = self._rows.where(_listable()).select(
            "pk", "late", F.col("_metadata.file_name").alias("file"), "folder_pk", F.lit(1).cast("bigint").alias("rows"),
            _open().cast("bigint").alias("open_rows"))
        return slim.join(edits.select("pk"), "pk", "left_semi")

    def _in_files(self, homes: DataFrame, hidden: DataFrame | None, open_only: bool, low: int | None, high: int | None) -> DataFrame:
        """``file, first, last, n`` of the files that hold notes in ``homes``; ``n`` does not yet look at the bounds within a file."""
        counts = self._counts
        if hidden is not None:
            counts = counts.unionByName(hidden.select("file", "folder_pk", (-F.col("rows")).alias("rows"), (-F.col("open_rows")).alias("open_rows")))
        own = counts.join(homes.withColumnRenamed("pk", "folder_pk"), "folder_pk", "left_semi")
        sums = own.groupBy("file").agg(F.sum("open_rows" if open_only else "rows").alias("n")).where("n > 0")
        ranges = self._ranges.where(_within(F.col("first.late"), F.col("last.late"), low, high))
        return sums.join(ranges.select("file", "first", "last"), "file")

    def _shown(self, files: list[str], homes: DataFrame, edits: DataFrame | None, open_only: bool, low: int | None, high: int | None) -> DataFrame:
        """Notes of some files and of the edits that a listing shows."""
        rows = read_files(self.spark, f"{self.path}/rows", files, self._rows.schema)
        if edits is not None:
            new = edits.withColumn("late", late())
            rows = rows.join(edits.select("pk"), "pk", "left_anti").select(*new.columns).unionByName(new)
        rows = rows.where(_listable() & _within(F.col("late"), F.col("late"), low, high))
        rows = rows.where(_open()) if open_only else rows
        return rows.join(homes.withColumnRenamed("pk", "folder_pk"), "folder_pk", "left_semi")

    def page_files(
        self, homes: DataFrame, wanted: int, after: dict | None = None, hidden: DataFrame | None = None, open_only: bool = False,
        low: int | None = None, high: int | None = None,
    ) -> list[str]:
        """The files that hold the ``wanted`` rows behind ``after``, by the counts.

        Every file named by the counts holds a row, so at most ``wanted`` files and the two cut by the cursor and a bound come to the driver.
        """
        rows = self._in_files(homes, hidden, open_only, low, high)
        if after is not None:
            rows = rows.where(F.col("last") > F.struct(F.lit(after["late"]).alias("late"), F.lit(after["pk"]).alias("pk")))
        files, sure = [], 0
        for r in rows.orderBy("first").limit(wanted + 2).collect():
            if sure >= wanted:
                break
            files.append(r["file"])
            # Of a file that the cursor or a bound cuts, any number of rows may be left.
            cut = (after is not None and tuple(r["first"]) <= (after["late"], after["pk"])) or (low is not None and r["first"]["late"] < low)
            sure += 0 if cut else r["n"]
        return files

    def page(
        self, homes: DataFrame, limit: int, after: dict | None = None, edits: DataFrame | None = None, hidden: DataFrame | None = None,
        open_only: bool = False, low: int | None = None, high: int | None = None,
    ) -> DataFrame:
        """The ``limit`` notes behind ``after`` (``late, pk``) in the folders ``homes``, and one more to tell whether others follow.

        ``edits`` are notes in place of those of the layout, ``hidden`` what :meth:`hidden` makes of them. ``low`` and ``high`` bound ``late``.
        """
        files = self.page_files(homes, limit + 1, after, hidden, open_only, low, high)
        rows = self._shown(files, homes, edits, open_only, low, high).where(behind(after, "late", "pk"))
        return rows.orderBy("late", "pk").limit(limit + 1)

    def total(
        self, homes: DataFrame, edits: DataFrame | None = None, hidden: DataFrame | None = None, low: int | None = None, high: int | None = None
    ) -> int:
        """Number of notes that the listing shows: a sum of counts; only files that a bound cuts, two at most, are read."""
        rows = self._in_files(homes, hidden, False, low, high)
        first, last = F.col("first.late"), F.col("last.late")
        high = NO_TIME - 1 if high is None and low is not None else high
        cut = (F.lit(False) if low is None else first < low) | (F.lit(False) if high is None else last > high)
        whole = rows.where(~cut).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
        read = [] if low is None and high is None else [r["file"] for r in rows.where(cut).select("file").collect()]
        return whole + (self._shown(read, homes, edits, False, low, high).count() if read or edits is not None else 0)
