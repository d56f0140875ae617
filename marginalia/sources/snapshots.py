"""Versioned tables in segments: a pass writes a new folder, then one manifest file makes it current.

A version is a list of segments, oldest first. Each segment holds the rows of what changed in its pass and a table ``replaced`` of the
keys whose earlier rows no longer count, so a pass writes as much as changed. Readers take all segments together; :meth:`merged`
leaves out what a later segment has replaced.
"""

from __future__ import annotations

import json
import time
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.sources.sorted_files import ROWS_PER_FILE, holding, read_files, write_sorted

#: What the table of file ranges is called, after the name of its table.
RANGES = "_ranges"
MANIFEST = "version bigint, created_at bigint, folder string, segments array<string>"
REPLACED = "id string, part string"


class PassOvertaken(RuntimeError):
    """Another pass has published since this one began; its tables stay, this one's are not used."""


class Snapshots:
    """Parquet tables under ``root/<folder of a segment>``; readers see the last version in the manifest.

    Every pass writes to a folder with a name of its own, so that nothing is ever overwritten: neither what is being read nor
    what another writer makes. A pass that dies leaves no manifest file, so its folder is ignored.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._begun: dict[int, str] = {}

    def _manifest(self) -> DataFrame | None:
        """All versions. Only a missing manifest means that there is none."""
        try:
            return self.spark.read.schema(MANIFEST).option("mode", "FAILFAST").json(f"{self.root}/manifest")
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def _entry(self, version: int | None = None):
        rows = self._manifest()
        if rows is None:
            return None
        if version is not None:
            rows = rows.where(F.col("version") == version)
        row = rows.agg(F.max_by(F.struct(*rows.columns), "version").alias("last")).first()[0]
        if row is None or row["version"] is None:
            raise ValueError(f"the manifest under {self.root} holds no {'version' if version is None else f'version {version}'}")
        return row

    def current(self) -> int | None:
        last = self._entry()
        return last["version"] if last else None

    def begin(self) -> int:
        """Number of a new version, with a folder that nobody else writes to."""
        version = (self.current() or 0) + 1
        self._begun[version] = f"v={version}-{uuid.uuid4().hex[:12]}"
        return version

    def segments(self, version: int | None = None) -> list[str]:
        """Folders of a version's segments, oldest first; none before the first pass."""
        entry = self._entry(version)
        return [] if entry is None else entry["segments"] or [entry["folder"]]

    def _folder(self, version: int) -> str:
        return self._begun[version] if version in self._begun else self._entry(version)["folder"]

    def path(self, version: int, table: str) -> str:
        return f"{self.root}/{self._folder(version)}/{table}"

    def _parquet(self, folder: str, table: str, schema: str | None) -> DataFrame:
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        return reader.parquet(f"{self.root}/{folder}/{table}")

    def read(self, table: str, schema: str | None = None, version: int | None = None) -> DataFrame:
        """Table of a version's own segment, of the current one by default; empty before the first pass."""
        version = self.current() if version is None else version
        if version is None:
            if schema is None:
                raise ValueError(f"no version of {table!r} has been published under {self.root}")
            return self.spark.createDataFrame([], schema)
        return self._parquet(self._folder(version), table, schema)

    def each(self, table: str, schema: str, version: int | None = None, number: str = "_at") -> DataFrame:
        """Table of all segments of a version, with the ``number`` of the segment."""
        rows = self.spark.createDataFrame([], schema).withColumn(number, F.lit(0))
        for i, folder in enumerate(self.segments(version)):
            own = self._parquet(folder, table, schema).withColumn(number, F.lit(i))
            rows = rows.unionByName(own) if i else own
        return rows

    def merged(
        self, table: str, key: str, part: str, schema: str, version: int | None = None, number: str | None = None
    ) -> DataFrame:
        """Table of all segments of a version, without rows whose ``key`` a later segment has replaced in ``part``."""
        rows, folders, at = self.each(table, schema, version, number or "_at"), self.segments(version), number or "_at"
        gone = None
        for i, folder in enumerate(folders):
            if i:
                keys = self._parquet(folder, "replaced", REPLACED).where(F.col("part") == part).select(F.col("id").alias("_gone"), F.lit(i).alias("_since"))
                gone = keys if gone is None else gone.unionByName(keys)
        if gone is not None:
            rows = rows.join(gone, (F.col(key) == F.col("_gone")) & (F.col(at) < F.col("_since")), "left_anti")
        return rows if number else rows.drop("_at")

    def write_sorted(self, rows: DataFrame, version: int, table: str, key: str, rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
        """Write one table in order of ``key``, with the range of each file, so that :meth:`few` finds rows without a scan."""
        path = self.path(version, table)
        return write_sorted(rows, path, f"{path}{RANGES}", key, rows_per_file=rows_per_file)

    def few(
        self, table: str, key: str, part: str, schema: str, at: str, wanted: dict[str, list], version: int | None = None
    ) -> DataFrame:
        """What :meth:`merged` holds for the keys ``wanted[at]`` of a table sorted by ``at``, from the files whose range takes them in.

        ``wanted`` gives keys of other columns, too, where they are known: with those of ``key``, only their replacements are looked up.
        """
        rows, gone = self.spark.createDataFrame([], schema).withColumn("_at", F.lit(0)), None
        for i, folder in enumerate(self.segments(version)):
            own = self._holding(folder, table, schema, at, wanted[at]).where(F.col(at).isin(wanted[at])).withColumn("_at", F.lit(i))
            rows = rows.unionByName(own)
            if i:
                keys = self._parquet(folder, "replaced", REPLACED).where(F.col("part") == part)
                if key in wanted:
                    keys = keys.where(F.col("id").isin(wanted[key]))
                keys = keys.select(F.col("id").alias("_gone"), F.lit(i).alias("_since"))
                gone = keys if gone is None else gone.unionByName(keys)
        if gone is not None:
            rows = rows.join(gone, (F.col(key) == F.col("_gone")) & (F.col("_at") < F.col("_since")), "left_anti")
        return rows.drop("_at")

    def files_of(self, folder: str, table: str, key: str, values: list) -> list[str] | None:
        """Files of a segment's table that may hold ``values``; nothing is known of tables that were not written in order."""
        try:
            ranges = self.spark.read.parquet(f"{self.root}/{folder}/{table}{RANGES}")
        except AnalysisException as exc:
            if exc.getCondition() == "PATH_NOT_FOUND":
                return None
            raise
        return holding(ranges, key, values)

    def _holding(self, folder: str, table: str, schema: str, key: str, values: list) -> DataFrame:
        files = self.files_of(folder, table, key, values)
        if files is None:
            return self._parquet(folder, table, schema)
        return read_files(self.spark, f"{self.root}/{folder}/{table}", files, schema)

    def write(self, rows: DataFrame, version: int, table: str) -> DataFrame:
        """Write one table of a version that was begun here and read it back."""
        rows.write.parquet(self.path(version, table))
        return self.spark.read.schema(rows.schema).parquet(self.path(version, table))

    def publish(self, version: int, before: list[str] | None = None) -> None:
        """Make a version current: the segments of ``before``, then its own.

        Its manifest file is named after the version and created only if there is none, so that of two passes one is told.
        """
        folder = self._begun[version]
        line = json.dumps({"version": version, "created_at": int(time.time() * 1000), "folder": folder, "segments": [*(before or []), folder]})
        if (self.current() or 0) >= version or not self._created(f"{self.root}/manifest/{version:012d}.json", line):
            raise PassOvertaken(f"version {version} has been published by another pass")

    def _created(self, path: str, line: str) -> bool:
        """Write a file that must not exist; false if it does. The pass that finds its own line there has won."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        target = jvm.org.apache.hadoop.fs.Path(path)
        files = target.getFileSystem(conf)
        # A file in full under a name of its own first: what readers see is never half a line.
        draft = jvm.org.apache.hadoop.fs.Path(f"{self.root}/.drafts/{uuid.uuid4().hex}")
        out = files.create(draft, False)
        out.write(bytearray(line.encode()))
        out.close()
        files.mkdirs(target.getParent())
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri() if target.toUri().getScheme() else files.getUri(), conf)
        none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(files.makeQualified(draft), files.makeQualified(target), none)
            return True
        except Exception as exc:
            files.delete(draft, False)
            if files.exists(target):
                return False
            raise exc
