"""Full refresh of a written table (B18): write a new version, then point to it.

The rows of a refresh are a folder of their own, and one small step makes it current: a
marker file, the location of a catalog table, or the commit of a table format. Before that
step readers see the old rows, after it the new ones, wherever a driver is killed; what a
killed refresh has left is removed by the next. Nothing is moved, so object stores are fine.

Old versions go last, all but ``keep`` of them, for readers that have begun on one. One
refresh of a table runs at a time.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Formats whose tables replace their rows in one commit of their own.
ONE_COMMIT = ("delta", "iceberg")


class _Files:
    """File-system calls through Spark's Hadoop configuration."""

    def __init__(self, spark: SparkSession, root: str):
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        """What lies in a folder, hidden files left out; nothing if there is no such folder."""
        if not self._fs.exists(self._path(folder)):
            return []
        found = (status.getPath().getName() for status in self._fs.listStatus(self._path(folder)))
        return sorted(name for name in found if not name.startswith("."))

    def create(self, path: str) -> None:
        """An empty file; an error if there is one already."""
        self._fs.create(self._path(path), False).close()

    def remove(self, path: str) -> None:
        self._fs.delete(self._path(path), True)

    def qualified(self, path: str) -> str:
        """The path with its file system, as catalogs give it."""
        return self._fs.makeQualified(self._path(path)).toString()


class _Versions:
    """The versions of one table, folders whose names sort by age."""

    MARKERS = "_current"

    def __init__(self, spark: SparkSession, folder: str):
        self.folder = folder
        self.files = _Files(spark, folder)

    def path(self, version: str) -> str:
        return f"{self.folder}/{version}"

    def written(self) -> list[str]:
        """All versions there are, those of killed refreshes too."""
        return [name for name in self.files.names(self.folder) if name.startswith("v") and name[1:11].isdigit()]

    def new(self) -> str:
        """A name after all that were ever begun, so that no folder is written twice."""
        last = max((int(name[1:11]) for name in self.written() + self.marked()), default=0)
        return f"v{last + 1:010d}-{uuid4().hex[:8]}"

    def marked(self) -> list[str]:
        return self.files.names(f"{self.folder}/{self.MARKERS}")

    def mark(self, version: str) -> None:
        self.files.create(f"{self.folder}/{self.MARKERS}/{version}")

    def clean(self, current: str, complete: list[str], keep: int) -> None:
        """Removes what is older than ``current``, but for the ``keep`` newest complete ones."""
        older = sorted(name for name in complete if name < current)
        kept = set(older[len(older) - keep :] if keep else [])
        for name in self.written():
            if name < current and name not in kept:
                self.files.remove(self.path(name))
        for name in self.marked():
            if name < current and name not in kept:
                self.files.remove(f"{self.folder}/{self.MARKERS}/{name}")


class FolderSink:
    """Tables as folders below one root, on any file system Spark can reach.

    A table's folder holds its versions, and a marker for each complete one; the newest
    marker is the pointer. ``path`` is the folder to read, for readers without this class.
    Files that lie in a table's folder itself, from another writer, are the table until its
    first refresh.
    """

    def __init__(self, spark: SparkSession, root: str, file_format: str = "parquet", keep: int = 1):
        self.spark = spark
        self.root = root.rstrip("/")
        self.file_format = file_format
        self.keep = keep

    def versions(self, table: str) -> _Versions:
        return _Versions(self.spark, f"{self.root}/{table}")

    def path(self, table: str) -> str:
        marked = self.versions(table).marked()
        return f"{self.root}/{table}/{marked[-1]}" if marked else f"{self.root}/{table}"

    def read(self, table: str) -> DataFrame:
        return self.spark.read.format(self.file_format).load(self.path(table))

    def refresh(self, table: str, rows: DataFrame) -> DataFrame:
        versions = self.versions(table)
        new = versions.new()
        try:
            rows.write.format(self.file_format).save(versions.path(new))
        except BaseException:
            versions.files.remove(versions.path(new))
            raise
        versions.mark(new)
        versions.clean(new, versions.marked(), self.keep)
        known = {*versions.written(), versions.MARKERS}
        for name in versions.files.names(versions.folder):
            if name not in known:
                versions.files.remove(versions.path(name))
        return self.read(table)

    def remove(self) -> None:
        """Delete the folder with all its tables."""
        _Files(self.spark, self.root).remove(self.root)


class CatalogSink:
    """Tables of one database, optionally with a prefix before each name.

    A table of files stays the same table, with its grants, properties and comments: a refresh writes
    the next version beside the last and sets the table's location. So its columns must stay
    the same too; to change them, drop or alter the table. Tables of :data:`ONE_COMMIT` formats
    replace their rows themselves. ``root`` is where the versions lie, the database's folder
    if it is not given.
    """

    def __init__(
        self,
        spark: SparkSession,
        database: str,
        prefix: str = "",
        file_format: str = "parquet",
        root: str | None = None,
        keep: int = 1,
    ):
        self.spark = spark
        self.database = database
        self.prefix = prefix
        self.file_format = file_format
        self.root = root.rstrip("/") if root else None
        self.keep = keep

    def name(self, table: str) -> str:
        return f"`{self.database}`.`{self.prefix}{table}`"

    def versions(self, table: str) -> _Versions:
        root = self.root or self.spark.catalog.getDatabase(self.database).locationUri.rstrip("/")
        return _Versions(self.spark, f"{root}/_versions/{self.prefix}{table}")

    def read(self, table: str) -> DataFrame:
        return self.spark.table(self.name(table))

    def exists(self, table: str) -> bool:
        return self.spark.catalog.tableExists(self.name(table))

    def location(self, table: str) -> str:
        described = self.spark.sql(f"DESCRIBE TABLE EXTENDED {self.name(table)}")
        return described.filter("col_name = 'Location'").first()["data_type"].rstrip("/")

    def refresh(self, table: str, rows: DataFrame) -> DataFrame:
        if self.file_format in ONE_COMMIT:
            writer = rows.writeTo(self.name(table))
            if self.exists(table):
                writer.overwrite(F.lit(True))
            else:
                writer.using(self.file_format).create()
            return self.read(table)
        old = self.location(table) if self.exists(table) else None
        if old:
            self._check_columns(table, rows)
        versions = self.versions(table)
        new = versions.new()
        try:
            rows.write.format(self.file_format).save(versions.path(new))
            self.point(table, versions.path(new), rows, create=not old)
        except BaseException:
            # The catalog may have the new location and its answer be lost.
            if not (self.exists(table) and self.location(table).endswith(f"/{new}")):
                versions.files.remove(versions.path(new))
            raise
        last = old.rsplit("/", 1)[-1] if old and self._is_version(versions, old) else None
        versions.clean(new, [last] if last else [], self.keep)
        if old and not last and not self.keep:
            versions.files.remove(old)
        return self.read(table)

    def point(self, table: str, folder: str, rows: DataFrame, create: bool) -> None:
        """The step that makes a version current, one call to the catalog."""
        if create:
            self.spark.catalog.createTable(self.name(table), folder, self.file_format, rows.schema)
        else:
            path = folder.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(f"ALTER TABLE {self.name(table)} SET LOCATION '{path}'")
            self.spark.catalog.refreshTable(self.name(table))

    @staticmethod
    def _is_version(versions: _Versions, location: str) -> bool:
        return location.rsplit("/", 1)[0] == versions.files.qualified(versions.folder).rstrip("/")

    def _check_columns(self, table: str, rows: DataFrame) -> None:
        def kinds(df: DataFrame) -> dict[str, str]:
            return {f.name.lower(): f.dataType.simpleString() for f in df.schema.fields}

        there, given = kinds(self.read(table)), kinds(rows)
        if there != given:
            raise ValueError(f"{self.name(table)} has the columns {there}, not {given}")
