"""Immutable versions of a table and the catalog that lists them."""

from __future__ import annotations

import os
import uuid
from urllib.parse import unquote, urlparse

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


CATALOG = "name string, base string, version int, path string, n_rows bigint, n_columns int, created_at timestamp"


def base_of(name: Column) -> Column:
    """The name without its version suffix."""
    return F.regexp_replace(name, r"_v\d+$", "")


def next_versions(catalog: DataFrame) -> DataFrame:
    """(base, next_version): the first free number from 2 up, for every base name.

    `catalog` has a `name` column. A base with m names has a free number of at most m + 2, so
    the candidates stay as few as the names.
    """
    named = catalog.select(base_of(F.col("name")).alias("base"), F.regexp_extract("name", r"_v(\d+)$", 1).alias("digits"))
    taken = named.select("base", F.col("digits").try_cast("int").alias("version")).where("version IS NOT NULL").distinct()
    candidates = named.groupBy("base").agg(F.count(F.lit(1)).alias("n")).select(
        "base", F.explode(F.sequence(F.lit(2), (F.col("n") + 2).cast("int"))).alias("version")
    )
    return candidates.join(taken, ["base", "version"], "left_anti").groupBy("base").agg(F.min("version").alias("next_version"))


class TableStore:
    """Parquet versions under one root; the catalog row is written last and names the version's folder.

    Every write has a folder of its own. A version without a catalog row was never finished: it is not
    listed and in nobody's way. A number is taken by creating its marker file, which only one of several
    writers can do; the others go on to the next number. A writer that fails gives its number back; that of
    a driver that was lost stays taken. Stores without a create that fails on existing files (some object stores) need one writer at a time.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    @property
    def _catalog_path(self) -> str:
        return f"{self.root}/_catalog"

    def _at(self, path: str):
        """The path and its file system."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return hadoop, hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def catalog(self) -> DataFrame:
        hadoop, files = self._at(self._catalog_path)
        if not files.exists(hadoop):
            return self.spark.createDataFrame([], CATALOG)
        return self._listed(self._catalog_path)

    def _listed(self, *paths: str) -> DataFrame:
        # while the catalog is compacted a row may be there twice
        return self.spark.read.schema(CATALOG).option("recursiveFileLookup", "true").parquet(*paths).distinct()

    def _list(self, rows: DataFrame) -> None:
        """Each entry has a folder of its own, as writers that append to one folder disturb each other."""
        rows.coalesce(1).write.parquet(f"{self._catalog_path}/entry-{uuid.uuid4().hex}")

    def compact_catalog(self) -> int:
        """Put the catalog's entries, one for each version, into one; returns how many entries that replaced.

        The new entry is there before the old ones go, and rows that are listed twice count once, so a version is
        listed all along; entries that others add meanwhile are left alone.
        """
        hadoop, files = self._at(self._catalog_path)
        if not files.exists(hadoop):
            return 0

        def finished(entry) -> bool:
            inside = files.listStatus(entry.getPath())
            return any(f.getPath().getName().endswith(".parquet") for f in inside)

        old = [str(f.getPath()) for f in files.listStatus(hadoop) if f.getPath().getName()[0] not in "._" and finished(f)]
        if len(old) < 2:
            return 0
        self._list(self._listed(*old))
        for path in old:
            files.delete(self._at(path)[0], True)
        return len(old)

    def _marker(self, name: str) -> str:
        return f"{self.root}/_taken/{name}"

    def _take(self, name: str) -> bool:
        """Whether this writer got the name; of several that ask at once one does."""
        marker, files = self._at(self._marker(name))
        files.mkdirs(marker.getParent())
        qualified = urlparse(str(files.makeQualified(marker).toUri()))
        if qualified.scheme == "file":
            # Hadoop's local file system looks and then creates, which two writers can do at once
            try:
                os.close(os.open(unquote(qualified.path), os.O_CREAT | os.O_EXCL))
            except FileExistsError:
                return False
            return True
        try:
            files.create(marker, False).close()
        except Py4JJavaError as error:
            if "AlreadyExists" in error.java_exception.getClass().getName() or files.exists(marker):
                return False
            raise
        return True

    def _give_back(self, name: str) -> None:
        marker, files = self._at(self._marker(name))
        files.delete(marker, False)

    def _record(self, name: str, version: int, path: str, df: DataFrame) -> None:
        stored = self.spark.read.parquet(path)
        row = self.spark.createDataFrame(
            [(name, name if version == 1 else name.rsplit("_v", 1)[0], version, path, stored.count(), len(df.columns))],
            "name string, base string, version int, path string, n_rows bigint, n_columns int",
        )
        self._list(row.withColumn("created_at", F.current_timestamp()))

    def _folder(self, base: str, version: int) -> str:
        return f"{self.root}/{base}/version-{version}-{uuid.uuid4().hex}"

    def _write(self, name: str, base: str, version: int, df: DataFrame) -> str:
        """Write a table whose name is taken; a failure gives the name back."""
        path = self._folder(base, version)
        try:
            df.write.mode("errorifexists").parquet(path)
            self._record(name, version, path, df)
        except BaseException:
            self._give_back(name)
            raise
        return name

    def _known(self, name: str) -> bool:
        return not self.catalog().where(F.col("name") == name).isEmpty()

    def add(self, name: str, df: DataFrame) -> str:
        """Store a new table under its own name."""
        if self._known(name) or not self._take(name):
            raise FileExistsError(f"A table named {name!r} is stored already.")
        return self._write(name, name, 1, df)

    def add_version(self, source: str, df: DataFrame) -> str:
        """Store a derived table under the first free version name; returns that name."""
        names = self.catalog().select("name").union(self.spark.createDataFrame([(source,)], "name string")).distinct()
        free = next_versions(names).where(F.col("base") == F.regexp_replace(F.lit(source), r"_v\d+$", "")).first()
        base, version = free["base"], free["next_version"]
        while not self._take(f"{base}_v{version}") or self._known(f"{base}_v{version}"):
            version += 1
        return self._write(f"{base}_v{version}", base, version, df)

    def load(self, name: str) -> DataFrame:
        found = self.catalog().where(F.col("name") == name).select("path").first()
        if found is None:
            raise FileNotFoundError(f"No stored table named {name!r}.")
        return self.spark.read.parquet(found["path"])

    def versions(self) -> DataFrame:
        return newest_first(self.catalog())


def newest_first(catalog: DataFrame) -> DataFrame:
    return catalog.orderBy(F.desc("created_at"), F.desc("name"))
