"""Tables in buckets, written in versions: a change rewrites the buckets that it touches, and a manifest is written last.

A folder holds ``<table>/written=<version>/bucket=<n>`` and ``manifest/version=<version>``, one small file that names for each
table and bucket the version in which it was last written. A reader takes the newest manifest; what a broken run left behind is
named by none and is overwritten by the next one. ``vacuum`` removes what no manifest in use names.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "of string, bucket int, written int, version int"


def bucket_of(key: Column, n: int) -> Column:
    """Bucket of a text key: the first 15 hex digits of its MD5, modulo ``n``."""
    return (F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long") % n).cast("int")


class Store:
    """``schemas`` gives each table's columns as DDL, without ``bucket``. ``n_buckets`` is fixed when a folder is first written."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], n_buckets: int):
        self.spark, self.folder, self.schemas, self.n_buckets = spark, folder.rstrip("/"), schemas, n_buckets
        self._pinned: tuple[int, dict[str, dict[int, int]]] | None = None

    def manifests(self) -> DataFrame:
        """One row per version and bucket."""
        try:
            return self.spark.read.schema(MANIFEST).parquet(f"{self.folder}/manifest")
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            return self.spark.createDataFrame([], MANIFEST)

    def versions(self) -> tuple[int, dict[str, dict[int, int]]]:
        """The newest version (0: none), and of each table the version of each bucket: as many numbers as there are buckets.

        What was found first stays for this reader, so that all its tables are of one version; ``refresh`` looks again.
        """
        if self._pinned is None:
            rows = self.manifests()
            newest = rows.where(F.col("version") == rows.agg(F.max("version")).first()[0]).collect()
            written: dict[str, dict[int, int]] = {}
            for r in newest:
                written.setdefault(r.of, {})[r.bucket] = r.written
            self._pinned = (newest[0].version if newest else 0), written
        return self._pinned

    def refresh(self) -> None:
        self._pinned = None

    def read(self, table: str, only: list[int] | None = None) -> DataFrame:
        """The current rows, with their ``bucket``; ``only`` names the buckets to be read. Other folders are pruned by their names."""
        _, written = self.versions()
        by_version: dict[int, list[int]] = {}
        for bucket, version in written.get(table, {}).items():
            if only is None or bucket in only:
                by_version.setdefault(version, []).append(bucket)
        schema = f"{self.schemas[table]}, bucket int, written int"
        if not by_version:
            return self.spark.createDataFrame([], schema).drop("written")
        base = f"{self.folder}/{table}"
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/written={v}" for v in sorted(by_version)])
        current = [(F.col("written") == v) & F.col("bucket").isin(sorted(b)) for v, b in sorted(by_version.items())]
        return rows.where(reduce(or_, current)).drop("written")

    def write(self, table: str, rows: DataFrame, version: int) -> DataFrame:
        """Rows with their ``bucket`` as part of a version to come; gives them back as they were written."""
        to = f"{self.folder}/{table}/written={version}"
        # with a writer for each bucket a task need not sort its rows, and holds none of them
        key, conf = "spark.sql.maxConcurrentOutputFileWriters", self.spark.conf
        before = conf.get(key)
        conf.set(key, str(max(int(before), self.n_buckets)))
        try:
            rows.write.mode("overwrite").partitionBy("bucket").parquet(to)
        finally:
            conf.set(key, before)
        return self.spark.read.schema(f"{self.schemas[table]}, bucket int").parquet(to)

    def commit(self, version: int, touched: dict[str, list[int]]) -> None:
        """From now on the touched buckets of each table are those of ``version``; all others stay."""
        self.refresh()
        _, written = self.versions()
        now = {t: {**written.get(t, {}), **dict.fromkeys(touched.get(t, []), version)} for t in {*written, *touched}}
        rows = [(t, b, v) for t, buckets in now.items() for b, v in buckets.items()]
        made = self.spark.createDataFrame(rows, "of string, bucket int, written int").coalesce(1)
        made.write.mode("overwrite").parquet(f"{self.folder}/manifest/version={version}")
        self.refresh()

    def vacuum(self, keep: int = 1) -> int:
        """Remove the folders that none of the newest ``keep`` manifests names, and the older manifests; gives back how many folders went."""
        rows = self.manifests()
        kept = [r.version for r in rows.select("version").distinct().orderBy(F.desc("version")).limit(keep).collect()]
        named = {(r.of, r.written) for r in rows.where(F.col("version").isin(kept)).select("of", "written").distinct().collect()}
        gone = [("manifest", f"version={r.version}") for r in rows.where(~F.col("version").isin(kept)).select("version").distinct().collect()]
        # versions that were written, named or not
        newest = max(kept, default=0) + 1
        gone += [(t, f"written={v}") for t in self.schemas for v in range(1, newest + 1) if (t, v) not in named]
        jvm = self.spark._jvm
        done = 0
        for table, part in gone:
            path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{table}/{part}")
            done += path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.refresh()
        return done
