"""An index of files: contents kept once, many paths to a content, roots with scopes of their own, updated by what changed.

``index`` walks roots that it is given and adds what is new or changed; it never drops a path. ``reindex`` walks the recorded
roots again, each with the scope that it was given first, and drops the paths that have vanished. Either way a content goes, with its
chunks, postings and vectors, when no path leads to it any more. Only the buckets with a difference are written again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.operators.retrieval import chunk, root_scopes, with_sha
from tallyloom.operators.searchindex import SCHEMAS, SearchIndex, few
from tallyloom.operators.store import bucket_of
from tallyloom.session import cut_lineage

MORE = {
    "contents": "sha256 string, scope string, mtime long, n_chunks int",
    "locations": "path string, sha256 string, mtime long, root string",
    "roots": "root string, scope string",
}
#: New contents with their paths, and names of contents that go, that are sent to where the texts lie; were they more, the texts would be dealt out
FEW_NEW, FEW_GONE = 1 << 19, 1 << 20


class ContentIndex(SearchIndex):
    """Files in one folder. ``size`` and ``overlap`` are those of the chunks, in words."""

    def __init__(self, spark: SparkSession, folder: str, n_buckets: int = 16, size: int = 200, overlap: int = 20):
        super().__init__(spark, folder, n_buckets, MORE)
        self.size, self.overlap = size, overlap

    def contents(self) -> DataFrame:
        """Each content with its scope, its number of chunks and of paths, and the least path."""
        paths = self.store.read("locations").groupBy("sha256").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n_paths"))
        return self.store.read("contents").drop("bucket").join(paths, "sha256")

    def index(self, files: DataFrame, roots: DataFrame) -> DataFrame:
        """Add what is below ``roots`` (root, scope) of files (path, content, mtime). Gives (path, status): new, changed, unchanged."""
        known = self.store.read("roots").select("root", "scope")
        every = known.unionByName(roots.select("root", "scope").join(known, "root", "left_anti"))
        return self._update(files, roots, every, drop=False)

    def reindex(self, files: DataFrame) -> DataFrame:
        """Compare the recorded roots with files (path, content, mtime) that are there now. Gives (path, status), dropped ones too."""
        known = self.store.read("roots").select("root", "scope")
        return self._update(files, known, known, drop=True)

    def _update(self, files: DataFrame, walked: DataFrame, roots: DataFrame, drop: bool) -> DataFrame:
        store = self.store
        store.refresh()
        n, version = store.n_buckets, store.versions()[0] + 1
        old = store.read("locations").select("path", "sha256", "mtime", "root")
        below = root_scopes(files.select("path"), walked).where("root IS NOT NULL")
        texts = with_sha(files.select("path", "content", "mtime")).join(below, "path")
        # the walk without its texts is read several times
        now = cut_lineage(texts.select("path", "sha256", "mtime", "root", "scope"))
        was = old.select("path", F.col("sha256").alias("was"), F.col("mtime").alias("old_mtime"), F.col("root").alias("old_root"))
        status = F.when(F.col("sha256").isNull(), "dropped" if drop else "kept").when(F.col("was").isNull(), "new").when(F.col("sha256") == F.col("was"), "unchanged").otherwise("changed")
        both = cut_lineage(now.join(was, "path", "full_outer").withColumn("status", status).withColumn("bucket", bucket_of(F.col("path"), n)))
        kept = both.where("status <> 'dropped'").select(
            "bucket", "path", F.coalesce("sha256", "was").alias("sha256"), F.when(F.col("status") == "changed", F.col("mtime")).otherwise(F.coalesce("old_mtime", "mtime")).alias("mtime"), F.coalesce("old_root", "root").alias("root"))
        paths = numbers(both.where("status IN ('new', 'changed', 'dropped')"))
        store.write("locations", within(kept, paths).repartition(n, "bucket"), version)

        wanted = kept.select("sha256").distinct()
        have = store.read("contents")
        added = wanted.join(have, "sha256", "left_anti").select("sha256", bucket_of(F.col("sha256"), n).alias("bucket"))
        gone = cut_lineage(have.join(wanted, "sha256", "left_anti").select("sha256", "bucket"))
        added = cut_lineage(added)
        touched = sorted({*numbers(added), *numbers(gone)})
        # one path stands for a content that is new: the least one
        first = few(now.join(added, "sha256").groupBy("sha256").agg(F.min(F.struct("path", "scope", "mtime")).alias("f")).select("sha256", "f.*"), FEW_NEW)
        fresh = files.select("path", "content").join(first, "path")
        pieces = chunk(fresh.select("sha256", "scope", "content"), self.size, self.overlap)
        made = pieces.select(
            F.col("sha256").alias("unit"), "pos", F.conv(F.substring(F.md5(F.concat_ws("/", "sha256", "pos").cast("binary")), 1, 15), 16, 10).cast("long").alias("chunk_id"),
            "chunk_text", F.lit(None).cast("array<double>").alias("vec"), "scope", F.lit(None).cast("string").alias("path"))
        names = few(gone.select(F.unhex("sha256").alias("name")), FEW_GONE)
        there = store.read("chunks", touched).join(names, F.unhex("unit") == F.col("name"), "left_anti").select(*made.columns)
        self.write_buckets(there.unionByName(made), version)
        stay = have.where(F.col("bucket").isin(touched)).join(gone.select("sha256"), "sha256", "left_anti").select("sha256", "scope", "mtime", "n_chunks", "bucket")
        counts = store.spark.read.schema(f"{SCHEMAS['chunks']}, bucket int").parquet(f"{store.folder}/chunks/written={version}").groupBy(F.col("unit").alias("sha256")).agg(F.count(F.lit(1)).cast("int").alias("n_chunks"))
        new = first.join(counts, "sha256", "left").select("sha256", "scope", "mtime", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), bucket_of(F.col("sha256"), n).alias("bucket"))
        store.write("contents", stay.unionByName(new).repartition(n, "bucket"), version)
        store.write("roots", roots.select("root", "scope", F.lit(0).alias("bucket")).coalesce(1), version)
        store.commit(version, dict.fromkeys([*SCHEMAS, "contents"], touched) | {"locations": paths, "roots": [0]})
        return both.where("status <> 'kept'").select("path", "status")


def numbers(rows: DataFrame) -> list[int]:
    """The buckets of rows: at most as many as there are buckets."""
    return sorted(r.bucket for r in rows.select("bucket").distinct().collect())


def within(rows: DataFrame, buckets: list[int]) -> DataFrame:
    return rows.where(F.col("bucket").isin(buckets))
