"""Access to the given tables and to the views derived from them."""

from __future__ import annotations

import hashlib
import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession

from tallyloom.plans.views import VIEWS

BASE = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

# the few spellings that differ between the two dialects: marker -> (Spark, DuckDB)
DIALECT = {
    r"~epoch\((\w+)\)": (r"timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', \1)", r"CAST(floor(epoch(\1)) AS BIGINT)"),
    r"~el\((\w+), *(\d+)\)": (r"element_at(\1, \2)", r"list_extract(\1, \2)"),
    r"~explode\(([^()]*)\)": (r"explode(array(\1))", r"unnest([\1])"),
    r"~array\(((?:[^()]|\([^()]*\))*)\)": (r"array(\1)", r"[\1]"),
    r"~sha\(((?:[^()]|\([^()]*\))*)\)": (r"sha2(\1, 256)", r"sha256(\1)"),
}


def spell(sql: str, duck: bool) -> str:
    for pattern, forms in DIALECT.items():
        sql = re.sub(pattern, forms[1 if duck else 0], sql)
    return sql


def needed(names: list[str]) -> list[str]:
    """The views and those they build on, inner ones first."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for other in re.findall(r"@(\w+)", VIEWS[name]):
            if other in VIEWS:
                visit(other)
        order.append(name)

    for name in names:
        visit(name)
    return order


def duck_sql(sql: str) -> str:
    """Complete oracle text: ``@view`` names become common table expressions."""
    used = [n for n in re.findall(r"@(\w+)", sql) if n in VIEWS]
    ctes = [f"{n} AS ({spell(VIEWS[n], True).replace('@', '')})" for n in needed(used)]
    body = re.sub(r"@(\w+)", r"\1", spell(sql, True)).strip()
    if not ctes:
        return body
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body


class Tables:
    """Lazy readers for one data folder; ``t.view(name)`` gives a derived view."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def __getattr__(self, name: str) -> DataFrame:
        if name not in BASE:
            raise AttributeError(name)
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def state(self, *names: str) -> str:
        """A digest of the files of some tables: paths, sizes and times of change."""
        seen = hashlib.md5()
        for name in names:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}.parquet")
            files = path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listFiles(path, True)
            while files.hasNext():
                f = files.next()
                seen.update(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}\n".encode())
        return seen.hexdigest()

    @cached_property
    def prefix(self) -> str:
        return "t" + hashlib.md5(self.folder.encode()).hexdigest()[:10] + "_"

    def view(self, name: str) -> DataFrame:
        for view in needed([name]):
            text = spell(VIEWS[view], False)
            for other in set(re.findall(r"@(\w+)", text)):
                if other in BASE:
                    getattr(self, other).createOrReplaceTempView(self.prefix + other)
            frame = self.spark.sql(re.sub(r"@(\w+)", rf"{self.prefix}\1", text))
            frame.createOrReplaceTempView(self.prefix + view)
        return self.spark.table(self.prefix + name)
