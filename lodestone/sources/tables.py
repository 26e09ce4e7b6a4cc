"""Versioned tables: `root/name/v=N` Parquet directories and a view of each name on its current version.

An upsert writes a whole next version (old rows without the new keys, then the new rows) and then moves
the view, so readers never see half of one. Deletions are anti-joins on the keys that go.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Primary keys of the tables.
KEYS = {
    "chunks": ["chunk_id"],
    "symbols": ["symbol_id"],
    "edges": ["edge_id"],
    "communities": ["community_id"],
    "files": ["tenant_id", "gitlab_project_id", "branch", "file_path"],
    "repos": ["repo_id"],
    "job_results": ["job_id"],
    "job_status": ["job_id"],
    "permissions": ["tenant_id", "user_id"],
}


class Store:
    """Tables under a root folder, each with numbered versions."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.root)
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path

    def version(self, name: str) -> int:
        """The current version, 0 without the table."""
        fs, path = self._fs()
        at = path(f"{self.root}/{name}")
        if not fs.exists(at):
            return 0
        return max((int(s.getPath().getName()[2:]) for s in fs.listStatus(at) if s.getPath().getName().startswith("v=") and fs.exists(path(s.getPath(), "_SUCCESS"))), default=0)

    def read(self, name: str) -> DataFrame | None:
        v = self.version(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v={v}") if v else None

    def publish(self, name: str, df: DataFrame) -> DataFrame:
        """df as the next version and the view of the name."""
        v = self.version(name) + 1
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/v={v}")
        now = self.spark.read.parquet(f"{self.root}/{name}/v={v}")
        now.createOrReplaceTempView(name)
        return now

    def ensure(self, name: str, schema) -> DataFrame:
        """The table, made empty if there is none."""
        have = self.read(name)
        if have is None:
            return self.publish(name, self.spark.createDataFrame([], schema))
        have.createOrReplaceTempView(name)
        return have

    def reindex(self, only: list[str] | None = None) -> dict[str, int]:
        """Copies tables to their next version; rows by table. Running it twice changes nothing but the version."""
        out = {}
        for name in KEYS:
            have = self.read(name) if only is None or name in only else None
            if have is not None:
                out[name] = self.publish(name, have).count()
        return out

    def upsert(self, name: str, rows: DataFrame) -> DataFrame:
        have = self.read(name)
        return self.publish(name, upserted(have, rows, KEYS[name]))

    def prune(self, name: str, keep: int = 2) -> None:
        """Deletes all but the last versions."""
        fs, path = self._fs()
        for v in range(1, self.version(name) - keep + 1):
            fs.delete(path(f"{self.root}/{name}/v={v}"), True)


def last_written(rows: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """One row a key: that with the greatest write ordinal, which is dropped."""
    order = W.partitionBy(*keys).orderBy(F.desc(ordinal))
    return rows.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n", ordinal)


def upserted(have: DataFrame | None, rows: DataFrame, keys: list[str]) -> DataFrame:
    """have with rows in place of those of equal keys."""
    if have is None:
        return rows
    return have.join(rows.select(*keys).distinct(), keys, "left_anti").unionByName(rows, allowMissingColumns=True)


FILE = ["tenant_id", "gitlab_project_id", "branch", "file_path"]


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """tables (files, chunks, symbols, edges) without the files in gone, and (table, deleted). Edges go by source or target path within the project and are not counted."""
    keys = gone.select(*FILE).distinct()
    out, counts = dict(tables), None
    for name, path in (("files", "file_path"), ("chunks", "file_path"), ("symbols", "definition_file_path")):
        own = keys.withColumnRenamed("file_path", path)
        out[name] = tables[name].join(own, [*FILE[:3], path], "left_anti")
        n = tables[name].join(own, [*FILE[:3], path], "left_semi").agg(F.lit(name).alias("table"), F.count("*").alias("deleted"))
        counts = n if counts is None else counts.unionByName(n)
    edges = tables["edges"]
    for path in ("source_file_path", "target_file_path"):
        if path in edges.columns:
            own = keys.select("tenant_id", F.col("gitlab_project_id").alias("source_repo_project_id"), "branch", F.col("file_path").alias(path))
            edges = edges.join(own, ["tenant_id", "source_repo_project_id", "branch", path], "left_anti")
    out["edges"] = edges
    return out, counts


def read_graph(store: Store, tenant: str, project: str, branch: str) -> tuple[DataFrame, DataFrame]:
    """All symbols and edges of a project's branch; the scope is a predicate that reaches the scan."""
    own = (F.col("tenant_id") == tenant) & (F.col("gitlab_project_id") == project) & (F.col("branch") == branch)
    return tuple(store.read(n).where(own) for n in ("symbols", "edges"))


def replace_files(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """tables with the new files' rows in place of their old ones, and (table, deleted)."""
    left, counts = delete_files(tables, new["files"])
    return {name: left[name].unionByName(new[name], allowMissingColumns=True) for name in left}, counts


def orphaned_edges(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    """Edges whose source chunk is gone."""
    return edges.join(chunks.select(F.col("chunk_id").alias("source_chunk_id")).distinct(), "source_chunk_id", "left_anti")


def prune_orphans(edges: DataFrame, chunks: DataFrame) -> DataFrame:
    return edges.join(chunks.select(F.col("chunk_id").alias("source_chunk_id")).distinct(), "source_chunk_id", "left_semi")


def lookup(table: DataFrame, ids: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """The columns of the rows with the ids, null where there is none."""
    return ids.join(table.select(key, *columns), key, "left")
