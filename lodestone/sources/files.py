"""Source files and changes: directory walks, decoding, file facts, remote pages, commit comparisons, snapshots."""

from __future__ import annotations

import json
import tomllib
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.identity import content_hash

#: Python's line ends beside \n: what str.splitlines() splits at.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
CHANGE = "struct<old_path:string,new_path:string,new_file:boolean,deleted_file:boolean,renamed_file:boolean>"


def _empty_files(spark: SparkSession, root: str) -> list[str]:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    listed = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(at, True)
    out = []
    while listed.hasNext():
        status = listed.next()
        if status.getLen() == 0:
            out.append(status.getPath().toString())
    return out


def walk(spark: SparkSession, root: str) -> DataFrame:
    """(file_path, size_bytes, raw) of every file below root. Spark's reader passes over empty files; they are listed beside it."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path", "length", "content")
    rows = rows.unionByName(spark.createDataFrame([(p, 0, bytearray()) for p in _empty_files(spark, root)], "path string, length long, content binary"))
    base = root.rstrip("/") + "/"
    at = F.locate(base, F.col("path"))
    return rows.select(F.substring("path", at + len(base), F.lit(1 << 20)).alias("file_path"), F.col("length").alias("size_bytes"), F.col("content").alias("raw"))


def decode_text(raw: Column) -> Column:
    """UTF-8 without what is not UTF-8; line ends become a newline."""
    return F.regexp_replace(F.replace(F.make_valid_utf8(raw.cast("string")), F.lit("�"), F.lit("")), "\r\n?", "\n")


def split_lines(text: Column) -> Column:
    """Lines as str.splitlines() has them: no empty one after a final line end, none in an empty text."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def file_facts(files: DataFrame, content: str = "content") -> DataFrame:
    """files with line_count and file_hash."""
    return files.withColumn("line_count", F.size(split_lines(F.col(content)))).withColumn("file_hash", content_hash(F.col(content)))


def repo_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Repository metadata from JSON or TOML, a list or {repos: [...]}, the last entry of a repository winning."""
    if not path.endswith((".json", ".toml")):
        raise ValueError(f"neither JSON nor TOML: {path}")
    text = "\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())  # one small file
    data = json.loads(text) if path.endswith(".json") else tomllib.loads(text)
    fields = ["repo_path_with_namespace", "team_owner", "business_domain", "service_name", "slack_channel", "jira_project", "service_type", "deployment_name"]
    rows = {r["repo_path_with_namespace"]: tuple(r.get(f) for f in fields) for r in (data.get("repos", []) if isinstance(data, dict) else data)}
    return spark.createDataFrame(list(rows.values()), ", ".join(f"{f} string" for f in fields))


def enrich(files: DataFrame, metadata: DataFrame) -> DataFrame:
    """files with their repository's metadata. Spark decides by size whether metadata is broadcast."""
    return files.join(metadata, "repo_path_with_namespace", "left")


def service_for_repo(projects: DataFrame) -> DataFrame:
    """A project's name is its service's where it has one."""
    return projects.withColumn("repo_name", F.coalesce("service_name", "repo_name"))


def changes_from_compare(reply: Column) -> Column:
    """array<struct> of changes from a comparison's JSON ({diffs: [...]})."""
    return _changes(F.from_json(reply, f"struct<diffs:array<{CHANGE}>>")["diffs"])


def _changes(diffs: Column) -> Column:
    no = lambda x: F.coalesce(x, F.lit(False))
    return F.transform(
        diffs,
        lambda d: F.struct(
            F.coalesce(d["old_path"], d["new_path"]).alias("old_path"),
            F.coalesce(d["new_path"], d["old_path"]).alias("new_path"),
            no(d["new_file"]).alias("added"),
            no(d["deleted_file"]).alias("deleted"),
            no(d["renamed_file"]).alias("renamed"),
            (~no(d["new_file"]) & ~no(d["deleted_file"]) & ~no(d["renamed_file"])).alias("modified"),
        ),
    )


def changes_from_push(payload: Column) -> Column:
    """array<struct> of changes from a push's JSON ({commits: [{added, modified, removed}]})."""
    commits = F.from_json(payload, "struct<commits:array<struct<added:array<string>,modified:array<string>,removed:array<string>>>>")["commits"]
    kinds = (("added", "added"), ("modified", "modified"), ("removed", "deleted"))

    def change(kind: str):
        return lambda p: F.struct(p.alias("old_path"), p.alias("new_path"), F.lit(kind == "added").alias("added"), F.lit(kind == "deleted").alias("deleted"), F.lit(False).alias("renamed"), F.lit(kind == "modified").alias("modified"))

    def of(commit: Column) -> Column:
        return F.concat(*(F.transform(F.coalesce(commit[field], F.array().cast("array<string>")), change(kind)) for field, kind in kinds))

    return F.flatten(F.transform(commits, of))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, change): added, deleted or modified between two snapshots with file_hash."""
    both = old.select(*keys, F.col("file_hash").alias("__old")).join(new.select(*keys, F.col("file_hash").alias("__new")), keys, "full_outer")
    kind = F.when(F.col("__old").isNull(), "added").when(F.col("__new").isNull(), "deleted").when(F.col("__old") != F.col("__new"), "modified")
    return both.withColumn("change", kind).where("change is not null").drop("__old", "__new")


def paged(spark: SparkSession, fetch: Callable[[int], tuple[list[str], int | None]], first: int = 1) -> DataFrame:
    """(page, json): the items of a paged source; fetch(page) gives its items as JSON and the next page or None. Pages name their successors, so they are read one after another."""
    rows, page = [], first
    while page:
        items, following = fetch(page)
        rows += [(page, i) for i in items]
        page = following
    return spark.createDataFrame(rows, "page int, json string")
