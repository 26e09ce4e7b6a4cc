"""The command line: python -m lodestone COMMAND --root TABLES ... Results are JSON, a line a row."""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import assemble, evaluate
from lodestone.operators.vector import DENSE, hash_embedding
from lodestone.plans import ingest, search
from lodestone.shipping import ship
from lodestone.sources import files as S
from lodestone.sources.tables import KEYS, Store
from lodestone.streaming import incremental

SCOPE = {"tenant_id": "--tenant", "gitlab_project_id": "--project", "branch": "--branch"}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="lodestone")
    sub = out.add_subparsers(dest="command", required=True)

    def command(name: str, *options: str, **required: bool) -> None:
        p = sub.add_parser(name)
        p.add_argument("--root", required=name != "webhook-payload-changes")
        for o in options:
            p.add_argument(o, required=required.get(o.strip("-"), False))

    command("tables")
    command("reindex", "--only")
    command("index-project", "--folder", "--repo", "--commit", *SCOPE.values(), folder=True, repo=True, project=True)
    command("incremental-index", "--folder", "--repo", "--commit", "--changes", *SCOPE.values(), folder=True, repo=True, project=True, changes=True)
    command("search", "--query", "--user", "--top", *list(SCOPE.values())[::2], query=True)
    command("answer", "--query", "--user", "--top", *list(SCOPE.values())[::2], query=True)
    command("evaluate", "--cases", "--top", *list(SCOPE.values())[::2], cases=True)
    command("rebuild-communities")
    command("sync-permissions", "--file", file=True)
    command("webhook-payload-changes", "--file", file=True)
    return out


def _files(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    rows = S.walk(spark, a.folder).withColumn("content", S.decode_text(F.col("raw"))).drop("raw")
    named = {"tenant_id": a.tenant or "default", "gitlab_project_id": a.project, "branch": a.branch or "main", "commit_sha": a.commit or "", "repo_path_with_namespace": a.repo}
    return rows.withColumns({c: F.lit(v) for c, v in named.items()})


def _search(spark: SparkSession, store: Store, a: argparse.Namespace, queries: DataFrame) -> DataFrame:
    tables = {n: df for n in ("chunks", "symbols", "edges", "communities") if (df := store.read(n)) is not None}
    tables["chunk_vec"] = tables["chunks"].select("chunk_id", hash_embedding(DENSE)(F.col("text")).alias("dense"))
    return search.search(queries, tables, permissions=store.read("permissions") if getattr(a, "user", None) else None, top_k=int(a.top or 8))


def _query(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    row = ("q", a.query, a.tenant or "default", a.branch or "main", a.user, None)
    return spark.createDataFrame([row], "query_id string, query string, tenant_id string, branch string, user_id string, project_ids array<string>")


def run(spark: SparkSession, a: argparse.Namespace) -> DataFrame | list[dict]:
    """What a command gives: rows, or a list of records."""
    ship(spark)
    store = Store(spark, a.root) if a.root else None
    if a.command == "tables":
        return [{"table": n, "version": store.version(n)} for n in KEYS]
    if a.command == "reindex":
        return [store.reindex(a.only.split(",") if a.only else None)]
    if a.command == "index-project":
        return [incremental.guarded(lambda: incremental.index_repository(store, _files(spark, a), ingest.ingest, communities=True))]
    if a.command == "incremental-index":
        now = _files(spark, a)
        text = spark.read.text(a.changes, wholetext=True).select(S.changes_from_compare(F.col("value")).alias("c"))
        scope = {c: F.lit(getattr(a, o.strip("-")) or d) for (c, o), d in zip(SCOPE.items(), ("default", None, "main"), strict=True)}
        changes = text.select(F.explode("c").alias("c")).select("c.*").withColumns(scope)
        planned = incremental.plan_changes(changes, now)
        have = {n: store.read(n) for n in ("files", "chunks", "symbols", "edges")}
        todo = now.join(planned.where("action = 'index'").drop("action"), [*SCOPE, "file_path"], "left_semi")
        left, counts = incremental.apply_changes(have, planned, ingest.ingest(todo))
        return [{"deleted": {r["table"]: r.deleted for r in counts.collect()}} | {n: store.publish(n, df).count() for n, df in left.items()}]
    if a.command in ("search", "answer"):
        queries = _query(spark, a)
        hits = _search(spark, store, a, queries)
        return hits.orderBy("final_rank") if a.command == "search" else assemble.extractive_answer(queries, hits)
    if a.command == "evaluate":
        golden = evaluate.load_golden(spark, a.cases)
        asked = golden.select(F.col("case_id").alias("query_id"), "query", F.lit(a.tenant or "default").alias("tenant_id"), F.coalesce("branch", F.lit(a.branch or "main")).alias("branch"), "user_id", F.col("allowed_project_ids").alias("project_ids"))
        hits = _search(spark, store, a, asked).select(F.col("query_id").alias("case_id"), F.col("final_rank").alias("rank"), "chunk_id", "file_path", "symbol_fqn", "symbol_name").join(golden.select("case_id", "relevant"), "case_id")
        hits = hits.withColumn("is_rel", evaluate.is_relevant(F.col("relevant"), F.col("chunk_id"), F.col("file_path"), F.col("symbol_fqn"), F.col("symbol_name")))
        return evaluate.macro(evaluate.score_cases(golden, hits, int(a.top or 8)))
    if a.command == "rebuild-communities":
        return [{"communities": incremental.rebuild_communities(store)}]
    if a.command == "sync-permissions":
        rows = spark.read.schema("tenant_id string, user_id string, accessible_project_ids array<string>").json(a.file)
        return [{"permissions": store.upsert("permissions", rows).count()}]
    return spark.read.text(a.file, wholetext=True).select(F.explode(S.changes_from_push(F.col("value"))).alias("c")).select("c.*")


def main(argv: list[str] | None = None) -> None:
    a = parser().parse_args(argv)
    spark = SparkSession.builder.appName("lodestone").getOrCreate()
    found = run(spark, a)
    lines = found.toJSON().toLocalIterator() if isinstance(found, DataFrame) else map(json.dumps, found)
    for line in lines:
        sys.stdout.write(line + "\n")


if __name__ == "__main__":
    main()
