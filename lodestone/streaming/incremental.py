"""Incremental indexing: what a list of changes deletes and indexes, and its application to the tables, batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.operators.vector import DENSE, hash_embedding
from lodestone.scratch import cut, scratch
from lodestone.sources.tables import KEYS, Store, delete_files, prune_orphans, upserted

SCOPE = ["tenant_id", "gitlab_project_id", "branch"]


def plan_changes(changes: DataFrame, present: DataFrame) -> DataFrame:
    """(scope, file_path, action): delete or index, for changes (scope, old_path, new_path, deleted, renamed) and the paths there now.

    A deletion takes the old path away; a renaming as well and indexes the new one; a new path that is
    not there any more is deleted; everything else is indexed.
    """
    old = changes.where("deleted or renamed").select(*SCOPE, F.col("old_path").alias("file_path"))
    new = changes.where("not deleted").select(*SCOPE, F.col("new_path").alias("file_path"))
    here = present.select(*SCOPE, "file_path").distinct()
    gone = old.unionByName(new.join(here, [*SCOPE, "file_path"], "left_anti")).distinct().withColumn("action", F.lit("delete"))
    index = new.join(here, [*SCOPE, "file_path"], "left_semi").distinct().withColumn("action", F.lit("index"))
    return gone.join(index.select(*SCOPE, "file_path"), [*SCOPE, "file_path"], "left_anti").unionByName(index)


def unchanged_renames(changes: DataFrame, stored: DataFrame, now: DataFrame) -> DataFrame:
    """Renamings whose content is the same: the old path's stored hash is the new path's."""
    was = stored.select(*SCOPE, F.col("file_path").alias("old_path"), F.col("file_hash").alias("was"))
    is_ = now.select(*SCOPE, F.col("file_path").alias("new_path"), F.col("file_hash").alias("is"))
    return changes.where("renamed").join(was, [*SCOPE, "old_path"]).join(is_, [*SCOPE, "new_path"]).where(F.col("was") == F.col("is")).drop("was", "is")


def apply_changes(tables: dict[str, DataFrame], planned: DataFrame, new: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """tables after the planned deletions and with the new rows of the files to index; (table, deleted)."""
    left, counts = delete_files(tables, planned.withColumnRenamed("action", "__a").drop("__a"))
    return {n: upserted(left[n], new[n], KEYS[n]) for n in left}, counts


def index_repository(store: Store, files: DataFrame, ingest: Callable[..., dict[str, DataFrame]], *, communities: bool = False) -> dict[str, int]:
    """A full run, each file parsed once: the rows of all files take the place of theirs, orphaned edges go. A file that is not to be indexed any more loses its rows; paths that are no longer there keep theirs. Returns rows by table.

    With communities, those of the files' projects are detected anew; that this fails never fails the run.
    """
    with scratch(store.spark):
        new = {n: cut(df) for n, df in ingest(files, settle=cut).items()}
        have = {n: store.read(n) for n in new}
        if all(v is not None for v in have.values()):
            left, _ = delete_files(have, files)
            new = {n: upserted(left[n], new[n], KEYS[n]) for n in new}
        out = {n: store.publish(n, new[n]) for n in ("files", "chunks", "symbols")}
        out["edges"] = store.publish("edges", prune_orphans(new["edges"], out["chunks"]))
        counts = {n: df.count() for n, df in out.items()}
    if communities:
        done = guarded(lambda: {"communities": rebuild_communities(store, files)})
        counts["communities"] = done.get("communities", 0)
    return counts


def rebuild_communities(store: Store, scopes: DataFrame | None = None, *, min_size: int = graph.MIN_SIZE, embed: Callable[[Column], Column] | None = None) -> int:
    """Detects and embeds the communities of scopes (SCOPE columns; all that have symbols, if none are given) in the place of their former ones. Returns how many there are in all.

    embed makes a vector of a summary: the hash embedding unless another is given.
    """
    symbols, edges = store.read("symbols"), store.read("edges")
    scopes = (symbols if scopes is None else scopes).select(*SCOPE).distinct()
    symbols, edges = (df.join(scopes, SCOPE, "left_semi") for df in (symbols, edges))
    summary = F.col("summary")
    rows = graph.community_rows(symbols, edges, min_size=min_size).withColumn("embedding_dense", embed(summary) if embed else hash_embedding(DENSE)(summary))
    have = store.read("communities")
    if have is not None:
        rows = have.join(scopes, SCOPE, "left_anti").unionByName(rows, allowMissingColumns=True)
    return store.publish("communities", rows).count()


def index_stream(files: DataFrame, store: Store, ingest: Callable[..., dict[str, DataFrame]], checkpoint: str):
    """A stream of file versions, indexed micro-batch by micro-batch. A batch that is tried again writes the same rows."""

    def step(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            index_repository(store, batch, ingest)

    return files.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)


def guarded(run: Callable[[], dict]) -> dict:
    """The result of a run, or a failed one with its message: a run never raises."""
    try:
        return {"status": "succeeded", "error_message": None, **run()}
    except Exception as e:
        return {"status": "failed", "error_message": str(e)}
