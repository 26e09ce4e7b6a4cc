"""The job queue as tables: push filter, idempotent enqueue, claims with a lease, finishing, short-circuits."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.identity import stable_id
from lodestone.sources.tables import Store
from lodestone.streaming.incremental import guarded

CANDIDATES = 10


def job_id(job_type: Column, project: Column, branch: Column, old_sha: Column, new_sha: Column) -> Column:
    return stable_id(job_type, project, branch, old_sha, new_sha)


def push_events(payloads: DataFrame, branch: str, token: str | None = None) -> DataFrame:
    """payloads (body JSON, token) of pushes to the branch with both commits and the right token; works on streams as well."""
    schema = "ref string, before string, after string, project struct<id:string,path_with_namespace:string,name:string,git_http_url:string>"
    rows = payloads.withColumn("p", F.from_json("body", schema))
    if token is not None:
        rows = rows.where(F.col("token") == token)
    rows = rows.where((F.col("p.ref") == f"refs/heads/{branch}") & (F.length("p.before") > 0) & (F.length("p.after") > 0))
    return rows.select(
        job_id(F.lit("incremental"), F.col("p.project.id"), F.lit(branch), F.col("p.before"), F.col("p.after")).alias("job_id"),
        F.lit("incremental").alias("job_type"),
        F.col("p.project.id").alias("gitlab_project_id"),
        F.col("p.project.path_with_namespace").alias("repo_path_with_namespace"),
        F.lit(branch).alias("branch"),
        F.col("p.before").alias("old_sha"),
        F.col("p.after").alias("new_sha"),
    )


def enqueue(status: DataFrame, new: DataFrame) -> DataFrame:
    """status with the new jobs (job_id, job_type, payload, submitted_at) queued. One that is queued, running or done stays as it is; a failed one is queued anew; of several submissions the first counts."""
    first = W.partitionBy("job_id").orderBy("submitted_at")
    new = new.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")
    kept = status.where("status <> 'failed'")
    fresh = new.join(kept.select("job_id"), "job_id", "left_anti").withColumns({"status": F.lit("queued"), "attempts": F.lit(0)})
    rest = status.join(fresh.select("job_id"), "job_id", "left_anti")
    return rest.unionByName(fresh, allowMissingColumns=True)


def claimable(status: DataFrame, now: Column) -> DataFrame:
    """The oldest jobs that are queued, or running under a lease that has run out."""
    free = (F.col("status") == "queued") | ((F.col("status") == "running") & (F.col("lock_expires_at") < now))
    return status.where(free).orderBy("submitted_at", "job_id").limit(CANDIDATES)


def claim(status: DataFrame, worker: str, now: Column, lease_seconds: int) -> tuple[DataFrame, DataFrame]:
    """(the job claimed, none or one row; status after it). One writer claims at a time."""
    until = now + F.make_dt_interval(secs=F.lit(lease_seconds))
    mine = claimable(status, now).limit(1).withColumns({"status": F.lit("running"), "started_at": now, "locked_by": F.lit(worker), "lock_expires_at": until, "attempts": F.coalesce("attempts", F.lit(0)) + 1})
    return mine, status.join(mine.select("job_id"), "job_id", "left_anti").unionByName(mine)


def finish(status: DataFrame, results: DataFrame, now: Column) -> DataFrame:
    """status with the jobs in results (job_id, status, error_message) ended and their lease given up."""
    r = results.select("job_id", F.when(F.col("status") == "succeeded", "succeeded").otherwise("failed").alias("__s"), F.col("error_message").alias("__e"))
    rows, done = status.join(r, "job_id", "left"), F.col("__s").isNotNull()
    return rows.withColumns(
        {
            "status": F.coalesce("__s", "status"),
            "finished_at": F.when(done, now).otherwise(F.col("finished_at")),
            "error_message": F.when(done, F.col("__e")).otherwise(F.col("error_message")),
            "locked_by": F.when(~done, F.col("locked_by")),
            "lock_expires_at": F.when(~done, F.col("lock_expires_at")),
        }
    ).drop("__s", "__e")


def unfinished(jobs: DataFrame, results: DataFrame) -> DataFrame:
    """Jobs without a result that succeeded."""
    return jobs.join(results.where("status = 'succeeded'").select("job_id"), "job_id", "left_anti")


def dedupe_stream(jobs: DataFrame, time: str, delay: str = "1 hour") -> DataFrame:
    """A stream of submissions, each job once within the delay."""
    return jobs.withWatermark(time, delay).dropDuplicatesWithinWatermark(["job_id"])


def work(store: Store, worker: str, runners: dict[str, Callable[[dict], dict]], *, lease_seconds: int = 900, wait: float = 0.5, polls: int | None = None) -> int:
    """A worker's loop: claims a job, runs what its type asks for, ends it; waits where there is none. Returns how many it ran.

    runners: by job type, given the job's row as a dictionary. An incremental job whose payload names no
    changes but asks for a fallback is run as a full one. polls bounds the turns of the loop; None: for ever.
    """
    ran = turn = 0
    while polls is None or turn < polls:
        turn += 1
        status = store.read("job_status")
        job = None
        if status is not None:
            mine, after = claim(status, worker, F.current_timestamp(), lease_seconds)
            job = mine.first()
        if job is None:
            time.sleep(wait)
            continue
        after = store.publish("job_status", after)
        row = job.asDict(recursive=True)
        payload = json.loads(row.get("payload") or "{}")
        kind = row["job_type"]
        if kind == "incremental" and not payload.get("changes") and payload.get("full_if_empty"):
            kind = "full"
        done = guarded(lambda kind=kind, row=row, payload=payload: runners[kind](row | {"payload": payload}))
        result = store.spark.createDataFrame([(row["job_id"], done["status"], done["error_message"])], "job_id string, status string, error_message string")
        store.publish("job_status", finish(after, result, F.current_timestamp()))
        store.upsert("job_results", result)
        ran += 1
    return ran
