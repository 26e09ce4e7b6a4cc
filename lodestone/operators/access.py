"""Permissions and row filters: which projects a request may see, and the filters that follow."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.scratch import BROADCAST_BYTES, byte_size, cut, spread_join

#: Rows of one scope that go together in a list.
PACK = 4096


def resolve(requests: DataFrame, permissions: DataFrame, *, trust_requests: bool = False) -> DataFrame:
    """requests (query_id, tenant_id, user_id, project_ids) with allowed (sorted project ids) and denied (why not, or null).

    A user's own projects, cut to those asked for if any are. Without a user the request's projects
    count only where requests are trusted.
    """
    rows = requests.join(permissions.select("tenant_id", "user_id", F.col("accessible_project_ids").alias("__own"), F.lit(True).alias("__has")), ["tenant_id", "user_id"], "left")
    asked = F.coalesce("project_ids", F.array().cast("array<string>"))
    own = F.array_sort(F.array_distinct("__own"))
    user = F.coalesce(F.length("user_id"), F.lit(0)) > 0
    allowed = F.when(user & F.col("__has"), F.when(F.size(asked) > 0, F.array_sort(F.array_intersect(own, asked))).otherwise(own)).when(~user & F.lit(trust_requests) & (F.size(asked) > 0), asked)
    denied = F.when(user & F.col("__has").isNull(), "No permission record for the user").when(~user & allowed.isNull(), "A user with synced permissions is required")
    return rows.withColumn("allowed", allowed).withColumn("denied", denied).drop("__own", "__has")


def grants(resolved: DataFrame) -> DataFrame:
    """(query_id, tenant_id, branch, project_id): a row for each project a query may read. Queries that may read none have no row."""
    return resolved.where("denied is null").select("query_id", "tenant_id", *(["branch"] if "branch" in resolved.columns else []), F.explode("allowed").alias("project_id"))


def readable(rows: DataFrame, granted: DataFrame, *, row_id: str, project: str = "gitlab_project_id", repo: str | None = None, repos: DataFrame | None = None, active: str | None = None) -> DataFrame:
    """(query_id, row_id) of the rows each query may read: same tenant and branch, a granted project, and one of its repositories where it names some.

    Where no repositories are named, the ids of a scope are packed in sorted lists, which are broadcast where their counted bytes
    allow, and the grants, sorted by scope, unfold them: nothing grows before the output, whose runs and repeated lists files hold in little.
    """
    own = rows if active is None else rows.where(F.col(active))
    keys = [k for k in ("tenant_id", "branch") if k in granted.columns and k in own.columns]
    own = own.select(F.col(row_id), F.col(project).alias("project_id"), *keys, *([F.col(repo).alias("repo_path")] if repo else []))
    if repos is None or not repo:
        return _unfolded(own, granted, [*keys, "project_id"], row_id)
    out = own.join(granted, [*keys, "project_id"])
    named = repos.select("query_id").distinct().withColumn("__named", F.lit(True))
    hit = repos.select("query_id", "repo_path").distinct().withColumn("__hit", F.lit(True))
    out = out.join(named, "query_id", "left").join(hit, ["query_id", "repo_path"], "left").where("__named is null or __hit")
    return out.select("query_id", row_id)


def _unfolded(own: DataFrame, granted: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """(query_id, row_id) of own joined to granted on keys: own's ids go in lists, in the same order to every query."""
    wanted = cut(granted.select("query_id", *keys).sortWithinPartitions(*keys))
    rows, size = byte_size(own.select(row_id, *keys))
    few = size <= BROADCAST_BYTES
    part = F.lit(0) if few else F.pmod(F.xxhash64(row_id), F.lit(max(1, rows // PACK)))
    lists = own.groupBy(*keys, part.alias("__part")).agg(F.sort_array(F.collect_list(F.struct(row_id))).alias("__ids")).drop("__part")
    out = wanted.join(F.broadcast(lists), keys) if few else spread_join(wanted, lists, keys, broadcast=False)
    return out.select("query_id", F.explode("__ids").alias("__id")).select("query_id", f"__id.{row_id}")


def scope_keys(rows: DataFrame, granted: DataFrame, project: str = "gitlab_project_id") -> dict[str, str]:
    """Columns of granted that say what may be read, each with its name in rows."""
    return {k: k for k in ("tenant_id", "branch") if k in granted.columns and k in rows.columns} | {"project_id": project}


def permit(rows: DataFrame, granted: DataFrame, row_id: str, *, project: str = "gitlab_project_id", active: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """A filter of scored rows (query_id, doc_id, ...): those whose row, by its id, is in a scope that the query is granted.

    Scored rows take up their row's scope and are held against the grants; no pair of query and readable row is made.
    """
    keys = scope_keys(rows, granted, project)
    own = rows if active is None else rows.where(F.col(active))
    own = own.select(F.col(row_id).alias("doc_id"), *(F.col(c).alias(f"__{k}") for k, c in keys.items()))
    grants_ = granted.select("query_id", *(F.col(k).alias(f"__{k}") for k in keys)).distinct()

    def only(scored: DataFrame) -> DataFrame:
        return scored.join(own, "doc_id").join(grants_, ["query_id", *(f"__{k}" for k in keys)], "left_semi").select(*scored.columns)

    return scoped(only, [F.col(c) for c in keys.values()], grants_.select("query_id", *(F.col(f"__{k}").alias(k) for k in keys)), active)


def scoped(only: Callable[[DataFrame], DataFrame], of_row: list[Column], granted: DataFrame, active: str | None = None) -> Callable[[DataFrame], DataFrame]:
    """only, with what it reads by: its scope, a list with a row's scope of the columns named, empty where one is null; and granted (query_id, scope)."""
    as_text = lambda cs: F.to_json(F.struct(*(c.cast("string").alias(f"k{i}") for i, c in enumerate(cs))))
    whole = F.lit(True) if active is None else F.coalesce(F.col(active), F.lit(False))
    for c in of_row:
        whole = whole & c.isNotNull()
    only.scope = F.when(whole, F.array(as_text(of_row)))
    only.granted = granted.select("query_id", as_text([F.col(c) for c in granted.columns if c != "query_id"]).alias("scope"))
    return only


def scope(tenant: str, branch: str, projects: list[str], repo_paths: list[str] | None = None, *, project: str = "gitlab_project_id", active: str | None = "active_snapshot") -> Column:
    """The filter of a single request as a predicate that reaches the scan. No projects: nothing passes."""
    out = (F.col("tenant_id") == tenant) & (F.col("branch") == branch) & F.col(project).isin(projects)
    if active:
        out = out & F.col(active)
    return out & F.col("repo_path_with_namespace").isin(repo_paths) if repo_paths else out


def either(*clauses: Column) -> Column:
    """At least one of the clauses, null counting as false."""
    out = F.lit(False)
    for c in clauses:
        out = out | F.coalesce(c, F.lit(False))
    return out
