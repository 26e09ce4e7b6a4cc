"""The code graph: edge resolution, neighbours, k-hop expansion, label propagation and community rows."""

from __future__ import annotations

import os
from array import array
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.functions.identity import short_name, stable_id
from lodestone.operators.lexical import Allowed
from lodestone.scratch import byte_size, cut
from lodestone.shipping import ship

#: Edge types followed for each query class.
EDGE_POLICY = {
    "definition_lookup": ["CALLS", "REFERENCES", "IMPORTS"],
    "usage_lookup": ["CALLS", "REFERENCES"],
    "architecture_question": ["CALLS", "IMPORTS", "REFERENCES"],
    "debugging_question": ["CALLS", "REFERENCES"],
    "api_question": ["EXPOSES_ENDPOINT", "CALLS"],
    "config_question": ["CONFIGURES", "IMPORTS"],
    "test_question": ["TESTS", "CALLS"],
    "deployment_question": ["CONFIGURES"],
    "migration_question": ["REFERENCES", "CALLS"],
    "ownership_question": ["IMPORTS"],
}
SEEDS, HOPS, MAX_NEIGHBORS = 5, 1, 10
ROUNDS, MIN_SIZE, MAX_MEMBERS, SUMMARY_SYMBOLS, MAX_FILES, SUMMARY_FILES = 20, 3, 200, 25, 50, 15
SCOPE = ["tenant_id", "gitlab_project_id", "branch"]
#: Bytes of hashes of names that are broadcast to pass edges by, counted before.
ASKED_BYTES = 32 << 20


def edge_policy(spark) -> DataFrame:
    """(query_type, edge_type): a fixed table of two dozen rows."""
    return spark.createDataFrame([(q, e) for q, es in EDGE_POLICY.items() for e in es], "query_type string, edge_type string")


def seeds(fused: DataFrame, n: int = SEEDS) -> DataFrame:
    """(query_id, fqn): names of the first n fused hits, fewer where hits have none."""
    return fused.where((F.col("rank") <= n) & F.col("symbol_fqn").isNotNull()).select("query_id", F.col("symbol_fqn").alias("fqn")).distinct()


def neighbours(frontier: DataFrame, edges: DataFrame, symbols: DataFrame, policy: DataFrame, limit: int = MAX_NEIGHBORS, granted: DataFrame | None = None, allowed: Allowed = None) -> DataFrame:
    """(query_id, chunk_id, symbol_fqn, place): definitions at the other end of the frontier's edges.

    frontier: query_id, query_type, fqn. Either end of an edge may be the seed: two equi-joins, united.
    The other end is matched by qualified name or by short name, again united. At most max(5 limit, 25)
    edges, max(2 limit, 20) symbols and limit chunks a query, by confidence and then by id. granted, rows of (query_id, tenant_id, branch, project_id),
    and allowed, pairs of (query_id, chunk_id) or a filter of (query_id, doc_id, ...), say what a query may read; edges and symbols beyond it go before each cut.
    """
    want = frontier.join(F.broadcast(policy), "query_type")
    keys = [] if granted is None else [k for k in ("tenant_id", "branch") if k in granted.columns and k in edges.columns] + ["project_id"]
    near = edges.select("edge_id", "edge_type", "confidence", F.col("source_symbol_fqn").alias("s"), F.col("target_symbol_fqn").alias("t"), *(F.col("gitlab_project_id" if k == "project_id" else k).alias(k) for k in keys))
    ends = [near.select("edge_id", "edge_type", "confidence", *keys, F.col(a).alias("fqn"), F.col(b).alias("other")) for a, b in (("s", "t"), ("t", "s"))]
    asked = frontier.select(F.xxhash64("fqn").alias("__h")).distinct()
    if byte_size(asked)[1] <= ASKED_BYTES:
        # the ends that nobody asks for go before they are dealt out; hashes may let a few stay, which the join drops
        ends = [x.join(F.broadcast(asked), F.xxhash64("fqn") == F.col("__h"), "left_semi") for x in ends]
    if granted is None:
        # an edge beyond the first of its end is beyond the first of every query, which meets all of that end's
        first = F.row_number().over(W.partitionBy("edge_type", "fqn").orderBy(F.desc("confidence"), "edge_id", "other"))
        ends = [x.withColumn("__n", first).where(F.col("__n") <= max(5 * limit, 25)).drop("__n") for x in ends]
    met = want.join(ends[0], ["edge_type", "fqn"]).unionByName(want.join(ends[1], ["edge_type", "fqn"]))
    if granted is not None:
        met = met.join(granted, ["query_id", *keys], "left_semi").drop(*keys)
    by_edge = W.partitionBy("query_id").orderBy(F.desc("confidence"), "edge_id", "other")
    met = met.withColumn("n", F.row_number().over(by_edge)).where(F.col("n") <= max(5 * limit, 25))
    names = met.join(frontier.select("query_id", F.col("fqn").alias("other")), ["query_id", "other"], "left_anti").groupBy("query_id", "other").agg(F.min("n").alias("n"))
    defined = symbols.select("symbol_id", "symbol_fqn", "symbol_name", F.col("definition_chunk_id").alias("chunk_id"))
    full = names.join(defined, F.col("other") == F.col("symbol_fqn"))
    short = names.join(defined, short_name(F.col("other")) == F.col("symbol_name"))
    found = full.unionByName(short).groupBy("query_id", "symbol_id", "symbol_fqn", "chunk_id").agg(F.min("n").alias("n"))
    if callable(allowed):
        found = allowed(found.withColumnRenamed("chunk_id", "doc_id")).withColumnRenamed("doc_id", "chunk_id")
    elif allowed is not None:
        found = found.join(allowed, ["query_id", "chunk_id"], "left_semi")
    by_symbol = W.partitionBy("query_id").orderBy("n", "symbol_id")
    found = found.withColumn("k", F.row_number().over(by_symbol)).where(F.col("k") <= max(2 * limit, 20))
    chunks = found.groupBy("query_id", "chunk_id").agg(F.min(F.struct("k", "symbol_fqn")).alias("x"))
    place = F.row_number().over(W.partitionBy("query_id").orderBy("x.k", "chunk_id"))
    return chunks.select("query_id", "chunk_id", "x.symbol_fqn", place.alias("place")).where(F.col("place") <= limit)


def expand(fused: DataFrame, queries: DataFrame, edges: DataFrame, symbols: DataFrame, *, hops: int = HOPS, limit: int = MAX_NEIGHBORS, n_seeds: int = SEEDS, granted: DataFrame | None = None, allowed: Allowed = None) -> DataFrame:
    """(query_id, chunk_id, rank, graph_expanded): up to limit new chunks a query, over several hops.

    Each hop is a join against what was met before; it is materialised and ends when no query has a
    frontier left. queries: query_id, query_type. granted, allowed: as for neighbours.
    """
    spark = fused.sparkSession
    policy = edge_policy(spark)
    seen = fused.select("query_id", "chunk_id").distinct()
    frontier = seeds(fused, n_seeds).join(queries.select("query_id", "query_type"), "query_id")
    collected = None
    for hop in range(max(1, hops)):
        met = neighbours(frontier, edges, symbols, policy, limit, granted, allowed).join(seen, ["query_id", "chunk_id"], "left_anti").withColumn("hop", F.lit(hop))
        if collected is not None:
            have = collected.groupBy("query_id").agg(F.count("*").alias("have"))
            met = met.join(have, "query_id", "left").where(F.col("place") + F.coalesce("have", F.lit(0)) <= limit).drop("have")
        if hops > 1:
            met = cut(met)
        collected = met if collected is None else collected.unionByName(met)
        if hop + 1 >= hops or met.isEmpty():
            break
        seen = seen.unionByName(met.select("query_id", "chunk_id"))
        # a query that has all it may get looks no further
        full = collected.groupBy("query_id").agg(F.count("*").alias("have")).where(F.col("have") >= limit).select("query_id")
        met = met.join(full, "query_id", "left_anti")
        frontier = met.where("symbol_fqn is not null").select("query_id", F.col("symbol_fqn").alias("fqn")).distinct().join(queries.select("query_id", "query_type"), "query_id")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy("hop", "place"))
    return collected.select("query_id", "chunk_id", rank.alias("rank"), F.lit(True).alias("graph_expanded"))


def _resolved(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """resolve_edges, with a row for each of equal edges."""
    known = symbols.where("symbol_fqn is not null and symbol_fqn <> ''").select(*SCOPE, "symbol_fqn").distinct()
    raw = edges.where("target_symbol_fqn is not null and target_symbol_fqn <> ''").select(*SCOPE, F.col("source_symbol_fqn").alias("source"), F.col("target_symbol_fqn").alias("raw"))
    raw = raw.join(known.withColumnRenamed("symbol_fqn", "source"), [*SCOPE, "source"], "left_semi")
    exact = known.select(*SCOPE, F.col("symbol_fqn").alias("raw"), F.col("symbol_fqn").alias("exact"))
    alone = known.groupBy(*SCOPE, short_name(F.col("symbol_fqn")).alias("short")).agg(F.count("*").alias("n"), F.min("symbol_fqn").alias("only")).where("n = 1").drop("n")
    out = raw.join(exact, [*SCOPE, "raw"], "left").withColumn("short", short_name(F.col("raw"))).join(alone, [*SCOPE, "short"], "left")
    return out.select(*SCOPE, "source", F.coalesce("exact", "only").alias("target")).where("target is not null and target <> source")


def resolve_edges(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, source, target): edges between known symbols. A target is a qualified name, else the only symbol with its short name, else dropped."""
    return _resolved(symbols, edges).distinct()


def adjacency(symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(scope, node, neighbor): both directions, each once. Rows are dealt out before equal ones are met: few are, and a table of a task's own would hold nearly all it reads."""
    ends = F.array(F.struct(F.col("source").alias("node"), F.col("target").alias("neighbor")), F.struct(F.col("target").alias("node"), F.col("source").alias("neighbor")))
    both = _resolved(symbols, edges).select(*SCOPE, F.explode(ends).alias("x")).select(*SCOPE, "x.node", "x.neighbor")
    return both.repartition(*SCOPE, "node", "neighbor").distinct()


def degrees(adjacent: DataFrame) -> DataFrame:
    return adjacent.groupBy(*SCOPE, "node").agg(F.count("*").alias("degree"))


def _propagate(near: np.ndarray, starts: np.ndarray, rounds: int = ROUNDS) -> list[int]:
    """Label propagation in the order of nodes, each node seeing labels set earlier in the same round. A node's neighbours are near[starts[i]:starts[i + 1]].

    A node is looked at again only after a neighbour's label has changed: without that its own would stay.
    """
    label, due = list(range(len(starts) - 1)), bytearray(b"\1" * (len(starts) - 1))
    for _ in range(rounds):
        moved = False
        for i in range(len(label)):
            if not due[i]:
                continue
            due[i] = 0
            own = near[starts[i] : starts[i + 1]].tolist()
            if own:
                votes = Counter(map(label.__getitem__, own))
                most = max(votes.values())
                best = min(x for x, v in votes.items() if v == most)
                if best != label[i]:
                    moved, label[i] = True, best
                    for m in own:
                        due[m] = 1
        if not moved:
            break
    return label


class _Scope:
    """The graph of one scope as it comes in: first its nodes in order (without a neighbour), then its edges by node. Names are held once, edges as 32-bit numbers."""

    def __init__(self, key: tuple) -> None:
        self.key, self.ids, self.near, self.degree = key, {}, array("i"), array("i")

    def add(self, nodes: pa.Array, neighbours: pa.Array) -> None:
        alone = neighbours.null_count
        for name in nodes.slice(0, alone).to_pylist():
            self.ids.setdefault(name, len(self.ids))
        self.degree.frombytes(bytes(4 * (len(self.ids) - len(self.degree))))
        if alone < len(nodes):
            place = self.ids.__getitem__
            runs = pc.run_end_encode(nodes.slice(alone))
            ends = np.diff(runs.run_ends.to_numpy(), prepend=0)
            for name, n in zip(runs.values.to_pylist(), ends.tolist(), strict=True):
                self.degree[place(name)] += n
            self.near.extend(map(place, neighbours.slice(alone).to_pylist()))

    def labels(self) -> Iterator[pa.RecordBatch]:
        starts = np.concatenate(([0], np.cumsum(np.frombuffer(self.degree, dtype=np.int32), dtype=np.int64)))
        label = _propagate(np.frombuffer(self.near, dtype=np.int32), starts)
        names = list(self.ids)
        for at in range(0, len(names), 65536):
            own = names[at : at + 65536]
            columns = [pa.array([k] * len(own), pa.string()) for k in self.key]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(own, pa.string()), pa.array([names[x] for x in label[at : at + 65536]], pa.string())], names=[*SCOPE, "node", "label"])


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For mapInArrow: sorted rows (scope, node, neighbor) of any number of scopes to (scope, node, label), a scope at a time."""
    now = None
    for batch in batches:
        at, n = 0, batch.num_rows
        key = lambda i: tuple(batch.column(k)[i].as_py() for k in range(len(SCOPE)))  # noqa: B023, E731
        while at < n:
            own = key(at)
            to = n if key(n - 1) == own else bisect_left(range(n), True, lo=at, key=lambda i: key(i) != own)  # noqa: B023
            if now is None or now.key != own:
                if now is not None:
                    yield from now.labels()
                now = _Scope(own)
            now.add(batch.column(len(SCOPE)).slice(at, to - at), batch.column(len(SCOPE) + 1).slice(at, to - at))
            at = to
    if now is not None:
        yield from now.labels()


def communities(symbols: DataFrame, edges: DataFrame, adjacent: DataFrame | None = None) -> DataFrame:
    """(scope, node, label): one group a repository and branch, since the graph never reaches over them. The labels depend on the order of visits, so a group is one task. adjacent: the adjacency, if it is there already."""
    ship(symbols.sparkSession)
    nodes = symbols.where("symbol_fqn is not null and symbol_fqn <> ''").select(*SCOPE, F.col("symbol_fqn").alias("node")).distinct().withColumn("neighbor", F.lit(None).cast("string"))
    rows = nodes.unionByName(adjacency(symbols, edges) if adjacent is None else adjacent)
    rows = rows.select(*(F.col(c).cast("string") for c in SCOPE), "node", "neighbor").repartition(*SCOPE)
    rows = rows.sortWithinPartitions(*SCOPE, F.col("neighbor").isNotNull(), "node")
    return rows.mapInArrow(_labelled, ", ".join(f"{c} string" for c in (*SCOPE, "node", "label")))


def _common_module(names: pd.Series) -> pd.Series:
    def one(fqns) -> str | None:
        shared = os.path.commonprefix([list(f.split(".")) for f in fqns])
        if len(shared) < 2:
            return None
        return ".".join(shared[:-1] if len(shared) > 2 else shared)

    return names.map(one)


def community_rows(symbols: DataFrame, edges: DataFrame, *, min_size: int = MIN_SIZE) -> DataFrame:
    """A row a community of at least min_size: ranked members, representative, label, summary, dominant language."""
    adjacent = cut(adjacency(symbols, edges))
    own = symbols.select(*(F.col(c).cast("string") for c in SCOPE), "repo_path_with_namespace", F.col("symbol_fqn").alias("node"), "symbol_name", "symbol_kind", "language", "docstring", "signature", "definition_file_path", "definition_chunk_id", "definition_url").dropDuplicates([*SCOPE, "node"])
    rows = communities(symbols, edges, adjacent).join(own, [*SCOPE, "node"]).join(degrees(adjacent), [*SCOPE, "node"], "left").fillna({"degree": 0})
    group = W.partitionBy(*SCOPE, "label")
    rows = rows.withColumn("size", F.count("*").over(group)).where(F.col("size") >= min_size)
    rows = rows.withColumn("edge_count", F.floor(F.sum("degree").over(group) / 2)).withColumn("rank", F.row_number().over(group.orderBy(F.desc("degree"), "node"))).where(F.col("rank") <= MAX_MEMBERS)
    doc = F.regexp_extract(F.btrim("docstring"), r"\A([^\r\n]*)", 1)
    line = F.concat(F.lit("- "), "symbol_kind", F.lit(" "), "symbol_name", F.lit(" ("), "node", F.lit(")"), F.when(F.length(doc) > 0, F.concat(F.lit(": "), doc)).when(F.length("signature") > 0, F.concat(F.lit(": "), "signature")).otherwise(""))
    ranked = F.array_sort(F.collect_list(F.struct("rank", "node", "symbol_name", "language", "definition_chunk_id", "definition_url", line.alias("line"))))
    per = rows.groupBy(*SCOPE, "label", "size", "edge_count").agg(F.first("repo_path_with_namespace").alias("repo"), ranked.alias("m"), F.array_sort(F.collect_set("definition_file_path")).alias("files"))
    module = F.pandas_udf(_common_module, "string")
    per = per.withColumn("members", F.transform("m", lambda x: x["node"])).withColumn("module", module("members"))
    head = F.get("m", F.lit(0))
    label = F.when(F.col("module").isNotNull(), F.concat("module", F.lit(" ("), head["symbol_name"], F.lit(" cluster)"))).otherwise(F.concat(head["symbol_name"], F.lit(" cluster")))
    langs = F.filter(F.transform("m", lambda x: x["language"]), lambda x: x.isNotNull() & (x != ""))
    count = lambda x: F.size(F.filter(langs, lambda y: y == x))
    most = F.array_max(F.transform(F.array_distinct(langs), count))
    per = per.withColumn("title", label).withColumn("dominant_language", F.get(F.filter(F.array_distinct(langs), lambda x: count(x) == most), F.lit(0)))
    shown = F.least(F.size("m"), F.lit(SUMMARY_SYMBOLS))
    summary = F.concat_ws(
        "\n",
        F.concat(F.lit("Code community '"), "title", F.lit("' in "), "repo", F.lit(".")),
        F.concat(F.lit("Key symbols ("), shown, F.lit(" shown):")),
        F.array_join(F.transform(F.slice("m", 1, SUMMARY_SYMBOLS), lambda x: x["line"]), "\n"),
        F.when(F.size("files") > 0, F.concat(F.lit("Files: "), F.array_join(F.slice("files", 1, SUMMARY_FILES), ", "))),
    )
    return per.select(
        stable_id("community", F.col("tenant_id"), F.col("gitlab_project_id"), F.col("branch"), head["node"]).alias("community_id"),
        *SCOPE,
        F.col("repo").alias("repo_path_with_namespace"),
        F.col("title").alias("label"),
        summary.alias("summary"),
        "size",
        "edge_count",
        "dominant_language",
        F.col("members").alias("member_symbol_fqns"),
        F.transform("m", lambda x: x["definition_chunk_id"]).alias("member_chunk_ids"),
        F.slice("files", 1, MAX_FILES).alias("member_file_paths"),
        head["definition_chunk_id"].alias("representative_chunk_id"),
        head["definition_url"].alias("representative_url"),
    )
