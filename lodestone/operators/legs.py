"""Retrieval legs beside the plain lexical and vector ones: symbols, edges, communities, and their projections to hits.

Every leg returns narrow rows (query_id, chunk_id, score, rank, flags). An OR of key columns is written
as a union of equi-joins, never as an OR condition, which would force a nested loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators import lexical as L
from lodestone.operators.access import permit
from lodestone.operators.vector import knn
from lodestone.scratch import scratch


def exact_matches(rows: DataFrame, wanted: DataFrame, keys: list[str], row_id: str) -> DataFrame:
    """(query_id, doc_id, score): one point for each of the keys that equals one of the query's identifiers."""
    out = None
    for key in keys:
        hit = rows.select(F.col(row_id).alias("doc_id"), F.col(key).alias("identifier")).join(wanted, "identifier").select("query_id", "doc_id").distinct().withColumn("score", F.lit(1.0))
        out = hit if out is None else out.unionByName(hit)
    return out.groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))


def keyed_search(rows: DataFrame, wanted: DataFrame, *, row_id: str, keys: list[str], boosts: dict[str, float], n: int, chunk: str | None = None, allowed: L.Allowed = None) -> DataFrame:
    """Exact and BM25 scores of a batch of identifiers (query_id, identifier), summed; at least one must match.

    allowed, applied before the cut: (query_id, chunk_id) of the chunks that rows may stand for, or a function that filters (query_id, doc_id, ...).
    """
    analysed = rows.withColumns({f: F.translate(F.col(f), "./", "  ") for f in boosts if f in rows.columns})
    fields = {f: b for f, b in boosts.items() if f in rows.columns}
    text = wanted.groupBy("query_id").agg(F.array_join(F.array_sort(F.collect_set("identifier")), " ").alias("text")).withColumn("text", F.translate("text", "./", "  "))
    with scratch(rows.sparkSession) as keep:
        scored = L.bm25_scores(analysed, L.query_terms(text, "query_id", "text"), fields, doc_id=row_id)
        both = scored.unionByName(exact_matches(rows, wanted, keys, row_id)).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
        if allowed is not None and not callable(allowed):
            both = both.join(rows.select(F.col(row_id).alias("doc_id"), F.col(chunk).alias("chunk_id")), "doc_id").join(allowed, ["query_id", "chunk_id"], "left_semi").drop("chunk_id")
        else:
            both = L.permitted(both, allowed)
        return keep(L.top_n(both, n))


def symbol_search(symbols: DataFrame, chunks: DataFrame, wanted: DataFrame, n: int, allowed: L.Allowed = None) -> DataFrame:
    """Chunks that define the symbols found, in the order of the symbols' scores."""
    found = keyed_search(symbols, wanted, row_id="symbol_id", keys=["symbol_name", "symbol_fqn"], boosts=L.SYMBOL_BOOSTS, n=n, chunk="definition_chunk_id", allowed=allowed)
    own = found.join(symbols.select(F.col("symbol_id").alias("doc_id"), F.col("definition_chunk_id").alias("chunk_id")), "doc_id")
    best = own.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return L.top_n(best, n, id_col="chunk_id")


def edge_search(edges: DataFrame, chunks: DataFrame, wanted: DataFrame, n: int, allowed: L.Allowed = None) -> DataFrame:
    """Chunks that the edges found start from, flagged edge_match."""
    found = keyed_search(edges, wanted, row_id="edge_id", keys=["source_symbol_fqn", "target_symbol_fqn"], boosts=L.EDGE_BOOSTS, n=n, chunk="source_chunk_id", allowed=allowed)
    own = found.join(edges.select(F.col("edge_id").alias("doc_id"), F.col("source_chunk_id").alias("chunk_id")), "doc_id")
    best = own.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score")).join(chunks.select("chunk_id"), "chunk_id", "left_semi")
    return L.top_n(best, n, id_col="chunk_id").withColumn("edge_match", F.lit(True))


def community_search(communities: DataFrame, queries: DataFrame, n: int = 3, granted: DataFrame | None = None) -> DataFrame:
    """BM25 over summary and label plus (1 + cosine) / 2, summed. queries: query_id, query, embedding. granted, rows of (query_id, tenant_id, branch, project_id): a query meets the communities of these projects alone."""
    with scratch(communities.sparkSession) as keep:
        scored = L.bm25_scores(communities, L.query_terms(queries, "query_id", "query"), L.COMMUNITY_BOOSTS, doc_id="community_id")
        allowed = None if granted is None else permit(communities, granted, "community_id")
        near = knn(communities, queries, max(8 * n, 50), vec_id="community_id", vec="embedding_dense", query_id="query_id", query_vec="embedding", granted=granted).select("query_id", "doc_id", ((1 + F.col("score")) / 2).alias("score"))
        both = L.permitted(scored, allowed).unionByName(near).groupBy("query_id", "doc_id").agg(F.sum("score").alias("score"))
        return keep(L.top_n(both, n))


def community_hits(communities: DataFrame) -> DataFrame:
    """A synthetic hit a community: its summary stands for a text, its first member's file for a path."""
    return communities.select(
        F.col("community_id").alias("chunk_id"),
        "repo_path_with_namespace",
        F.get("member_file_paths", F.lit(0)).alias("file_path"),
        F.lit(0).alias("line_start"),
        F.lit(0).alias("line_end"),
        F.col("dominant_language").alias("language"),
        F.lit("community_summary").alias("chunk_kind"),
        F.col("label").alias("symbol_name"),
        F.lit(None).cast("string").alias("symbol_fqn"),
        F.col("representative_url").alias("blob_url"),
        F.col("summary").alias("text"),
        F.lit("none").alias("symbol_role"),
    )


HIT_COLUMNS = ["chunk_id", "repo_path_with_namespace", "file_path", "line_start", "line_end", "language", "chunk_kind", "symbol_name", "symbol_fqn", "blob_url", "text", "symbol_role"]


def chunk_hits(chunks: DataFrame) -> DataFrame:
    """The columns of a hit that come from its chunk."""
    return chunks.select(*HIT_COLUMNS)
