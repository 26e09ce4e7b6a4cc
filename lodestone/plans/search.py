"""Search for a batch of queries: preparation, legs, fusion, expansion, fusion again, reranking, the best of each.

Rows stay narrow (ids, ranks, scores, flags) until the final cut; texts are joined to what is left. What
a user may not read goes before each cut, not after it. What
both fusions use (each leg, and the first fusion) is a few rows a query and is computed once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import querytext as Q
from lodestone.operators import access, fuse, graph, legs, lexical
from lodestone.operators.vector import DENSE, hash_embedding, knn
from lodestone.scratch import cut, scratch
from lodestone.shipping import ship


def prepare(queries: DataFrame, hypothetical=None) -> DataFrame:
    """queries (query_id, query) with query_type, identifiers, expanded and embedding. Equal texts are embedded once."""
    ship(queries.sparkSession)
    snippet = None if hypothetical is None else hypothetical(F.col("query"))
    texts = queries.select("query").distinct().withColumn("embedding", hash_embedding(DENSE)(Q.with_hypothetical(F.col("query"), snippet)))
    rows = queries.withColumns({"query_type": Q.classify_query(F.col("query")), "identifiers": Q.identifiers(F.col("query")), "expanded": Q.expand_query(F.col("query"))})
    return rows.join(texts, "query")


def search(queries: DataFrame, tables: dict[str, DataFrame], *, permissions: DataFrame | None = None, top_k: int = 8, hops: int = 1) -> DataFrame:
    """Hits (query_id, final_rank, score and the chunk's columns) of queries (query_id, query, and tenant_id, branch, user_id, project_ids where permissions are given).

    tables: chunks, symbols, edges, chunk_vec (chunk_id, dense), and communities if there are any.
    """
    with scratch(queries.sparkSession) as kept:
        return kept(_search(queries, tables, permissions, top_k, hops))


def _search(queries: DataFrame, tables: dict[str, DataFrame], permissions: DataFrame | None, top_k: int, hops: int) -> DataFrame:
    keep = cut
    q = keep(prepare(queries))
    chunks, symbols, edges = tables["chunks"], tables["symbols"], tables["edges"]
    vectors = tables["chunk_vec"]
    granted = of_chunks = of_symbols = of_edges = None
    if permissions is not None:
        granted = keep(access.grants(access.resolve(queries, permissions)))
        of_chunks = access.permit(chunks, granted, "chunk_id", active="active_snapshot")
        of_symbols, of_edges = access.permit(symbols, granted, "symbol_id"), access.permit(edges, granted, "edge_id", project="source_repo_project_id" if "gitlab_project_id" not in edges.columns else "gitlab_project_id")
        vectors = vectors.select("chunk_id", "dense").join(chunks.where("active_snapshot").select("chunk_id", *access.scope_keys(chunks, granted).values()), "chunk_id")
    wanted = q.select("query_id", F.explode("identifiers").alias("identifier"))
    boosts = {f: b for f, b in lexical.CHUNK_BOOSTS.items() if f in chunks.columns}
    words = chunks.withColumns({f: F.translate(F.col(f), "./", "  ") for f in ("symbol_fqn", "file_path") if f in boosts})
    by_text = keep(lexical.bm25_search(words, q, doc_id="chunk_id", query_id="query_id", query="expanded", boosts=boosts, n=2 * top_k, allowed=of_chunks))
    by_vector = knn(vectors, q, max(16 * top_k, 50), vec_id="chunk_id", vec="dense", query_id="query_id", query_vec="embedding", granted=granted)
    by_vector = keep(lexical.top_n(by_vector.drop("rank"), 2 * top_k))
    by_symbol = keep(legs.symbol_search(symbols, chunks, wanted, top_k, of_symbols))
    by_edge = keep(legs.edge_search(edges, chunks, wanted, 2 * top_k, of_edges))
    ranked = [fuse.as_leg(by_symbol, "symbol"), fuse.as_leg(by_edge, "edge"), fuse.as_leg(by_text, "lexical"), fuse.as_leg(by_vector, "vector")]
    first = keep(fuse.rrf(ranked).join(chunks.select("chunk_id", "symbol_fqn"), "chunk_id"))
    more = keep(graph.expand(first, q, edges, symbols, hops=hops, granted=granted, allowed=of_chunks))
    ranked.append(fuse.as_leg(more, "neighbor"))
    payload = legs.chunk_hits(chunks)
    if "communities" in tables:
        ranked.append(fuse.as_leg(legs.community_search(tables["communities"], q, granted=granted), "community"))
        payload = payload.unionByName(legs.community_hits(tables["communities"]))
    fused = fuse.rrf(ranked)
    hits = fused.join(payload.drop("text"), "chunk_id").join(q.select("query_id", "query_type", "identifiers"), "query_id")
    hits = hits.withColumn("score", F.col("score") + fuse.boost(F.col("query_type"), F.col("identifiers"))).drop("identifiers")
    return fuse.final_cut(hits, top_k).join(payload.select("chunk_id", "text"), "chunk_id")
