"""Reciprocal rank fusion, heuristic reranking, late-interaction and cross-encoder blending, and the final cut."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

RRF_K = 60
#: Places of the legs in the order of fusion.
LEGS = {"symbol": 0, "edge": 1, "lexical": 2, "vector": 3, "neighbor": 4, "community": 5}
#: Boosts of the reranker.
BOOSTS = {"identifier": 0.15, "definition": 0.2, "usage": 0.2, "test": 0.15, "config": 0.05, "graph": 0.05, "community": 0.1, "late": 0.1}
CROSS_CANDIDATES, CROSS_WEIGHT = 30, 1.0
FLAGS = ("edge_match", "graph_expanded", "is_community")


def as_leg(hits: DataFrame, leg: str) -> DataFrame:
    """(query_id, chunk_id, leg, rank, flags): a leg's rows as fusion takes them."""
    flags = [F.coalesce(F.col(f), F.lit(False)).alias(f) if f in hits.columns else F.lit(f == "graph_expanded" and leg == "neighbor" or f == "is_community" and leg == "community").alias(f) for f in FLAGS]
    key = "chunk_id" if "chunk_id" in hits.columns else "doc_id"
    return hits.select("query_id", F.col(key).alias("chunk_id"), F.lit(LEGS[leg]).alias("leg"), "rank", *flags)


def rrf(legs: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(query_id, chunk_id, score, rank, flags): the sum of 1 / (k + rank); flags come from the first leg that has the chunk, and equal scores keep the order in which chunks were first seen."""
    rows = legs[0]
    for leg in legs[1:]:
        rows = rows.unionByName(leg)
    first = F.min(F.struct("leg", "rank", *FLAGS)).alias("first")
    fused = rows.groupBy("query_id", "chunk_id").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"), first)
    order = W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "first.leg", "first.rank", "chunk_id")
    return fused.withColumn("rank", F.row_number().over(order)).select("query_id", "chunk_id", "score", "rank", *(f"first.{f}" for f in FLAGS))


def boost(query_type: Column, identifiers: Column, late: Column | None = None) -> Column:
    """What the reranker adds to a hit's score. The frame holds the hit's columns and flags."""
    hay = F.lower(F.concat_ws(" ", F.coalesce("symbol_name", F.lit("")), F.coalesce("symbol_fqn", F.lit("")), "file_path", "repo_path_with_namespace"))
    add = lambda when, name: F.when(F.coalesce(when, F.lit(False)), BOOSTS[name]).otherwise(0.0)
    out = add(F.exists(identifiers, lambda x: F.contains(hay, F.lower(x))), "identifier")
    out = out + add((query_type == "definition_lookup") & (F.col("symbol_role") == "definition"), "definition")
    out = out + add((query_type == "usage_lookup") & F.col("edge_match"), "usage")
    out = out + add((query_type == "test_question") & (F.lower("file_path").contains("test") | (F.col("chunk_kind") == "test_case")), "test")
    out = out + add(query_type.isin("config_question", "deployment_question") & (F.col("symbol_role") == "none"), "config")
    out = out + add(F.col("graph_expanded"), "graph") + add(F.col("chunk_kind") == "community_summary", "community")
    return out if late is None else out + F.least(late, F.lit(1.0)) * BOOSTS["late"]


def blend_cross_encoder(hits: DataFrame, raw: str = "cross_score", *, candidates: int = CROSS_CANDIDATES, weight: float = CROSS_WEIGHT) -> DataFrame:
    """Adds the min-max normalised scores of the first candidates in fused order; a query with a missing one is left as it is."""
    first = F.col("rank") <= candidates
    over = W.partitionBy("query_id")
    low, high = F.min(F.when(first, F.col(raw))).over(over), F.max(F.when(first, F.col(raw))).over(over)
    whole = F.sum(F.when(first & F.col(raw).isNull(), 1).otherwise(0)).over(over) == 0
    span = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    return hits.withColumn("score", F.col("score") + F.when(first & whole, F.lit(weight) * (F.col(raw) - low) / span).otherwise(0.0))


def parse_cross_encoder_reply(reply: object) -> list[float]:
    """Scores of a reranker's answer: a list, or its scores, results or data; items may be numbers or hold score or relevance. One bad item makes it empty."""
    if isinstance(reply, dict):
        reply = next((reply[k] for k in ("scores", "results", "data") if k in reply), None)
    if not isinstance(reply, list):
        return []
    out = []
    for item in reply:
        if isinstance(item, dict):
            item = item.get("score", item.get("relevance"))
        if isinstance(item, bool) or not isinstance(item, int | float):
            return []
        out.append(float(item))
    return out


def final_cut(hits: DataFrame, top_k: Column | int) -> DataFrame:
    """The top_k of each query by score, equal ones in fused order, with final_rank from 1."""
    order = W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), "rank", "chunk_id")
    return hits.withColumn("final_rank", F.row_number().over(order)).where(F.col("final_rank") <= top_k)
