"""Context texts, citations, grounding gates and extractive answers, per query."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SNIPPET = 2500
MIN_SOURCES, MIN_SCORE, MAX_CONTEXT = 1, 0.0, 12_000
#: What is said when an answer is refused.
NO_HITS = "I could not find relevant indexed code for this question."
TOO_FEW = "I found too few independent source citations to answer this safely (%d found, %d required)."
TOO_LOW = "The retrieved evidence is below the configured relevance threshold."
NO_LINKS = "The retrieved evidence did not include source links."
#: First and last line of an extractive answer.
ANSWER_HEAD = "Grounded answer draft from indexed code:"
ANSWER_TAIL = "The cited source lines are required context for any generated explanation."


def _place(rank: str) -> Column:
    return F.concat(F.col("repo_path_with_namespace"), F.lit(":"), F.col("file_path"), F.lit(":"), F.col("line_start"), F.lit("-"), F.col("line_end"))


def _in_order(rows: DataFrame, rank: str, value: Column, sep: str, name: str) -> DataFrame:
    got = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("r"), value.alias("x"))))
    return rows.groupBy("query_id").agg(F.array_join(F.transform(got, lambda s: s["x"]), sep).alias(name))


def context(hits: DataFrame, rank: str = "final_rank") -> DataFrame:
    """(query_id, context): numbered blocks of place, source and snippet. Hits of a query are few (top_k)."""
    text = F.when(F.char_length("text") > SNIPPET, F.concat(F.regexp_replace(F.substring("text", 1, SNIPPET), r"\s+\z", ""), F.lit("\n..."))).otherwise(F.col("text"))
    block = F.concat_ws("\n", F.concat(F.lit("["), F.col(rank), F.lit("] "), _place(rank)), F.concat(F.lit("Source: "), F.coalesce("blob_url", F.lit(""))), text)
    return _in_order(hits, rank, block, "\n\n---\n\n", "context")


def citations(hits: DataFrame, rank: str = "final_rank") -> DataFrame:
    return hits.select("query_id", F.col(rank).alias("index"), "repo_path_with_namespace", "file_path", "line_start", "line_end", "blob_url")


def grounding(queries: DataFrame, hits: DataFrame, *, min_sources: int = MIN_SOURCES, min_score: float = MIN_SCORE) -> DataFrame:
    """(query_id, n_hits, max_score, source_coverage, refusal): refusal is null for a grounded answer."""
    linked = F.when(F.coalesce(F.length("blob_url"), F.lit(0)) > 0, 1.0).otherwise(0.0)
    per = hits.groupBy("query_id").agg(F.count("*").alias("n_hits"), F.max("score").alias("max_score"), F.avg(linked).alias("source_coverage"))
    rows = queries.select("query_id").distinct().join(per, "query_id", "left").fillna({"n_hits": 0, "source_coverage": 0.0})
    few = F.format_string(TOO_FEW, F.col("n_hits"), F.lit(min_sources))
    refusal = F.when(F.col("n_hits") == 0, NO_HITS).when(F.col("n_hits") < min_sources, few).when(F.col("max_score") < min_score, TOO_LOW).when(F.col("source_coverage") <= 0, NO_LINKS)
    return rows.withColumn("refusal", refusal)


def extractive_answer(queries: DataFrame, hits: DataFrame, rank: str = "final_rank", **gates) -> DataFrame:
    """(query_id, answer, grounded): bullet lines of the first five hits, or the refusal."""
    name = F.when(F.coalesce(F.length("symbol_name"), F.lit(0)) > 0, F.concat(F.lit(" `"), F.col("symbol_name"), F.lit("`"))).otherwise("")
    line = F.concat(F.lit("- Source ["), F.col(rank), F.lit("] points to "), F.col("repo_path_with_namespace"), F.lit("/"), F.col("file_path"), F.lit(":"), F.col("line_start"), F.lit("-"), F.col("line_end"), name, F.lit("."))
    body = _in_order(hits.where(F.col(rank) <= 5), rank, line, "\n", "body")
    gate = grounding(queries, hits, **gates).join(body, "query_id", "left")
    return gate.select("query_id", F.coalesce("refusal", F.concat_ws("\n", F.lit(ANSWER_HEAD), "body", F.lit(ANSWER_TAIL))).alias("answer"), F.col("refusal").isNull().alias("grounded"))


def answer_context(context: Column, max_chars: int = MAX_CONTEXT) -> Column:
    return F.substring(context, 1, max_chars)


def model_answer(queries: DataFrame, hits: DataFrame, model: Callable[[list[tuple[str, str]]], list[str | None]], rank: str = "final_rank", *, batch: int = 16, **gates) -> DataFrame:
    """(query_id, answer, grounded) by a model given lists of (query, context), cut to size. Queries that the gates refuse never reach it; where it fails or says nothing, the extractive answer stands.

    queries: query_id, query.
    """
    plain = extractive_answer(queries, hits, rank, **gates)
    asked = queries.select("query_id", "query").join(context(hits, rank), "query_id").join(plain.where("grounded").select("query_id"), "query_id", "left_semi").select("query_id", "query", answer_context(F.col("context")).alias("context"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            said: list[str | None] = []
            for a in range(0, len(frame), batch):
                part = frame.iloc[a : a + batch]
                try:
                    got = list(model(list(zip(part["query"], part["context"], strict=True))))
                except Exception:  # a model that can't be reached answers nothing
                    got = []
                said += got if len(got) == len(part) else [None] * len(part)
            yield pd.DataFrame({"query_id": frame["query_id"], "said": said})

    replies = asked.mapInPandas(run, f"query_id {dict(queries.dtypes)['query_id']}, said string")
    return plain.join(replies, "query_id", "left").select("query_id", F.coalesce(F.nullif(F.btrim("said"), F.lit("")), "answer").alias("answer"), "grounded")
