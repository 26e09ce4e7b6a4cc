"""Queries that score and rank: BM25, nearest neighbours, late interaction, fusion, reranking, answers, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.operators import assemble, evaluate, fuse, vector
from lodestone.operators.lexical import Allowed, bm25_search
from lodestone.plans.book import Book, table
from lodestone.scratch import cut, scratch, small

BOOK = Book()
TOP = 10
BM25_SQL = """d AS (SELECT doc_id, source, lang, text, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS ts FROM documents),
st AS (SELECT count(*)::DOUBLE AS n, avg(len(ts)) AS avgdl FROM d),
tf AS (SELECT doc_id, len(ts) AS dl, t, count(*) AS tf FROM (SELECT doc_id, ts, unnest(ts) AS t FROM d) GROUP BY doc_id, dl, t),
df AS (SELECT t, count(*) AS df FROM tf GROUP BY t),
q AS (SELECT item_id, t, count(*) AS qtf FROM (SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS t FROM benchmark) GROUP BY item_id, t),
sc AS (SELECT q.item_id, tf.doc_id, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl)))) * 3 AS score FROM q JOIN tf USING (t) JOIN df USING (t), st GROUP BY q.item_id, tf.doc_id),
rk AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc)"""


def _hits(spark: SparkSession, sf_dir: str, n: int = TOP, allowed: Allowed = None) -> DataFrame:
    return bm25_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), doc_id="doc_id", query_id="item_id", query="text", boosts={"text": 3.0}, n=n, allowed=allowed)


@BOOK.query(f"WITH {BM25_SQL} SELECT item_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM rk WHERE rank <= {TOP}")
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _hits(spark, sf_dir).select(F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@BOOK.query(
    f"WITH {BM25_SQL}, g AS (SELECT item_id, doc_id FROM benchmark JOIN documents ON item_id % 20 = substr(source, 4)::INT % 20 OR item_id % 20 = (substr(source, 4)::INT + 1) % 20), "
    f"r2 AS (SELECT sc.*, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM sc JOIN g USING (item_id, doc_id)) SELECT item_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM r2 WHERE rank <= {TOP}"
)
def filtered_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of all documents; a query sees two sources only."""
    n = F.substring("source", 4, 10).cast("int")
    scope = F.array(n % 20, (n + 1) % 20)
    granted = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), (F.col("item_id") % 20).cast("int").alias("scope"))

    def allowed(scored: DataFrame) -> DataFrame:
        own = table(spark, sf_dir, "documents").select("doc_id", F.explode(scope).alias("scope")).distinct()
        return scored.join(granted.join(own, "scope").select("query_id", "doc_id"), ["query_id", "doc_id"], "left_semi")

    allowed.scope, allowed.granted = scope, granted
    return _hits(spark, sf_dir, allowed=allowed).select(F.col("query_id").alias("item_id"), "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


KNN_SQL = """v AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
n AS (SELECT a.vec_id AS query_id, b.vec_id AS doc_id, a.label = b.label AS same, round(list_cosine_similarity(a.e, b.e), 12) AS score FROM v a, v b),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM n)"""


def _knn(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return vector.knn(e, e, n, vec_id="vec_id", vec="embedding", query_id="vec_id", query_vec="embedding")


@BOOK.query(f"WITH {KNN_SQL} SELECT query_id, doc_id, rank::INT AS rank, round(score, 6) AS score FROM k WHERE rank <= 5")
def knn_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _knn(spark, sf_dir, 5).select("query_id", "doc_id", F.col("rank").cast("int").alias("rank"), F.round("score", 6).alias("score"))


@BOOK.query(f"WITH {KNN_SQL} SELECT v.label, round(avg(same::INT), 6) AS recall FROM k JOIN v ON v.vec_id = query_id WHERE rank BETWEEN 2 AND 6 GROUP BY v.label")
def knn_label_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    near = _knn(spark, sf_dir, 6).where("rank between 2 and 6")
    both = near.join(labels.select(F.col("vec_id").alias("query_id"), "label"), "query_id").join(labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("other")), "doc_id")
    return both.groupBy("label").agg(F.round(F.avg((F.col("label") == F.col("other")).cast("double")), 6).alias("recall"))


@BOOK.query(
    """WITH v AS (SELECT vec_id, i, list_transform(embedding[i * 8 + 1:i * 8 + 8], lambda x: x::DOUBLE) AS p FROM embeddings, unnest(range(8)) AS u(i)),
m AS (SELECT a.vec_id, a.i, max(list_dot_product(a.p, b.p)) AS best FROM v a JOIN v b ON b.vec_id = a.vec_id + 1 GROUP BY a.vec_id, a.i)
SELECT vec_id, round(avg(best), 6) AS maxsim, round(least(avg(best), 1.0) * 0.1, 6) AS boost FROM m GROUP BY vec_id"""
)
def maxsim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late interaction of each vector with its successor, each taken as eight vectors of eight numbers."""
    parts = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.slice(F.col("embedding").cast("array<double>"), i * 8 + 1, F.lit(8)))
    e = table(spark, sf_dir, "embeddings").select("vec_id", parts.alias("p"))
    pair = e.join(e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("p").alias("r")), "vec_id")
    sim = vector.maxsim(F.col("p"), F.col("r"))
    return pair.select("vec_id", F.round(sim, 6).alias("maxsim"), F.round(F.least(sim, F.lit(1.0)) * fuse.BOOSTS["late"], 6).alias("boost"))


LEGS_SQL = """l0 AS (SELECT source AS query_id, doc_id AS chunk_id, 0 AS leg, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
l1 AS (SELECT source AS query_id, doc_id AS chunk_id, 2 AS leg, row_number() OVER (PARTITION BY source ORDER BY sha256(doc_id::VARCHAR)) AS rank FROM documents QUALIFY rank <= 20),
l2 AS (SELECT source AS query_id, doc_id AS chunk_id, 3 AS leg, row_number() OVER (PARTITION BY source ORDER BY n_chars, doc_id) AS rank FROM documents QUALIFY rank <= 20)"""


def _legs(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("chunk_id"), "n_chars")
    orders = {"symbol": [F.desc("n_chars"), "chunk_id"], "lexical": [F.sha2(F.col("chunk_id").cast("string"), 256)], "vector": ["n_chars", "chunk_id"]}
    return [fuse.as_leg(docs.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*o))).where("rank <= 20"), leg) for leg, o in orders.items()]


@BOOK.query(
    f"WITH {LEGS_SQL}, u AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2), f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(leg * 1000 + rank) AS first FROM u GROUP BY query_id, chunk_id) "
    "SELECT query_id, chunk_id, round(score, 9) AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, chunk_id)::INT AS rank FROM f"
)
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fuse.rrf(_legs(spark, sf_dir)).select("query_id", "chunk_id", F.round("score", 9).alias("score"), F.col("rank").cast("int").alias("rank"))


@BOOK.query(
    f"""WITH {LEGS_SQL}, u AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1 UNION ALL SELECT * FROM l2),
f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(leg * 1000 + rank) AS first FROM u GROUP BY query_id, chunk_id),
p AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, chunk_id) AS rank FROM f),
nb AS (SELECT query_id, doc_id AS chunk_id, 4 AS leg, row_number() OVER (PARTITION BY query_id ORDER BY p.rank, doc_id) AS rank FROM p JOIN documents d ON d.source = p.query_id AND d.doc_id = p.chunk_id + 20 WHERE p.rank <= 5),
u2 AS (SELECT * FROM u UNION ALL SELECT * FROM nb),
f2 AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank)) AS score, min(leg * 1000 + rank) AS first, min(leg) = 4 AS graph_expanded FROM u2 GROUP BY query_id, chunk_id)
SELECT query_id, chunk_id, round(score, 9) AS score, graph_expanded, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, first, chunk_id)::INT AS rank FROM f2"""
)
def rrf_two_pass(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fusion's best five bring in a neighbour each, and all is fused again."""
    ranked = _legs(spark, sf_dir)
    first = fuse.rrf(ranked).where("rank <= 5")
    docs = table(spark, sf_dir, "documents").select(F.col("source").alias("query_id"), F.col("doc_id").alias("other"))
    near = first.select("query_id", (F.col("chunk_id") + 20).alias("other"), F.col("rank").alias("r")).join(docs, ["query_id", "other"])
    near = near.select("query_id", F.col("other").alias("chunk_id"), F.row_number().over(W.partitionBy("query_id").orderBy("r", "other")).alias("rank"))
    out = fuse.rrf([*ranked, fuse.as_leg(near, "neighbor")])
    return out.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "graph_expanded", F.col("rank").cast("int").alias("rank"))


TYPES = ["definition_lookup", "usage_lookup", "test_question", "config_question", "architecture_question"]


def _payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as hits of queries: a source is a query, the id sets kind, role and flags."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars", "text")
    pick = lambda xs, n: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("doc_id") % n + 1).cast("int"))
    return d.select(
        F.col("source").alias("query_id"),
        F.col("doc_id").alias("chunk_id"),
        F.concat(F.lit("group/"), "source").alias("repo_path_with_namespace"),
        F.concat(pick(["src/", "tests/", "docs/"], 3), F.lit("Doc"), F.col("doc_id"), F.lit(".py")).alias("file_path"),
        F.lit(1).alias("line_start"),
        (F.col("n_chars") % 50 + 1).alias("line_end"),
        F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("Sym"), F.col("doc_id"))).alias("symbol_name"),
        F.when(F.col("doc_id") % 4 > 0, F.concat(F.lit("group.Sym"), F.col("doc_id"))).alias("symbol_fqn"),
        F.when(F.col("doc_id") % 4 > 0, "definition").otherwise("none").alias("symbol_role"),
        pick(["function_definition", "test_case", "community_summary", "file", "config_block"], 5).alias("chunk_kind"),
        F.when(F.col("doc_id") % 7 > 0, F.concat(F.lit("https://git.example.com/"), F.col("doc_id"))).otherwise("").alias("blob_url"),
        "text",
        (F.col("doc_id") % 3 == 0).alias("edge_match"),
        (F.col("doc_id") % 6 == 0).alias("graph_expanded"),
        (1.0 / (60 + F.col("n_chars") % 97)).alias("score"),
        F.row_number().over(W.partitionBy("source").orderBy(F.col("n_chars") % 97, "doc_id")).alias("rank"),
    )


PAYLOAD_SQL = """h AS (SELECT source AS query_id, doc_id AS chunk_id, 'group/' || source AS repo, ['src/', 'tests/', 'docs/'][(doc_id % 3 + 1)::INT] || 'Doc' || doc_id || '.py' AS path, n_chars % 50 + 1 AS line_end,
CASE WHEN doc_id % 4 > 0 THEN 'Sym' || doc_id END AS sym, CASE WHEN doc_id % 4 > 0 THEN 'group.Sym' || doc_id END AS fqn, CASE WHEN doc_id % 4 > 0 THEN 'definition' ELSE 'none' END AS role,
['function_definition', 'test_case', 'community_summary', 'file', 'config_block'][(doc_id % 5 + 1)::INT] AS kind, CASE WHEN doc_id % 7 > 0 THEN 'https://git.example.com/' || doc_id ELSE '' END AS url, text,
doc_id % 3 = 0 AS edge_match, doc_id % 6 = 0 AS graph_expanded, 1.0::DOUBLE / (60 + n_chars % 97) AS score, row_number() OVER (PARTITION BY source ORDER BY n_chars % 97, doc_id) AS rank,
['definition_lookup', 'usage_lookup', 'test_question', 'config_question', 'architecture_question'][(substr(source, 4)::INT % 5 + 1)::INT] AS qtype FROM documents)"""


@BOOK.query(
    f"""WITH {PAYLOAD_SQL}, b AS (SELECT *, score + CASE WHEN contains(lower(coalesce(sym, '') || ' ' || coalesce(fqn, '') || ' ' || path || ' ' || repo), 'sym1') OR contains(lower(path), 'doc22') THEN 0.15::DOUBLE ELSE 0 END
+ CASE WHEN qtype = 'definition_lookup' AND role = 'definition' THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN qtype = 'usage_lookup' AND edge_match THEN 0.2::DOUBLE ELSE 0 END
+ CASE WHEN qtype = 'test_question' AND (contains(path, 'test') OR kind = 'test_case') THEN 0.15::DOUBLE ELSE 0 END + CASE WHEN qtype = 'config_question' AND role = 'none' THEN 0.05::DOUBLE ELSE 0 END
+ CASE WHEN graph_expanded THEN 0.05::DOUBLE ELSE 0 END + CASE WHEN kind = 'community_summary' THEN 0.1::DOUBLE ELSE 0 END AS s FROM h),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 12) DESC, rank, chunk_id) AS final_rank FROM b) SELECT query_id, chunk_id, final_rank::INT AS final_rank, round(s, 6) AS score FROM r WHERE final_rank <= 8"""
)
def rerank_boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.element_at(F.array(*(F.lit(t) for t in TYPES)), (F.substring("query_id", 4, 9).cast("int") % 5 + 1).cast("int"))
    hits = _payload(spark, sf_dir).withColumn("score", F.col("score") + fuse.boost(kind, F.array(F.lit("Sym1"), F.lit("Doc22"))))
    return fuse.final_cut(hits, 8).select("query_id", "chunk_id", F.col("final_rank").cast("int").alias("final_rank"), F.round("score", 6).alias("score"))


@BOOK.query(
    f"""WITH {PAYLOAD_SQL}, c AS (SELECT *, CASE WHEN rank <= 30 THEN (length(text) % 11)::DOUBLE END AS raw FROM h),
m AS (SELECT *, min(raw) OVER (PARTITION BY query_id) AS lo, max(raw) OVER (PARTITION BY query_id) AS hi FROM c)
SELECT query_id, chunk_id, round(score + CASE WHEN rank <= 30 THEN (raw - lo) / CASE WHEN hi = lo THEN 1 ELSE hi - lo END ELSE 0 END, 6) AS score FROM m"""
)
def minmax_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _payload(spark, sf_dir).withColumn("cross_score", (F.char_length("text") % 11).cast("double"))
    return fuse.blend_cross_encoder(hits).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


@BOOK.query(
    f"""WITH {PAYLOAD_SQL} SELECT query_id, sha256(string_agg('[' || rank || '] ' || repo || ':' || path || ':1-' || line_end || chr(10) || 'Source: ' || url || chr(10) ||
CASE WHEN length(text) > 2500 THEN regexp_replace(text[1:2500], '\\s+\\z', '') || chr(10) || '...' ELSE text END, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context_sha256 FROM h WHERE rank <= 8 GROUP BY query_id"""
)
def context_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = assemble.context(_payload(spark, sf_dir).where("rank <= 8"), "rank")
    return got.select("query_id", F.sha2(F.col("context").cast("binary"), 256).alias("context_sha256"))


_GATE_SQL = f"""g AS (SELECT b.query_id, count(h.chunk_id) AS n, max(h.score) AS top, coalesce(avg((h.url <> '')::INT), 0) AS cov FROM (SELECT DISTINCT query_id FROM h UNION SELECT 'none') b
LEFT JOIN (SELECT * FROM h WHERE rank <= chunk_id % 3 + 1) h USING (query_id) GROUP BY b.query_id),
r AS (SELECT *, CASE WHEN n = 0 THEN '{assemble.NO_HITS}' WHEN n < 2 THEN 'I found too few independent source citations to answer this safely (' || n || ' found, 2 required).'
WHEN top < 0.0162 THEN '{assemble.TOO_LOW}' WHEN cov <= 0 THEN '{assemble.NO_LINKS}' END AS refusal FROM g)"""


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    hits = _payload(spark, sf_dir)
    queries = hits.select("query_id").distinct().union(spark.createDataFrame([("none",)], "query_id string"))
    return queries, hits.where(F.col("rank") <= F.col("chunk_id") % 3 + 1)


@BOOK.query(f"WITH {PAYLOAD_SQL}, {_GATE_SQL} SELECT query_id, n AS n_hits, round(cov, 6) AS source_coverage, refusal FROM r")
def refusal_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, hits = _gated(spark, sf_dir)
    return assemble.grounding(queries, hits, min_sources=2, min_score=0.0162).select("query_id", "n_hits", F.round("source_coverage", 6).alias("source_coverage"), "refusal")


@BOOK.query(
    f"""WITH {PAYLOAD_SQL}, {_GATE_SQL}, b AS (SELECT query_id, string_agg('- Source [' || rank || '] points to ' || repo || '/' || path || ':1-' || line_end || CASE WHEN sym IS NULL THEN '' ELSE ' `' || sym || '`' END || '.', chr(10) ORDER BY rank) AS body
FROM h WHERE rank <= chunk_id % 3 + 1 AND rank <= 5 GROUP BY query_id)
SELECT query_id, refusal IS NULL AS grounded, coalesce(refusal, '{assemble.ANSWER_HEAD}' || chr(10) || body || chr(10) || '{assemble.ANSWER_TAIL}') AS answer FROM r LEFT JOIN b USING (query_id)"""
)
def extractive_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, hits = _gated(spark, sf_dir)
    return assemble.extractive_answer(queries, hits, "rank", min_sources=2, min_score=0.0162).select("query_id", "grounded", "answer")


GOLD_SQL = f"""{BM25_SQL}, gold AS (SELECT b.item_id, list(d.doc_id) AS relevant FROM benchmark b JOIN documents d ON contains(d.text, b.text) GROUP BY b.item_id),
top AS (SELECT rk.*, list_contains(relevant, doc_id) AS rel, len(relevant) AS nrel FROM rk JOIN gold USING (item_id) WHERE rank <= {TOP}),
per AS (SELECT item_id, nrel, count(*) AS returned, sum(rel::INT) AS hit, min(CASE WHEN rel THEN rank END) AS first, sum(CASE WHEN rel THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg FROM top GROUP BY item_id, nrel),
cs AS (SELECT item_id, hit / nrel AS recall_at_k, hit / {TOP} AS precision_at_k, coalesce(1.0::DOUBLE / first, 0) AS mrr, dcg / list_sum(list_transform(range(1, (least(nrel, returned) + 1)::BIGINT), lambda i: 1 / log2(i + 1))) AS ndcg_at_k, (hit > 0)::INT::DOUBLE AS hit_at_k, nrel FROM per)"""


def _cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items whose whole text stands in documents; those documents are relevant."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    gold = cut(evaluate.holders(docs, items, doc_id="doc_id", case_id="item_id").distinct())
    hits = _hits(spark, sf_dir).select(F.col("query_id").alias("case_id"), "rank", "doc_id")
    found = gold.join(small(hits.select("case_id", "doc_id")), ["case_id", "doc_id"], "left_semi").withColumn("is_rel", F.lit(True))
    hits = hits.join(small(cut(found)), ["case_id", "doc_id"], "left").withColumn("is_rel", F.coalesce("is_rel", F.lit(False)))
    return evaluate.score_cases(gold.groupBy("case_id").agg(F.count("doc_id").cast("int").alias("num_relevant")), hits, TOP)


@BOOK.query()
def search_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search: documents ingested as files of their sources, every benchmark item a query of a user who may read two sources."""
    from lodestone.plans import ingest, search
    from lodestone.plans.queries_text import as_files

    with scratch(spark) as keep:
        made = ingest.ingest(as_files(table(spark, sf_dir, "documents")), settle=cut)
        tables = {n: cut(made[n]) for n in ("symbols", "edges")} | {"chunks": made["chunks"]}
        tables["chunk_vec"] = cut(made["chunks"].select("chunk_id", vector.hash_embedding(vector.DENSE)(F.col("text")).alias("dense")))
        items = table(spark, sf_dir, "benchmark")
        user = F.concat(F.lit("u"), F.col("item_id") % 20)
        queries = items.select(F.col("item_id").alias("query_id"), F.col("text").alias("query"), F.lit("default").alias("tenant_id"), F.lit("main").alias("branch"), user.alias("user_id"), F.lit(None).cast("array<string>").alias("project_ids"))
        perms = spark.range(20).select(F.lit("default").alias("tenant_id"), F.concat(F.lit("u"), "id").alias("user_id"), F.array(F.concat(F.lit("src"), "id"), F.concat(F.lit("src"), (F.col("id") + 1) % 20)).alias("accessible_project_ids"))
        hits = search.search(queries, tables, permissions=perms)
        return keep(hits.select("query_id", "final_rank", "chunk_id", "file_path", "line_start", "line_end", F.round("score", 6).alias("score")))


@BOOK.query(f"WITH {GOLD_SQL} SELECT item_id AS case_id, round(recall_at_k, 6) AS recall_at_k, round(precision_at_k, 6) AS precision_at_k, round(mrr, 6) AS mrr, round(ndcg_at_k, 6) AS ndcg_at_k, hit_at_k, nrel::INT AS num_relevant FROM cs")
def eval_per_case(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _cases(spark, sf_dir)
    return rows.select("case_id", *(F.round(m, 6).alias(m) for m in evaluate.METRICS[:4]), "hit_at_k", "num_relevant")


@BOOK.query(f"WITH {GOLD_SQL} SELECT " + ", ".join(f"round(avg({m}), 6) AS {m}" for m in evaluate.METRICS) + ", count(*) AS num_cases FROM cs")
def eval_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = evaluate.macro(_cases(spark, sf_dir))
    return got.select(*(F.round(m, 6).alias(m) for m in evaluate.METRICS), "num_cases")
