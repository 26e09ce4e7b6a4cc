"""Queries over the code graph, taken from suppliers and parts, and over access and maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import access, graph, vector
from lodestone.plans import ingest
from lodestone.plans.book import Book, table
from lodestone.sources import files as files_
from lodestone.sources import tables as T
from lodestone.streaming import incremental

BOOK = Book()

# a supplier is a function, a part a class; an order line calls from its supplier to its part, by its qualified name, its short name, or an unknown one
GRAPH_SQL = """sy AS (SELECT 'r' || (s_suppkey % 5) AS prj, 'shop.r' || (s_suppkey % 5) || '.S' || s_suppkey AS fqn FROM supplier UNION ALL SELECT 'r' || (p_partkey % 5), 'shop.r' || (p_partkey % 5) || '.P' || (p_partkey // 2) FROM part),
ks AS (SELECT DISTINCT prj, fqn FROM sy),
ed AS (SELECT DISTINCT 'r' || (l_suppkey % 5) AS prj, 'shop.r' || (l_suppkey % 5) || '.S' || l_suppkey AS src, CASE l_linenumber % 3 WHEN 0 THEN 'shop.r' || (l_suppkey % 5) || '.P' || (l_partkey // 2) WHEN 1 THEN 'x.P' || (l_partkey // 2) ELSE 'lib.Q' || l_partkey END AS raw FROM lineitem),
al AS (SELECT prj, regexp_extract(fqn, '[^.]*$') AS short, count(*) AS n, min(fqn) AS only_ FROM ks GROUP BY ALL HAVING count(*) = 1),
rs AS (SELECT DISTINCT e.prj, e.src, coalesce(x.fqn, al.only_) AS tgt FROM ed e JOIN ks s ON s.prj = e.prj AND s.fqn = e.src LEFT JOIN ks x ON x.prj = e.prj AND x.fqn = e.raw LEFT JOIN al ON al.prj = e.prj AND al.short = regexp_extract(e.raw, '[^.]*$')),
ok AS (SELECT * FROM rs WHERE tgt IS NOT NULL AND tgt <> src),
ad AS (SELECT prj, src AS node, tgt AS neighbor FROM ok UNION SELECT prj, tgt, src FROM ok)"""


def code_graph(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(symbols, edges) from suppliers, parts and order lines."""
    prj = lambda c: F.concat(F.lit("r"), F.col(c) % 5)
    name = lambda p, kind, n: F.concat(F.lit("shop."), p, F.lit(f".{kind}"), n)
    s = table(spark, sf_dir, "supplier").select(prj("s_suppkey").alias("p"), F.lit("S").alias("k"), F.col("s_suppkey").alias("n"), F.lit("function").alias("kind"))
    t = table(spark, sf_dir, "part").select(prj("p_partkey").alias("p"), F.lit("P").alias("k"), F.floor(F.col("p_partkey") / 2).alias("n"), F.lit("class").alias("kind"))
    nodes = s.unionByName(t).distinct()
    symbols = nodes.select(
        F.lit("t").alias("tenant_id"), F.col("p").alias("gitlab_project_id"), F.lit("main").alias("branch"), F.concat(F.lit("shop/"), "p").alias("repo_path_with_namespace"), F.concat("k", "n").alias("symbol_name"), F.concat(F.lit("shop."), "p", F.lit("."), "k", "n").alias("symbol_fqn"),
        F.col("kind").alias("symbol_kind"), F.when(F.col("n") % 3 == 0, "go").otherwise("python").alias("language"), F.lit(None).cast("string").alias("docstring"), F.concat(F.lit("def "), "k", "n").alias("signature"), F.concat(F.lit("src/"), "k", F.col("n") % 7, F.lit(".py")).alias("definition_file_path"),
        F.concat("p", F.lit(":"), "k", "n").alias("definition_chunk_id"), F.concat(F.lit("https://git.example.com/"), "k", "n").alias("definition_url"), F.concat("p", F.lit("|"), "k", "n").alias("symbol_id"),
    )
    # an edge is three numbers until it is met once; the first dealing out is by all of them, so that no task gathers a file's lines before
    which = F.coalesce(F.when(F.col("l_linenumber") % 3 == 0, 0).when(F.col("l_linenumber") % 3 == 1, 1), F.lit(2))
    line = table(spark, sf_dir, "lineitem").select("l_suppkey", which.alias("kind"), F.when(which < 2, F.floor(F.col("l_partkey") / 2)).otherwise(F.col("l_partkey").cast("long")).alias("n"))
    line = line.repartition("l_suppkey", "kind", "n").distinct().withColumn("p", prj("l_suppkey"))
    target = F.when(F.col("kind") == 0, name(F.col("p"), "P", F.col("n"))).when(F.col("kind") == 1, F.concat(F.lit("x.P"), "n")).otherwise(F.concat(F.lit("lib.Q"), "n"))
    edges = line.select(F.lit("t").alias("tenant_id"), F.col("p").alias("gitlab_project_id"), F.lit("main").alias("branch"), name(F.col("p"), "S", F.col("l_suppkey")).alias("source_symbol_fqn"), target.alias("target_symbol_fqn"), F.concat("p", F.lit(":S"), "l_suppkey").alias("source_chunk_id"))
    edges = edges.withColumns({"edge_type": F.lit("CALLS"), "confidence": F.lit(0.55), "edge_id": F.sha2(F.concat_ws("|", "source_symbol_fqn", "target_symbol_fqn"), 256)})
    return symbols, edges


@BOOK.query(f"WITH {GRAPH_SQL} SELECT prj, node, neighbor FROM ad")
def adjacency_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.adjacency(*code_graph(spark, sf_dir)).select(F.col("gitlab_project_id").alias("prj"), "node", "neighbor")


@BOOK.query(f"WITH {GRAPH_SQL}, d AS (SELECT prj, node, count(*) AS degree FROM ad GROUP BY ALL) SELECT prj, node, degree, row_number() OVER (PARTITION BY prj ORDER BY degree DESC, node)::INT AS rank FROM d")
def degree_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    d = graph.degrees(graph.adjacency(*code_graph(spark, sf_dir))).select(F.col("gitlab_project_id").alias("prj"), "node", "degree")
    return d.withColumn("rank", F.row_number().over(W.partitionBy("prj").orderBy(F.desc("degree"), "node")))


def _seeded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Each supplier as the one hit of a query, with its class."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query_id"), F.concat(F.lit("r"), F.col("s_suppkey") % 5).alias("p"))
    fused = s.select("query_id", F.concat("p", F.lit(":S"), "query_id").alias("chunk_id"), F.lit(1).alias("rank"), F.concat(F.lit("shop."), "p", F.lit(".S"), "query_id").alias("symbol_fqn"))
    return fused, s.select("query_id", F.lit("usage_lookup").alias("query_type"))


@BOOK.query(
    f"""WITH {GRAPH_SQL}, e2 AS (SELECT DISTINCT src, raw, sha256(src || '|' || raw) AS edge_id FROM ed),
q AS (SELECT s_suppkey AS query_id, 'shop.r' || (s_suppkey % 5) || '.S' || s_suppkey AS fqn FROM supplier),
m AS (SELECT query_id, edge_id, raw AS other FROM q JOIN e2 ON src = fqn UNION ALL SELECT query_id, edge_id, src FROM q JOIN e2 ON raw = fqn),
m2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY edge_id, other) AS n FROM m QUALIFY n <= 50),
nm AS (SELECT query_id, other, min(n) AS n FROM m2 WHERE NOT EXISTS (SELECT 1 FROM q WHERE q.query_id = m2.query_id AND q.fqn = m2.other) GROUP BY ALL),
f AS (SELECT query_id, prj || '|' || regexp_extract(fqn, '[^.]*$') AS symbol_id, fqn, prj || ':' || regexp_extract(fqn, '[^.]*$') AS chunk_id, min(n) AS n FROM nm JOIN ks ON fqn = other OR regexp_extract(fqn, '[^.]*$') = regexp_extract(other, '[^.]*$') GROUP BY ALL),
f2 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY n, symbol_id) AS k FROM f QUALIFY k <= 20),
f3 AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY k) AS place FROM f2 QUALIFY place <= 10)
SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY place)::INT AS rank FROM f3 JOIN q USING (query_id) WHERE chunk_id <> 'r' || (query_id % 5) || ':S' || query_id"""
)
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges = code_graph(spark, sf_dir)
    return graph.expand(*_seeded(spark, sf_dir), edges, symbols, hops=1).select("query_id", "chunk_id", "rank")


@BOOK.query()
def k_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    symbols, edges = code_graph(spark, sf_dir)
    return graph.expand(*_seeded(spark, sf_dir), edges, symbols, hops=3, limit=30).select("query_id", "chunk_id", "rank")


@BOOK.query()
def communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label propagation is sequential by definition, which SQL does not express."""
    return graph.communities(*code_graph(spark, sf_dir)).select("gitlab_project_id", "node", "label")


@BOOK.query()
def community_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = graph.community_rows(*code_graph(spark, sf_dir))
    return rows.select("community_id", "gitlab_project_id", "label", "summary", F.col("size").cast("long").alias("size"), F.col("edge_count").cast("long").alias("edge_count"), "dominant_language", F.size("member_symbol_fqns").alias("members"))


@BOOK.query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 10)")
def orphan_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as edges from parts; parts of small size are gone."""
    edges = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("source_chunk_id"))
    chunks = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("chunk_id"))
    return T.orphaned_edges(edges, chunks).select("l_orderkey", "l_linenumber")


@BOOK.query("SELECT l.l_orderkey, l.l_linenumber, p.parent FROM lineitem l LEFT JOIN (SELECT l_orderkey, max_by(l_partkey, l_linenumber * 100000000 + l_partkey) AS parent FROM lineitem WHERE l_linenumber <= 2 GROUP BY l_orderkey) p USING (l_orderkey) WHERE l.l_linenumber > 2")
def parent_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as files: the first two lines are chunks of one class, of which the last counts, the others chunks of its members."""
    first = F.col("l_linenumber") <= 2
    line = table(spark, sf_dir, "lineitem").select(
        *(F.lit("x").alias(k) for k in ingest.KEYS if k != "file_path"), F.col("l_orderkey").alias("file_path"), (F.col("l_linenumber") * 100000000 + F.col("l_partkey")).alias("ordinal"), F.col("l_partkey").alias("chunk_id"), "l_linenumber",
        F.when(first, "class_definition").otherwise("method_definition").alias("kind"), F.when(first, "Order").otherwise(F.concat(F.lit("line"), "l_linenumber")).alias("symbol_name"), F.when(~first, "Order.lines").alias("parent_symbol"),
    )
    return ingest.link_parents(line).where("l_linenumber > 2").select(F.col("file_path").alias("l_orderkey"), "l_linenumber", F.col("parent_chunk_id").alias("parent"))


def _permissions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Customers as users who see their nation and the next; orders as requests, some of which name projects."""
    c = table(spark, sf_dir, "customer")
    own = F.transform(F.array(F.col("c_nationkey"), (F.col("c_nationkey") + 1) % 25), lambda x: x.cast("string"))
    perms = c.where("c_custkey % 7 > 0").select(F.lit("t").alias("tenant_id"), F.col("c_custkey").cast("string").alias("user_id"), own.alias("accessible_project_ids"))
    o = table(spark, sf_dir, "orders")
    asked = F.when(F.col("o_orderkey") % 3 == 0, F.array((F.col("o_orderkey") % 25).cast("string"), ((F.col("o_orderkey") + 1) % 25).cast("string")))
    return o.select(F.col("o_orderkey").alias("query_id"), F.lit("t").alias("tenant_id"), F.col("o_custkey").cast("string").alias("user_id"), asked.alias("project_ids")), perms


_ACL_SQL = """p AS (SELECT c_custkey AS u, list_sort(list_distinct([c_nationkey::VARCHAR, ((c_nationkey + 1) % 25)::VARCHAR])) AS own FROM customer WHERE c_custkey % 7 > 0),
r AS (SELECT o_orderkey AS query_id, own, CASE WHEN o_orderkey % 3 = 0 THEN [(o_orderkey % 25)::VARCHAR, ((o_orderkey + 1) % 25)::VARCHAR] END AS asked FROM orders LEFT JOIN p ON u = o_custkey),
a AS (SELECT query_id, CASE WHEN own IS NOT NULL THEN CASE WHEN asked IS NOT NULL THEN list_filter(own, lambda x: list_contains(asked, x)) ELSE own END END AS allowed, own IS NULL AS denied FROM r)"""


@BOOK.query(f"WITH {_ACL_SQL} SELECT query_id, array_to_string(allowed, ',') AS allowed, denied FROM a")
def acl_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = access.resolve(*_permissions(spark, sf_dir))
    return got.select("query_id", F.array_join("allowed", ",").alias("allowed"), F.col("denied").isNotNull().alias("denied"))


@BOOK.query(f"WITH {_ACL_SQL}, g AS (SELECT query_id, unnest(allowed) AS project FROM a WHERE NOT denied) SELECT query_id, s_suppkey FROM g JOIN supplier ON s_nationkey::VARCHAR = project")
def acl_semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The suppliers of the nations that each request may read."""
    granted = access.grants(access.resolve(*_permissions(spark, sf_dir)))
    rows = table(spark, sf_dir, "supplier").select(F.lit("t").alias("tenant_id"), "s_suppkey", F.col("s_nationkey").cast("string").alias("gitlab_project_id"))
    return access.readable(rows, granted, row_id="s_suppkey").select("query_id", "s_suppkey")


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Documents as files, each with a chunk and a symbol, and an edge to the next file."""
    d = table(spark, sf_dir, "documents")
    base = d.select(F.lit("t").alias("tenant_id"), F.col("source").alias("gitlab_project_id"), F.lit("main").alias("branch"), F.concat(F.lit("f"), "doc_id").alias("file_path"), "doc_id", F.col("lang").alias("language"))
    return {
        "files": base,
        "chunks": base.withColumn("chunk_id", F.col("doc_id")),
        "symbols": base.withColumnRenamed("file_path", "definition_file_path").withColumn("symbol_id", F.col("doc_id")),
        "edges": base.select("tenant_id", F.col("gitlab_project_id").alias("source_repo_project_id"), "branch", F.col("file_path").alias("source_file_path"), F.concat(F.lit("f"), F.col("doc_id") + 20).alias("target_file_path"), F.col("doc_id").alias("edge_id")),
    }


@BOOK.query(
    """WITH g AS (SELECT source, doc_id FROM documents WHERE lang = 'fr') SELECT 'files' AS tbl, count(*) FILTER (WHERE lang <> 'fr') AS kept, count(*) FILTER (WHERE lang = 'fr') AS deleted FROM documents
UNION ALL SELECT 'chunks', count(*) FILTER (WHERE lang <> 'fr'), count(*) FILTER (WHERE lang = 'fr') FROM documents UNION ALL SELECT 'symbols', count(*) FILTER (WHERE lang <> 'fr'), count(*) FILTER (WHERE lang = 'fr') FROM documents
UNION ALL SELECT 'edges', count(*), NULL FROM documents d WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.source = d.source AND g.doc_id IN (d.doc_id, d.doc_id + 20))"""
)
def delete_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All French files deleted: rows kept and deleted by table; deleted edges are not counted."""
    t = _tables(spark, sf_dir)
    left, counts = T.delete_files(t, t["files"].where("language = 'fr'"))
    kept = None
    for name, df in left.items():
        n = df.agg(F.lit(name).alias("tbl"), F.count("*").alias("kept"))
        kept = n if kept is None else kept.unionByName(n)
    return kept.join(counts.withColumnRenamed("table", "tbl"), "tbl", "left")


@BOOK.query("SELECT doc_id, CASE WHEN lang = 'de' THEN lang || '2' ELSE lang END AS language FROM documents")
def replace_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All German files replaced by a new version."""
    t = _tables(spark, sf_dir)
    new = {n: df.where("language = 'de'").withColumn("language", F.concat("language", F.lit("2"))) for n, df in t.items() if n != "edges"}
    new["edges"] = t["edges"].limit(0)
    out, _ = T.replace_files(t, new)
    return out["chunks"].select("doc_id", "language")


@BOOK.query(
    """WITH c AS (SELECT vec_id, label, CASE WHEN vec_id % 5 = 0 THEN 'new' ELSE 'old' || label END AS h FROM embeddings), s AS (SELECT vec_id, 'old' || label AS h FROM embeddings WHERE vec_id % 3 > 0)
SELECT c.vec_id, coalesce(s.h = c.h, FALSE) AS reused FROM c LEFT JOIN s USING (vec_id)"""
)
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    old = F.concat(F.lit("old"), "label")
    chunks = e.select(F.col("vec_id").alias("chunk_id"), F.when(F.col("vec_id") % 5 == 0, "new").otherwise(old).alias("embedding_input_hash"))
    stored = e.where("vec_id % 3 > 0").select(F.col("vec_id").alias("chunk_id"), old.alias("embedding_input_hash"), F.col("embedding").alias("embedding_dense"))
    have, todo = vector.reuse_embeddings(chunks, stored)
    return have.select(F.col("chunk_id").alias("vec_id"), F.lit(True).alias("reused")).unionByName(todo.select(F.col("chunk_id").alias("vec_id"), F.lit(False).alias("reused")))


@BOOK.query(
    """WITH c AS (SELECT source AS prj, 'f' || doc_id AS old_path, 'f' || (doc_id + CASE WHEN doc_id % 4 = 1 THEN 100000 ELSE 0 END) AS new_path, doc_id % 4 = 0 AS deleted, doc_id % 4 = 1 AS renamed FROM documents WHERE doc_id % 2 = 0 OR doc_id % 4 = 1),
here AS (SELECT source AS prj, 'f' || doc_id AS p FROM documents WHERE doc_id % 6 > 0 UNION SELECT source, 'f' || (doc_id + 100000) FROM documents WHERE doc_id % 8 = 1),
ix AS (SELECT DISTINCT prj, new_path AS p FROM c JOIN here USING (prj) WHERE NOT deleted AND here.p = new_path),
de AS (SELECT prj, old_path AS p FROM c WHERE deleted OR renamed UNION SELECT prj, new_path FROM c WHERE NOT deleted AND NOT EXISTS (SELECT 1 FROM here WHERE here.prj = c.prj AND here.p = new_path))
SELECT prj, p AS file_path, 'index' AS action FROM ix UNION ALL SELECT prj, p, 'delete' FROM de WHERE NOT EXISTS (SELECT 1 FROM ix WHERE ix.prj = de.prj AND ix.p = de.p)"""
)
def incremental_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.lit("t").alias("tenant_id"), F.col("source").alias("gitlab_project_id"), F.lit("main").alias("branch"), "doc_id")
    four = F.col("doc_id") % 4
    path = lambda x: F.concat(F.lit("f"), x)
    moved = path(F.col("doc_id") + 100000)
    changes = d.where((F.col("doc_id") % 2 == 0) | (four == 1)).select("tenant_id", "gitlab_project_id", "branch", path(F.col("doc_id")).alias("old_path"), F.when(four == 1, moved).otherwise(path(F.col("doc_id"))).alias("new_path"), (four == 0).alias("deleted"), (four == 1).alias("renamed"))
    here = d.where("doc_id % 6 > 0").select("tenant_id", "gitlab_project_id", "branch", path(F.col("doc_id")).alias("file_path")).unionByName(d.where("doc_id % 8 = 1").select("tenant_id", "gitlab_project_id", "branch", moved.alias("file_path")))
    return incremental.plan_changes(changes, here).select(F.col("gitlab_project_id").alias("prj"), "file_path", "action")


@BOOK.query("SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT doc_id, sha256(text) AS h FROM documents WHERE doc_id % 5 > 0) a FULL JOIN (SELECT doc_id, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '.' ELSE text END) AS h FROM documents WHERE doc_id % 7 > 0) b USING (doc_id) WHERE a.h IS DISTINCT FROM b.h")
def snapshot_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    old = d.where("doc_id % 5 > 0").select("doc_id", F.sha2("text", 256).alias("file_hash"))
    new = d.where("doc_id % 7 > 0").select("doc_id", F.sha2(F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("."))).otherwise(F.col("text")), 256).alias("file_hash"))
    return files_.snapshot_diff(old, new, ["doc_id"])
