from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import access, assemble, evaluate, fuse, graph, legs, lexical, vector
from lodestone.plans import queries_rank


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "b zz"), (3, "")], "query_id long, query string")
    got = {(r.query_id, r.doc_id): r.score for r in lexical.bm25_search(docs, queries, doc_id="doc_id", query_id="query_id", query="query", boosts={"text": 1.0}, n=5).collect()}
    avgdl = 5 / 3

    def score(tf, dl, df):
        return math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))

    assert got == pytest.approx({(1, 1): score(2, 3, 1), (2, 1): score(1, 3, 2), (2, 2): score(1, 2, 2)})


def test_filters_come_after_the_statistics(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, "a c"), (3, "d")], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "a")], "query_id long, query string")
    how = dict(doc_id="doc_id", query_id="query_id", query="query", boosts={"text": 1.0}, n=5)
    free = {r.doc_id: r.score for r in lexical.bm25_search(docs, queries, **how).collect()}
    allowed = spark.createDataFrame([(1, 2)], "query_id long, doc_id long")
    own = {r.doc_id: r.score for r in lexical.bm25_search(docs, queries, allowed=allowed, **how).collect()}
    assert own == {2: free[2]}


@pytest.mark.parametrize("block", [1, 3, 2048])
def test_nearest_by_cosine(spark, block):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((40, 6))
    x[7] = 0
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "i long, v array<double>")
    got = vector.knn(rows, rows.where("i < 5"), 4, vec_id="i", vec="v", query_id="i", query_vec="v", block=block).collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q in range(5):
        s = unit @ unit[q]
        want = np.lexsort((np.arange(40), -np.round(s, 12)))[:4].tolist()
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)] == want


def test_hash_embeddings():
    a = np.array(vector.embed("Foo bar foo"))
    assert np.linalg.norm(a) == pytest.approx(1) and (np.array(vector.embed("...")) == 0).all() and vector.embed("x y") == vector.embed("X Y")


def test_late_interaction(spark):
    rows = spark.createDataFrame([([[1.0, 0.0], [0.0, 1.0]], [[1.0, 0.0]], None)], "a array<array<double>>, b array<array<double>>, c array<array<double>>")
    got = rows.select(vector.maxsim(F.col("a"), F.col("b")).alias("x"), vector.maxsim(F.col("a"), F.col("c")).alias("y")).first()
    assert (got.x, got.y) == (0.5, 0.0)
    places = spark.createDataFrame([("foo bar",)], "t string").select(vector.late_places()(F.col("t")).alias("p"))
    dense = places.select(vector.late_vectors(F.col("p")).alias("v")).first().v
    assert len(dense) == 2 and all(sum(abs(x) for x in v) == 1 for v in dense)
    pooled = rows.select(vector.mean_pool(F.col("a"), 3).alias("m")).first().m
    assert pooled == [0.5, 0.5, 0.0]


def test_replies():
    assert vector.parse_embedding_reply([[1, 2]]) == [[1.0, 2.0]]
    assert vector.parse_embedding_reply({"data": [{"embedding": [1]}]}) == [[1.0]]
    assert vector.parse_embedding_reply({"embedding": [1, 2]}) == [[1.0, 2.0]]
    assert vector.parse_embedding_reply("junk") == [] and vector.parse_embedding_reply({"x": 1}) == []
    assert fuse.parse_cross_encoder_reply([1, 2.5]) == [1.0, 2.5]
    assert fuse.parse_cross_encoder_reply({"results": [{"score": 1}, {"relevance": 2}]}) == [1.0, 2.0]
    assert fuse.parse_cross_encoder_reply({"scores": [1, "x"]}) == [] and fuse.parse_cross_encoder_reply(None) == []


def leg(spark, name, ids):
    rows = spark.createDataFrame([("q", c, i + 1) for i, c in enumerate(ids)], "query_id string, chunk_id string, rank int")
    return fuse.as_leg(rows, name)


def test_fusion_keeps_first_seen_order_and_flags(spark):
    got = fuse.rrf([leg(spark, "symbol", ["a", "b"]), leg(spark, "lexical", ["c", "a"]), leg(spark, "neighbor", ["d"])]).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["a", "c", "d", "b"]
    assert got[0].score == pytest.approx(1 / 61 + 1 / 62) and [r.graph_expanded for r in got] == [False, False, True, False]


def hits(spark, rows):
    return spark.createDataFrame(rows, "query_id string, chunk_id string, rank int, score double, repo_path_with_namespace string, file_path string, line_start int, line_end int, chunk_kind string, symbol_name string, symbol_fqn string, symbol_role string, blob_url string, text string, edge_match boolean, graph_expanded boolean")


def hit(chunk, rank=1, score=0.0, **more):
    base = dict(query_id="q", chunk_id=chunk, rank=rank, score=score, repo_path_with_namespace="g/r", file_path="a.py", line_start=1, line_end=2, chunk_kind="file", symbol_name=None, symbol_fqn=None, symbol_role="none", blob_url="u", text="t", edge_match=False, graph_expanded=False)
    return tuple((base | more).values())


def test_boosts(spark):
    rows = hits(spark, [hit("plain"), hit("def", symbol_name="Pay", symbol_fqn="g.Pay", symbol_role="definition"), hit("edge", edge_match=True), hit("near", graph_expanded=True), hit("com", chunk_kind="community_summary"), hit("test", file_path="tests/a.py")])
    by = lambda t, ids=(): {r.chunk_id: round(r.b, 3) for r in rows.select("chunk_id", fuse.boost(F.lit(t), F.array(*(F.lit(i) for i in ids)).cast("array<string>")).alias("b")).collect()}
    got = by("definition_lookup", ["pay"])
    assert got["def"] == 0.35 and got["plain"] == 0 and got["near"] == 0.05 and got["com"] == 0.1
    assert by("usage_lookup")["edge"] == 0.2 and by("test_question")["test"] == 0.15
    assert by("config_question")["plain"] == 0.05 and by("config_question")["def"] == 0


def test_cross_encoder_blend(spark):
    rows = hits(spark, [hit("a", 1), hit("b", 2), hit("c", 3)]).withColumn("cross_score", F.when(F.col("chunk_id") == "a", 1.0).when(F.col("chunk_id") == "b", 3.0).otherwise(2.0))
    assert {r.chunk_id: r.score for r in fuse.blend_cross_encoder(rows).collect()} == {"a": 0.0, "b": 1.0, "c": 0.5}
    same = rows.withColumn("cross_score", F.lit(2.0))
    assert {r.score for r in fuse.blend_cross_encoder(same).collect()} == {0.0}
    gap = rows.withColumn("cross_score", F.when(F.col("chunk_id") != "a", 1.0))
    assert {r.score for r in fuse.blend_cross_encoder(gap).collect()} == {0.0}
    cut = fuse.final_cut(fuse.blend_cross_encoder(rows), 2).orderBy("final_rank").collect()
    assert [r.chunk_id for r in cut] == ["b", "c"]


def test_answers(spark):
    queries = spark.createDataFrame([("q",), ("none",)], "query_id string")
    got = {r.query_id: r for r in assemble.extractive_answer(queries, hits(spark, [hit("a", score=1.0, symbol_name="f")]), "rank").collect()}
    assert got["none"].answer == assemble.NO_HITS and not got["none"].grounded
    assert got["q"].grounded and "- Source [1] points to g/r/a.py:1-2 `f`." in got["q"].answer
    gate = {r.query_id: r.refusal for r in assemble.grounding(queries, hits(spark, [hit("a", blob_url="")])).collect()}
    assert gate["q"] == assemble.NO_LINKS
    few = {r.query_id: r.refusal for r in assemble.grounding(queries, hits(spark, [hit("a")]), min_sources=2).collect()}
    assert few["q"] == "I found too few independent source citations to answer this safely (1 found, 2 required)."
    long = assemble.context(hits(spark, [hit("a", text="x " * 2000)]), "rank").first().context
    assert long.startswith("[1] g/r:a.py:1-2\nSource: u\nx x") and long.endswith("x\n...")
    assert assemble.citations(hits(spark, [hit("a")]), "rank").first()["index"] == 1


def test_access(spark):
    requests = spark.createDataFrame([(1, "t", "u", None), (2, "t", "u", ["b", "z"]), (3, "t", "x", None), (4, "t", None, ["b"]), (5, "t", "w", None)], "query_id int, tenant_id string, user_id string, project_ids array<string>")
    perms = spark.createDataFrame([("t", "u", ["b", "a", "b"]), ("t", "w", [])], "tenant_id string, user_id string, accessible_project_ids array<string>")
    got = {r.query_id: (r.allowed, r.denied is None) for r in access.resolve(requests, perms).collect()}
    assert got == {1: (["a", "b"], True), 2: (["b"], True), 3: (None, False), 4: (None, False), 5: ([], True)}
    trusted = {r.query_id: r.allowed for r in access.resolve(requests, perms, trust_requests=True).collect()}
    assert trusted[4] == ["b"]
    rows = spark.createDataFrame([("c1", "t", "a", "r1"), ("c2", "t", "b", "r2"), ("c3", "s", "a", "r1")], "chunk_id string, tenant_id string, gitlab_project_id string, repo string")
    granted = access.grants(access.resolve(requests, perms))
    assert {(r.query_id, r.chunk_id) for r in access.readable(rows, granted, row_id="chunk_id").collect()} == {(1, "c1"), (1, "c2"), (2, "c2")}
    repos = spark.createDataFrame([(1, "r2")], "query_id int, repo_path string")
    assert {(r.query_id, r.chunk_id) for r in access.readable(rows, granted, row_id="chunk_id", repo="repo", repos=repos).collect()} == {(1, "c2"), (2, "c2")}
    branched = rows.withColumns({"branch": F.lit("m"), "repo_path_with_namespace": F.col("repo")})
    assert branched.where(access.scope("t", "m", [], active=None)).count() == 0
    assert branched.where(access.scope("t", "m", ["a", "b"], ["r2"], active=None)).count() == 1


def test_what_requests_may_read_is_unfolded_where_it_is_written(spark, monkeypatch):
    """each row of a scope was broadcast or shuffled on its own; now its sorted ids come in one list, whatever its readers."""
    rows = spark.range(600).select(F.lit("t").alias("tenant_id"), F.when(F.col("id") != 7, F.col("id")).alias("row"), (F.col("id") % 3).cast("string").alias("gitlab_project_id"))
    granted = spark.range(60).select(F.col("id").alias("query_id"), F.lit("t").alias("tenant_id"), (F.col("id") % 4).cast("string").alias("project_id"))
    plain = granted.join(rows.withColumnRenamed("gitlab_project_id", "project_id"), ["tenant_id", "project_id"]).select("query_id", "row")
    got = access.readable(rows, granted, row_id="row")
    assert "Generate explode" in got._jdf.queryExecution().optimizedPlan().toString()
    orders = [[r.row for r in got.where(F.col("query_id") == q).collect()] for q in (1, 5)]
    assert orders[0] == orders[1] and len(orders[0]) == 200
    want = sorted(map(str, plain.collect()))
    assert sorted(map(str, got.collect())) == want
    monkeypatch.setattr(access, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(access, "PACK", 100)
    assert sorted(map(str, access.readable(rows, granted, row_id="row").collect())) == want


def test_metrics_can_pass_one(spark):
    golden = spark.createDataFrame([("x", ["f"]), ("y", ["g"]), ("z", [])], "case_id string, relevant array<string>")
    ranked = spark.createDataFrame([("x", 1, True), ("x", 2, True), ("y", 1, False), ("y", 2, True)], "case_id string, rank int, is_rel boolean")
    got = {r.case_id: r for r in evaluate.score_cases(golden, ranked, 10).collect()}
    assert got["x"].recall_at_k == 2 and got["x"].mrr == 1 and got["x"].ndcg_at_k > 1 and got["x"].precision_at_k == 0.2
    assert got["y"].mrr == 0.5 and got["y"].hit_at_k == 1
    assert got["z"].recall_at_k == 0 and got["z"].ndcg_at_k == 0
    mean = evaluate.macro(evaluate.score_cases(golden, ranked, 10))
    assert mean.first().num_cases == 3 and evaluate.passes(mean, recall=1.0) and not evaluate.passes(mean, mrr=0.9)


def test_golden_file(spark, tmp_path):
    path = tmp_path / "g.json"
    path.write_text('{"cases": [{"query": "a", "relevant": ["x"]}, {"case_id": "k", "query": "b", "relevant": []}]}')
    assert [(r.case_id, r.query) for r in evaluate.load_golden(spark, str(path)).collect()] == [("case-0", "a"), ("k", "b")]


def test_keyed_search(spark):
    symbols = spark.createDataFrame([("s1", "Pay", "g.a.Pay", "class Pay", "c1"), ("s2", "PayLater", "g.b.PayLater", "class PayLater", "c2")], "symbol_id string, symbol_name string, symbol_fqn string, signature string, definition_chunk_id string")
    chunks = spark.createDataFrame([("c1",), ("c2",)], "chunk_id string")
    wanted = spark.createDataFrame([("q", "Pay")], "query_id string, identifier string")
    got = legs.symbol_search(symbols, chunks, wanted, 5).orderBy("rank").collect()
    assert [r.chunk_id for r in got] == ["c1"]


def test_permissions_come_before_the_cuts(spark):
    n = 8
    vecs = spark.createDataFrame([(i, [1.0, i / 100]) for i in range(n)] + [(n, [0.0, 1.0])], "i long, v array<double>")
    ask = spark.createDataFrame([("q", [1.0, 0.0]), ("r", [1.0, 0.0])], "query_id string, e array<double>")
    may = spark.createDataFrame([("q", n), ("q", 5), ("r", 3)], "query_id string, doc_id long")
    got = vector.knn(vecs, ask, 2, vec_id="i", vec="v", query_id="query_id", query_vec="e", allowed=may).collect()
    assert {(r.query_id, r.doc_id, r["rank"]) for r in got} == {("q", 5, 1), ("q", n, 2), ("r", 3, 1)}

    project = lambda i: "own" if i == n else "other"
    symbols = spark.createDataFrame([("t", project(i), "m", f"s{i}", "Pay", f"g{i}.Pay", "class Pay", f"c{i}") for i in range(n + 1)], "tenant_id string, gitlab_project_id string, branch string, symbol_id string, symbol_name string, symbol_fqn string, signature string, definition_chunk_id string")
    edges = spark.createDataFrame([("t", project(i), "m", f"e{i}", "CALLS", 0.55, f"g{i}.Pay", "x.Bill", f"c{i}") for i in range(n + 1)], "tenant_id string, gitlab_project_id string, branch string, edge_id string, edge_type string, confidence double, source_symbol_fqn string, target_symbol_fqn string, source_chunk_id string")
    chunks = symbols.select(F.col("definition_chunk_id").alias("chunk_id"))
    mine = spark.createDataFrame([("q", f"c{n}")], "query_id string, chunk_id string")
    wanted = lambda x: spark.createDataFrame([("q", x)], "query_id string, identifier string")
    assert [(r.chunk_id, r["rank"]) for r in legs.symbol_search(symbols, chunks, wanted("Pay"), 1, mine).collect()] == [(f"c{n}", 1)]
    assert [(r.chunk_id, r["rank"]) for r in legs.edge_search(edges, chunks, wanted("x.Bill"), 1, mine).collect()] == [(f"c{n}", 1)]

    fused = spark.createDataFrame([("q", "c", 1, "x.Bill")], "query_id string, chunk_id string, rank int, symbol_fqn string")
    kinds = spark.createDataFrame([("q", "usage_lookup")], "query_id string, query_type string")
    granted = spark.createDataFrame([("q", "t", "m", "own")], "query_id string, tenant_id string, branch string, project_id string")
    many = edges.crossJoin(spark.range(5)).withColumn("edge_id", F.concat("edge_id", F.lit("-"), "id")).withColumn("source_symbol_fqn", F.concat("source_symbol_fqn", F.when(F.col("gitlab_project_id") == "other", F.col("id").cast("string")).otherwise("")))
    assert [r.chunk_id for r in graph.expand(fused, kinds, many, symbols, limit=1, granted=granted, allowed=mine).collect()] == [f"c{n}"]


def test_relevant_documents_of_short_items(spark, tmp_path):
    docs = [(1, "the quick red fox runs"), (2, "a red fox"), (3, "red foxes sleep well"), (4, "one two three four five six seven"), (5, "none")]
    items = [("short", "red fox"), ("cut", "two three four fiv"), ("word", "fox"), ("long", "one two three four five six")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r.case_id: r.num_relevant for r in queries_rank._cases(spark, str(tmp_path)).collect()}
    assert got == {i: sum(t in d for _, d in docs) for i, t in items}


ODD_DOCS = [(1, "a b a", "b"), (2, "b c", None), (3, None, "a"), (4, "c c a b d", "d a"), (4, "a a", "c"), (4, "b b", "c"), (5, "", ""), (6, "zz", "yy"), (7, "a b a", "b")]
ODD_QUERIES = [(1, "a"), (2, "b zz b"), (3, ""), (4, "d c a"), (5, None)]


def _joined(monkeypatch, run):
    """What run gives where the terms are too many to broadcast."""
    with monkeypatch.context() as m:
        m.setattr(lexical, "_vocabulary", lambda terms: None)
        return run()


def test_documents_are_multiplied_with_blocks_of_queries(spark, monkeypatch):
    """F8: a row was made for each query, document and term, and postings were gathered in a table of each task."""
    docs = spark.createDataFrame(ODD_DOCS, "doc_id long, text string, title string")
    queries = spark.createDataFrame(ODD_QUERIES, "query_id long, query string")
    boosts = {"text": 3.0, "title": 1.5}
    terms = lexical.query_terms(queries, "query_id", "query")
    plan = lexical.bm25_scores(docs, terms, boosts, doc_id="doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and "MapInArrow" in plan
    every = lambda: {(r.query_id, r.doc_id): r.score for r in lexical.bm25_scores(docs, terms, boosts, doc_id="doc_id").collect()}
    best = lambda: sorted((r.query_id, r["rank"], r.doc_id) for r in lexical.bm25_search(docs, queries, doc_id="doc_id", query_id="query_id", query="query", boosts=boosts, n=2).collect())
    want, want_best = _joined(monkeypatch, every), _joined(monkeypatch, best)
    assert len(want) > 12 and every() == pytest.approx(want) and best() == want_best
    monkeypatch.setattr(lexical, "BLOCK_CELLS", 1)
    monkeypatch.setattr(lexical, "PRODUCTS", 1)
    assert every() == pytest.approx(want) and best() == want_best


def test_best_of_many_and_of_equal_scores(spark, monkeypatch):
    docs = spark.createDataFrame([(f"d{i}", "a " * (i % 3 + 1) + "b" * (i % 2)) for i in range(300)], "doc_id string, text string")
    queries = spark.createDataFrame([(1, "a"), (2, "b a")], "query_id long, query string")
    run = lambda: sorted((r.query_id, r["rank"], r.doc_id) for r in lexical.bm25_search(docs, queries, doc_id="doc_id", query_id="query_id", query="query", boosts={"text": 1.0}, n=7).collect())
    monkeypatch.setattr(lexical, "PRODUCTS", 40)
    assert len(run()) == 14 and run() == _joined(monkeypatch, run)


def test_filters_by_scope_are_read_where_documents_are_scored(spark, data, monkeypatch):
    """all pairs of a query and a document that it may see were made, and every score was joined to them."""
    rows = lambda: sorted(map(str, queries_rank.filtered_bm25(spark, data).collect()))
    want = _joined(monkeypatch, rows)
    docs = spark.createDataFrame([("c1", "x y", "t", "a", True), ("c2", "x x", "t", "b", True), ("c3", "x", None, "a", True), ("c4", "x", "t", "a", False)], "doc_id string, text string, tenant_id string, gitlab_project_id string, on boolean")
    queries = spark.createDataFrame([(1, "x"), (2, "x"), (3, "x")], "query_id int, query string")
    granted = spark.createDataFrame([(1, "t", "a"), (2, "t", "a"), (2, "t", "b"), (2, None, "a")], "query_id int, tenant_id string, project_id string")
    find = lambda: {(r.query_id, r.doc_id) for r in lexical.bm25_search(docs, queries, doc_id="doc_id", query_id="query_id", query="query", boosts={"text": 1.0}, n=5, allowed=access.permit(docs, granted, "doc_id", active="on")).collect()}
    assert _joined(monkeypatch, find) == {(1, "c1"), (2, "c1"), (2, "c2")}
    monkeypatch.setattr(lexical, "permitted", None)
    assert rows() == want and find() == {(1, "c1"), (2, "c1"), (2, "c2")}


def test_evaluation_makes_no_row_a_term(spark, data, monkeypatch):
    """they score by bm25_topk's step."""
    want = _joined(monkeypatch, lambda: sorted(map(str, queries_rank.eval_per_case(spark, data).collect())))
    monkeypatch.setattr(lexical, "postings", None)
    assert sorted(map(str, queries_rank.eval_per_case(spark, data).collect())) == want
    assert queries_rank.eval_macro(spark, data).first().num_cases == len(want)


def test_nearest_at_the_digits_of_the_order(spark):
    """a task kept its best by 12 digits, where the order has nine and then the smaller id; and 5000 queries were three scans of single rows."""
    turn = lambda a: [math.cos(a), math.sin(a)]
    rows = spark.createDataFrame([(1, turn(1e-5)), (2, turn(0.0)), (3, turn(1e-5)), (4, turn(0.5))], "i long, v array<double>").repartition(1)
    ask = spark.createDataFrame([(9, turn(0.0))], "i long, v array<double>")
    find = lambda n: [r.doc_id for r in sorted(vector.knn(rows, ask, n, vec_id="i", vec="v", query_id="i", query_vec="v").collect(), key=lambda r: r["rank"])]
    assert find(1) == [1] and find(4) == [1, 2, 3, 4]
    many = spark.range(5000).select("id", F.array(F.sin("id"), F.cos(F.col("id") * 2)).alias("v"))
    got = vector.knn(many, many, 2, vec_id="id", vec="v", query_id="id", query_vec="v")
    assert got._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1


@pytest.mark.parametrize("block", [7, 32768])
def test_nearest_among_copies_and_zeros(spark, monkeypatch, block):
    rng = np.random.default_rng(2)
    x = rng.integers(-1, 2, (400, 3)).astype(float)
    monkeypatch.setattr(vector, "VECTOR_ROWS", 50)
    monkeypatch.setattr(vector, "TILE", 4)
    monkeypatch.setattr(vector, "PAIRS", 30)
    rows = spark.createDataFrame([(f"v{i:03}", v.tolist()) for i, v in enumerate(x)], "i string, v array<double>")
    got = vector.knn(rows, rows.where("i < 'v020'"), 9, vec_id="i", vec="v", query_id="i", query_vec="v", block=block).collect()
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for q in range(20):
        want = np.lexsort((np.arange(400), -np.round(unit @ unit[q], 9)))[:9]
        assert [r.doc_id for r in sorted((r for r in got if r.query_id == f"v{q:03}"), key=lambda r: r["rank"])] == [f"v{i:03}" for i in want]


def _joins_over(plan, names: set[str]) -> bool:
    """Whether a join of a logical plan takes up a column so named."""
    below = plan.children()
    below = [below.apply(i) for i in range(below.size())]
    columns = {x.output().apply(i).name() for x in below for i in range(x.output().size())}
    return plan.nodeName() == "Join" and bool(columns & names) or any(_joins_over(x, names) for x in below)


def test_evaluation_joins_no_texts(spark, data, monkeypatch):
    """However many documents hold a case, their texts are checked where they lie and no list of them is made."""
    plans, cut = [], queries_rank.cut

    def seen(df, by=None):
        plans.append(df._jdf.queryExecution().optimizedPlan())
        return cut(df, by)

    monkeypatch.setattr(queries_rank, "cut", seen)
    monkeypatch.setattr(evaluate, "cut", seen, raising=False)
    assert queries_rank.eval_per_case(spark, data).count()
    assert plans and not any(_joins_over(p, {"text", "probe", "relevant"}) or "collect_set" in p.toString() for p in plans)


def test_holders(spark):
    texts = {1: "one two three four five six", 2: "ZERO one two three four five sixty", 3: "one two three four five", 4: "", 5: None, 6: "a.b", 7: "One two three four five six", 8: "x\none two three four  five six one two three four five six", 9: "été one two"}
    probes = {1: "one two three four five six", 2: "two three", 3: "", 4: None, 5: "a.b", 6: "ne two three four five", 7: "été", 8: "one two three four five"}
    docs = spark.createDataFrame([*texts.items(), (None, texts[1])], "doc_id long, text string")
    cases = spark.createDataFrame(list(probes.items()), "item_id long, text string")
    want = {(c, d) for c, p in probes.items() for d, t in [*texts.items(), (None, texts[1])] if p is not None and t is not None and p in t}
    for most in (1, 8 << 20):
        got = evaluate.holders(docs, cases, doc_id="doc_id", case_id="item_id", most=most).collect()
        assert {(r.case_id, r.doc_id) for r in got} == want and len(got) == len(want)
    assert evaluate.holders(docs, cases.limit(0), doc_id="doc_id", case_id="item_id").count() == 0
