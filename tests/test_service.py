from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

import lodestone.__main__ as cli
from lodestone.operators import assemble, graph, legs, vector
from lodestone.operators.vector import DENSE, hash_embedding
from lodestone.plans import ingest, search
from lodestone.sources import tables as T
from lodestone.streaming import incremental, jobs

FILE = "tenant_id string, gitlab_project_id string, repo_path_with_namespace string, branch string, commit_sha string, file_path string, content string, size_bytes long"
CODE = '''class {0}Service:
    def charge(self):
        return helper()

def helper():
    return settle()

def settle():
    return 1
'''


def files(spark, scopes):
    rows = [(t, p, f"group/{p}", "main", "abc", "src/pay.py", CODE.format(name), 10) for t, p, name in scopes]
    return spark.createDataFrame(rows, FILE)


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    """Two tenants and three projects of like content."""
    out = T.Store(spark, str(tmp_path_factory.mktemp("service") / "tables"))
    counts = incremental.index_repository(out, files(spark, [("t", "1", "Pay"), ("t", "2", "Pay"), ("u", "3", "Pay")]), ingest.ingest, communities=True)
    assert counts["communities"] == 3 and counts["files"] == 3
    return out


def tables(store):
    out = {n: store.read(n) for n in ("chunks", "symbols", "edges", "communities")}
    return out | {"chunk_vec": out["chunks"].select("chunk_id", hash_embedding(DENSE)(F.col("text")).alias("dense"))}


def test_no_leg_shows_what_a_user_may_not_read(spark, store):
    ask = "Which cluster does PayService helper settle belong to?"
    queries = spark.createDataFrame([("one", ask, "t", "main", "a", None), ("two", ask, "t", "main", "b", None), ("other", ask, "u", "main", "c", None), ("nobody", ask, "t", "main", "x", None), ("none", ask, "t", "main", "d", None)], "query_id string, query string, tenant_id string, branch string, user_id string, project_ids array<string>")
    perms = spark.createDataFrame([("t", "a", ["1"]), ("t", "b", ["2"]), ("u", "c", ["3"]), ("t", "d", [])], "tenant_id string, user_id string, accessible_project_ids array<string>")
    hits = search.search(queries, tables(store), permissions=perms, top_k=20).select("query_id", "repo_path_with_namespace", "chunk_kind").collect()
    seen = {}
    for r in hits:
        seen.setdefault(r.query_id, set()).add((r.repo_path_with_namespace, r.chunk_kind == "community_summary"))
    assert seen == {q: {(f"group/{p}", False), (f"group/{p}", True)} for q, p in (("one", 1), ("two", 2), ("other", 3))}


def test_community_leg_filters_before_its_cut(spark):
    rows = [("t", str(p), "main", f"k{p}", "pay cluster", "pay " * (9 - p), [1.0, p / 10]) for p in range(8)]
    communities = spark.createDataFrame(rows, "tenant_id string, gitlab_project_id string, branch string, community_id string, label string, summary string, embedding_dense array<double>")
    queries = spark.createDataFrame([("q", "pay", [1.0, 0.0])], "query_id string, query string, embedding array<double>")
    granted = spark.createDataFrame([("q", "t", "main", "7")], "query_id string, tenant_id string, branch string, project_id string")
    assert [r.doc_id for r in legs.community_search(communities, queries, 1, granted).collect()] == ["k7"]
    assert legs.community_search(communities, queries, 3).count() == 3


def test_communities_are_rebuilt_by_scope(spark, store, tmp_path):
    before = store.read("communities").collect()
    assert all(len(r.embedding_dense) == DENSE for r in before)
    own = T.Store(spark, str(tmp_path / "t"))
    for n in ("symbols", "edges", "communities"):
        own.publish(n, store.read(n))
    own.publish("symbols", store.read("symbols").where("gitlab_project_id <> '1'"))
    scope = spark.createDataFrame([("t", "1", "main")], "tenant_id string, gitlab_project_id string, branch string")
    assert incremental.rebuild_communities(own, scope) == 2
    assert {r.gitlab_project_id for r in own.read("communities").collect()} == {"2", "3"}
    symbols, edges = T.read_graph(store, "t", "2", "main")
    assert {r.gitlab_project_id for r in symbols.collect()} == {"2"} == {r.gitlab_project_id for r in edges.collect()}
    assert graph.community_rows(symbols, edges).count() == 1


def test_a_worker_runs_jobs_and_records_failures(spark, tmp_path):
    store = T.Store(spark, str(tmp_path / "t"))
    assert jobs.work(store, "w", {}, wait=0.0, polls=1) == 0
    empty = spark.createDataFrame([], "job_id string, job_type string, payload string, submitted_at timestamp, status string, attempts int, started_at timestamp, locked_by string, lock_expires_at timestamp, finished_at timestamp, error_message string")
    new = spark.createDataFrame([("a", "full", "{}"), ("b", "incremental", '{"full_if_empty": true}'), ("c", "incremental", '{"changes": [1]}')], "job_id string, job_type string, payload string").withColumn("submitted_at", F.lit("2024-01-01").cast("timestamp"))
    store.publish("job_status", jobs.enqueue(empty, new))
    ran = []

    def full(job):
        ran.append(job["job_id"])
        return {"indexed": 1}

    assert jobs.work(store, "w", {"full": full, "incremental": lambda job: 1 / 0}, wait=0.0, polls=4) == 3
    assert ran == ["a", "b"]
    assert {r.job_id: (r.status, r.locked_by) for r in store.read("job_status").collect()} == {"a": ("succeeded", None), "b": ("succeeded", None), "c": ("failed", None)}
    assert {r.job_id: r.error_message for r in store.read("job_results").collect()} == {"a": None, "b": None, "c": "division by zero"}


def test_model_answers(spark):
    queries = spark.createDataFrame([("q", "what"), ("r", "boom"), ("none", "x")], "query_id string, query string")
    rows = [(q, "c", 1, 1.0, "g/r", "a.py", 1, 2, "f", "u", "body") for q in ("q", "r")]
    hits = spark.createDataFrame(rows, "query_id string, chunk_id string, final_rank int, score double, repo_path_with_namespace string, file_path string, line_start int, line_end int, symbol_name string, blob_url string, text string")

    def model(asked):
        if asked[0][0] == "boom":
            raise OSError("no such host")
        return [f"{q}: {c[:3]}" for q, c in asked]

    got = {r.query_id: (r.answer, r.grounded) for r in assemble.model_answer(queries, hits, model, batch=1).collect()}
    assert got["q"] == ("what: [1]", True) and got["none"] == (assemble.NO_HITS, False)
    assert got["r"][0].startswith(assemble.ANSWER_HEAD) and got["r"][1]


def test_embedding_providers(spark):
    rows = spark.createDataFrame([(1, "foo bar"), (2, "baz")], "i int, text string")
    plain = {r.i: r.embedding for r in vector.embed_with(rows, "hash", dim=8).collect()}
    assert plain == {r.i: r.embedding for r in vector.embed_with(rows, dim=8).collect()}

    def down(texts):
        raise OSError("no such host")

    assert plain == {r.i: r.embedding for r in vector.embed_with(rows, "http", dim=8, remote=down).collect()}
    assert {tuple(r.embedding) for r in vector.embed_with(rows, "local", dim=3, model=lambda ts: [[1.0] for _ in ts]).collect()} == {(1.0, 0.0, 0.0)}
    for bad in ("local", "other"):
        with pytest.raises(ValueError):
            vector.embed_with(rows, bad)


def test_command_line(spark, tmp_path, capsys):
    folder, root = tmp_path / "src", str(tmp_path / "tables")
    folder.mkdir()
    (folder / "pay.py").write_text(CODE.format("Pay"))

    def said(*argv):
        found = cli.run(spark, cli.parser().parse_args(argv))
        return found if isinstance(found, list) else [json.loads(x) for x in found.toJSON().collect()]

    index = ("index-project", "--root", root, "--folder", str(folder), "--repo", "group/pay", "--project", "1")
    done = said(*index)[0]
    assert done["status"] == "succeeded" and done["files"] == 1 and done["communities"] == 1
    assert {r["table"]: r["version"] for r in said("tables", "--root", root)}["chunks"] == 1
    (tmp_path / "p.json").write_text('{"tenant_id": "default", "user_id": "a", "accessible_project_ids": ["1"]}\n')
    assert said("sync-permissions", "--root", root, "--file", str(tmp_path / "p.json")) == [{"permissions": 1}]
    hits = said("search", "--root", root, "--query", "Where is PayService implemented?", "--user", "a", "--top", "3")
    assert hits[0]["symbol_name"] == "PayService" and len(hits) == 3
    assert said("search", "--root", root, "--query", "PayService", "--user", "b") == []
    assert "PayService" in said("answer", "--root", root, "--query", "Where is PayService implemented?")[0]["answer"]
    (tmp_path / "g.json").write_text('{"cases": [{"query": "PayService", "relevant": ["pay.py"]}]}')
    assert said("evaluate", "--root", root, "--cases", str(tmp_path / "g.json"))[0]["hit_at_k"] == 1.0
    (folder / "pay.py").unlink()
    (folder / "new.py").write_text("def fresh():\n    return 1\n")
    (tmp_path / "c.json").write_text('{"diffs": [{"old_path": "pay.py", "new_path": "new.py", "renamed_file": true}]}')
    now = said("incremental-index", "--root", root, "--folder", str(folder), "--repo", "group/pay", "--project", "1", "--changes", str(tmp_path / "c.json"))[0]
    assert now["deleted"]["files"] == 1 and now["files"] == 1
    assert said("rebuild-communities", "--root", root) == [{"communities": 0}]
    assert said("reindex", "--root", root, "--only", "files")[0]["files"] == 1
    (tmp_path / "push.json").write_text('{"commits": [{"added": ["x"]}]}')
    assert said("webhook-payload-changes", "--file", str(tmp_path / "push.json"))[0]["new_path"] == "x"
