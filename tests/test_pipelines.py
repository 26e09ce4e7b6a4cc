from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lodestone.operators.vector import DENSE, hash_embedding
from lodestone.plans import ingest, search
from lodestone.sources import files as S
from lodestone.sources import tables as T
from lodestone.streaming import incremental, jobs, ratelimit

FILE = "tenant_id string, gitlab_project_id string, repo_path_with_namespace string, branch string, commit_sha string, file_path string, content string, size_bytes long"
PAYMENTS = '''import stripe

class PaymentService:
    """Charges cards."""

    def charge(self, card):
        return helper(card)

def helper(card):
    return stripe.pay(card)
'''
LEAK = 'def token():\n    return "ghp_' + "a" * 36 + '"\n'


def file_rows(spark, pairs):
    return spark.createDataFrame([("t", "1", "group/payments", "main", "abc", p, c, len(c)) for p, c in pairs], FILE)


@pytest.fixture(scope="module")
def built(spark):
    rows = file_rows(spark, [("src/pay.py", PAYMENTS), ("src/leak.py", LEAK), ("tests/test_pay.py", "def test_charge():\n    charge()\n"), ("app.yml", "a: 1\nb: '/api/x'"), ("node_modules/a.js", "x"), ("readme.md", "# Title\ntext")])
    meta = spark.createDataFrame([("group/payments", "team-pay")], "repo_path_with_namespace string, team_owner string")
    return {k: v.cache() for k, v in ingest.ingest(rows, metadata=meta).items()}


def test_chunks(built):
    got = {(r.file_path, r.symbol_name): r for r in built["chunks"].collect()}
    assert ("node_modules/a.js", None) not in got
    service, charge = got["src/pay.py", "PaymentService"], got["src/pay.py", "charge"]
    assert charge.symbol_fqn == "group.payments.src.pay.PaymentService.charge" and charge.parent_chunk_id == service.chunk_id and service.parent_chunk_id is None
    assert charge.blob_url.endswith("/group/payments/-/blob/abc/src/pay.py#L6-L7")
    assert service.text.startswith("Repository: group/payments\nPath: src/pay.py\nLanguage: python\nKind: class_definition\nLine range: 3-7\nSymbol: PaymentService\n") and "Team owner: team-pay" in service.text and "\n\nCode:\nclass PaymentService" in service.text
    leak = got["src/leak.py", "token"]
    assert leak.secret_high_confidence_count == 1 and "ghp_" not in leak.text
    assert got["readme.md", "Title"].chunk_kind == "documentation_section"


def test_symbols_and_edges(built):
    names = {r.symbol_fqn for r in built["symbols"].collect()}
    assert "group.payments.src.pay.PaymentService" in names
    e = {(r.source_file_path, r.edge_type, r.target_symbol_fqn): r.confidence for r in built["edges"].collect()}
    assert e["src/pay.py", "CALLS", "helper"] == 0.55 and e["src/pay.py", "IMPORTS", "stripe"] == 0.65
    assert e["tests/test_pay.py", "TESTS", "test_charge"] == 0.45 and e["app.yml", "CONFIGURES", "app.yml"] == 0.4
    assert e["app.yml", "EXPOSES_ENDPOINT", "/api/x"] == 0.7
    files = {r.file_path: r for r in built["files"].collect()}
    assert files["src/pay.py"].defined_symbols[0].startswith("group.payments.src.pay.") and files["src/leak.py"].secret_findings_count == 1


def test_chunks_with_secrets_can_go(built):
    c, s, e = ingest.drop_secret_chunks(built["chunks"], built["symbols"], built["edges"])
    assert c.where("file_path = 'src/leak.py'").count() == 0 and s.where("symbol_name = 'token'").count() == 0 and e.where("source_file_path = 'src/leak.py'").count() == 0


def test_search(spark, built):
    vec = built["chunks"].select("chunk_id", hash_embedding(DENSE)(F.col("text")).alias("dense"))
    queries = spark.createDataFrame([("q1", "Where is PaymentService implemented?", "t", "main", "u", None), ("q2", "PaymentService", "t", "main", "nobody", None)], "query_id string, query string, tenant_id string, branch string, user_id string, project_ids array<string>")
    perms = spark.createDataFrame([("t", "u", ["1"])], "tenant_id string, user_id string, accessible_project_ids array<string>")
    tables = {k: built[k] for k in ("chunks", "symbols", "edges")} | {"chunk_vec": vec}
    got = search.search(queries, tables, permissions=perms, top_k=3).orderBy("query_id", "final_rank").collect()
    assert {r.query_id for r in got} == {"q1"} and got[0].symbol_name == "PaymentService" and len(got) == 3


def test_store(spark, tmp_path):
    store = T.Store(spark, str(tmp_path / "tables"))
    assert store.version("repos") == 0 and store.read("repos") is None
    store.ensure("repos", "repo_id string, n int")
    store.upsert("repos", spark.createDataFrame([("a", 1), ("b", 1)], "repo_id string, n int"))
    now = store.upsert("repos", spark.createDataFrame([("b", 2), ("c", 2)], "repo_id string, n int"))
    assert sorted((r.repo_id, r.n) for r in now.collect()) == [("a", 1), ("b", 2), ("c", 2)]
    assert spark.table("repos").count() == 3 and store.version("repos") == 3
    assert store.reindex(["repos", "files"]) == {"repos": 3} and store.version("repos") == 4
    store.prune("repos", keep=1)
    assert store.read("repos").count() == 3
    assert T.lookup(store.read("repos"), spark.createDataFrame([("a",), ("zz",)], "repo_id string"), "repo_id", ["n"]).where("n is null").count() == 1


def test_full_index_replaces_files(spark, tmp_path):
    store = T.Store(spark, str(tmp_path / "tables"))
    first = incremental.index_repository(store, file_rows(spark, [("a.py", "def f(): pass\ndef g(): pass"), ("b.py", "def h(): pass")]), ingest.ingest)
    assert first["files"] == 2 and first["chunks"] == 3
    again = incremental.index_repository(store, file_rows(spark, [("a.py", "def f(): pass")]), ingest.ingest)
    assert again["files"] == 2 and again["chunks"] == 2  # b.py is kept: only paths that were walked are touched
    assert incremental.guarded(lambda: 1 / 0)["status"] == "failed" and incremental.guarded(dict)["status"] == "succeeded"


def test_full_index_deletes_what_is_not_indexed_any_more(spark, tmp_path):
    store = T.Store(spark, str(tmp_path / "tables"))
    incremental.index_repository(store, file_rows(spark, [("a.py", "import x\ndef f(): g()"), ("b.py", "def h(): pass")]), ingest.ingest)
    large = file_rows(spark, [("a.py", "import x\ndef f(): g()")]).withColumn("size_bytes", F.lit(750_001).cast("long"))
    assert incremental.index_repository(store, large, ingest.ingest)["files"] == 1
    for name, path in (("files", "file_path"), ("chunks", "file_path"), ("symbols", "definition_file_path"), ("edges", "source_file_path")):
        assert store.read(name).where(F.col(path) == "a.py").isEmpty()


def test_walk_lists_empty_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "deep" / "a.py").write_bytes(b"x")
    (tmp_path / "deep" / "b.txt").write_bytes(b"")
    got = {r.file_path: (r.size_bytes, bytes(r.raw)) for r in S.walk(spark, str(tmp_path)).collect()}
    assert got == {"deep/a.py": (1, b"x"), "deep/b.txt": (0, b"")}


def test_stream_of_files(spark, tmp_path):
    store = T.Store(spark, str(tmp_path / "tables"))
    source = tmp_path / "in"
    file_rows(spark, [("a.py", "def f(): pass")]).write.parquet(str(source))
    rows = spark.readStream.schema(FILE).parquet(str(source))
    q = incremental.index_stream(rows, store, ingest.ingest, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert store.read("chunks").count() == 1


def test_walk_and_decode(spark, tmp_path):
    (tmp_path / "src" / "deep").mkdir(parents=True)
    (tmp_path / "src" / "deep" / "a.py").write_bytes(b"x\r\ny\xff\rz")
    (tmp_path / "b.txt").write_bytes(b"")
    got = {r.file_path: r for r in S.walk(spark, str(tmp_path)).select("file_path", "size_bytes", S.decode_text(F.col("raw")).alias("t"), S.split_lines(S.decode_text(F.col("raw"))).alias("l")).collect()}
    assert got["src/deep/a.py"].t == "x\ny\nz" and got["src/deep/a.py"].size_bytes == 7 and set(got) == {"src/deep/a.py", "b.txt"} and got["b.txt"].t == ""
    facts = S.file_facts(spark.createDataFrame([("a\x0cb c\n",)], "content string")).first()
    assert facts.line_count == 3


def test_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"repos": [{"repo_path_with_namespace": "a", "team_owner": "x"}, {"repo_path_with_namespace": "a", "team_owner": "y"}]}')
    (tmp_path / "m.toml").write_text('[[repos]]\nrepo_path_with_namespace = "b"\nservice_name = "s"\n')
    assert [r.team_owner for r in S.repo_metadata(spark, str(tmp_path / "m.json")).collect()] == ["y"]
    assert S.repo_metadata(spark, str(tmp_path / "m.toml")).first().service_name == "s"
    with pytest.raises(ValueError):
        S.repo_metadata(spark, str(tmp_path / "m.yaml"))


def test_changes(spark):
    compare = '{"diffs": [{"old_path": "a", "new_path": "b", "renamed_file": true}, {"old_path": null, "new_path": "c", "new_file": true}, {"old_path": "d", "new_path": "d"}]}'
    push = '{"commits": [{"added": ["x"], "modified": ["y"], "removed": ["z"]}, {"added": []}]}'
    row = spark.createDataFrame([(compare, push)], "c string, p string").select(S.changes_from_compare(F.col("c")).alias("c"), S.changes_from_push(F.col("p")).alias("p")).first()
    assert [(x.old_path, x.new_path, x.renamed, x.added, x.modified) for x in row.c] == [("a", "b", True, False, False), ("c", "c", False, True, False), ("d", "d", False, False, True)]
    assert [(x.new_path, x.added, x.deleted, x.modified) for x in row.p] == [("x", True, False, False), ("y", False, False, True), ("z", False, True, False)]
    pages = {1: (["{}", "{}"], 2), 2: (["{}"], None)}
    assert S.paged(spark, pages.__getitem__).count() == 3


def test_jobs(spark):
    now = F.lit("2024-01-01 01:00:00").cast("timestamp_ntz")
    empty = spark.createDataFrame([], "job_id string, submitted_at timestamp_ntz, status string, attempts int, locked_by string, lock_expires_at timestamp_ntz, started_at timestamp_ntz, finished_at timestamp_ntz, error_message string")
    new = spark.sql("select * from values ('b', timestamp_ntz'2024-01-01 00:00:02'), ('a', timestamp_ntz'2024-01-01 00:00:01'), ('a', timestamp_ntz'2024-01-01 00:00:03') as t(job_id, submitted_at)")
    status = jobs.enqueue(empty, new)
    assert status.count() == 2 and jobs.enqueue(status, new).count() == 2
    mine, status = jobs.claim(status, "w1", now, 60)
    assert mine.first().job_id == "a" and mine.first().attempts == 1
    other, status = jobs.claim(status, "w2", now, 60)
    assert other.first().job_id == "b" and jobs.claim(status, "w3", now, 60)[0].isEmpty()
    later = F.lit("2024-01-01 02:00:00").cast("timestamp_ntz")
    assert jobs.claim(status, "w3", later, 60)[0].first().attempts == 2  # the lease has run out
    done = jobs.finish(status, spark.createDataFrame([("a", "succeeded", None), ("b", "crashed", "boom")], "job_id string, status string, error_message string"), later)
    assert {r.job_id: r.status for r in done.collect()} == {"a": "succeeded", "b": "failed"} and done.where("locked_by is not null").isEmpty()
    again = {r.job_id: r.status for r in jobs.enqueue(done, new).collect()}
    assert again == {"a": "succeeded", "b": "queued"}


def test_push_events(spark):
    body = '{"ref": "refs/heads/%s", "before": "%s", "after": "2", "project": {"id": "7", "path_with_namespace": "g/p"}}'
    rows = spark.createDataFrame([(body % ("main", "1"), "s"), (body % ("dev", "1"), "s"), (body % ("main", ""), "s"), (body % ("main", "1"), "bad"), ("junk", "s")], "body string, token string")
    assert [r.gitlab_project_id for r in jobs.push_events(rows, "main", "s").collect()] == ["7"]


def test_rate_limit(spark):
    calls = [("alice", 1000.0), ("alice", 1000.5), ("alice", 1001.0), ("alice", 1001.5), ("bob", 1001.0), ("c", 100.0), ("c", 105.0), ("c", 111.0), ("c", 112.0)]
    rows = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(calls)], "call_id long, key string, now double")
    got = {r.call_id: r.allowed for r in ratelimit.limit(rows, 2, 60.0).collect()}
    assert [got[i] for i in range(5)] == [True, True, False, False, True]
    ten = {r.call_id: r.allowed for r in ratelimit.limit(rows.where("key = 'c'"), 1, 10.0).collect()}
    assert ten == {5: True, 6: False, 7: True, 8: False}
    assert ratelimit.decide([1, 1, 1], 0, 5)[0] == [True] * 3


def test_rate_limit_stream(spark, tmp_path):
    rows = spark.createDataFrame([(0, "a", 1.0), (1, "a", 2.0), (2, "a", 3.0), (3, "b", 3.0)], "call_id long, key string, now double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = ratelimit.limit_stream(stream, 2, 60.0).writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.call_id: r.allowed for r in spark.table("limited").collect()} == {0: True, 1: True, 2: False, 3: True}
