from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import identity as I
from lodestone.functions import querytext as Q
from lodestone.functions.secrets import findings


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first().x


def test_stable_id_takes_falsy_parts_as_empty(spark):
    want = hashlib.sha256("\x1f".join(["t", "", "", "", "7"]).encode()).hexdigest()
    assert one(spark, I.stable_id("t", None, 0, "", F.col("n")), n=7) == want
    assert one(spark, I.line_part(F.col("n")), n=0) == ""


def test_names_and_urls(spark):
    f = I.symbol_fqn(F.lit("group/pay"), F.col("p"), F.col("parent"), F.lit("run"))
    assert one(spark, f, p="src/svc.PY", parent="Service") == "group.pay.src.svc.PY.Service.run"  # only a lower-case ending is taken off
    assert one(spark, f, p="src/svc.py", parent="Service") == "group.pay.src.svc.Service.run"
    assert one(spark, f, p="src/svc.py", parent="") == "group.pay.src.svc.run"
    assert one(spark, I.blob_url(F.lit("https://x/"), F.lit("g/r"), F.lit("abc"), F.col("p"), F.lit(1), F.lit(3)), p="a.py") == "https://x/g/r/-/blob/abc/a.py#L1-L3"


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("who is the owner of payments", "ownership_question"),
        ("Where is PaymentService implemented", "definition_lookup"),
        ("who calls charge", "usage_lookup"),
        ("which endpoint creates users", "api_question"),
        ("what setting controls retries", "config_question"),
        ("coverage of refunds", "test_question"),
        ("how do we deploy", "deployment_question"),
        ("debug the crash", "debugging_question"),
        ("which table holds orders", "migration_question"),
        ("how does it all work", "architecture_question"),
        ("steam engines", "ownership_question"),
    ],
)
def test_query_classes(spark, query, want):
    assert one(spark, Q.classify_query(F.col("q")), q=query) == want


def test_identifiers(spark):
    got = one(spark, Q.identifiers(F.col("q")), q="Where is `PaymentService` and payments.api.Client used by PaymentService?")
    assert got == ["PaymentService", "payments.api.Client"]
    assert one(spark, Q.identifiers(F.col("q")), q="how does it all work") == []


@pytest.mark.parametrize(
    ("query", "want"),
    [
        ("auth", "auth authentication authorization"),
        ("getUserById", "getUserById get user by id"),
        ("auth db", "auth db authentication authorization database"),
        ("one two three four five six", "one two three four five six"),
        ("payment", "payment"),
        ("user_service", "user_service user service"),
    ],
)
def test_expansion(spark, query, want):
    got = one(spark, Q.expand_query(F.col("q")), q=query)
    assert got.split()[: len(query.split())] == query.split()
    assert set(want.split()) == set(got.split())


def test_request_bounds(spark):
    e = Q.request_error(F.col("q"), F.array(), F.array(), F.col("k"))
    assert one(spark, e, q="x", k=8) is None
    assert "top_k" in one(spark, e, q="x", k=51)
    assert "query" in one(spark, e, q="", k=8)


@pytest.mark.parametrize(
    ("path", "content", "size", "want"),
    [
        ("node_modules/x.js", "a", 1, "vendor"),
        ("a.py", "a", 800_000, "large_unknown"),
        ("a.py", "a\0b", 3, "binary"),
        ("a.py", "# @generated", 9, "generated"),
        (".github/x.py", "a", 1, "ci_cd"),
        ("ops/Dockerfile", "a", 1, "deployment"),
        ("db/migrations/1.py", "a", 1, "migration"),
        ("q.sql", "a", 1, "schema"),
        ("readme.md", "a", 1, "documentation"),
        ("a.yml", "a", 1, "config"),
        ("tests/a.py", "a", 1, "test_code"),
        ("src/a.py", "a", 1, "source_code"),
        ("LICENSE", "a", 1, "unknown"),
        ("a.zig", "a", 1, "config"),
        ("a.py", None, 1, "binary"),
    ],
)
def test_file_classes(spark, path, content, size, want):
    rows = spark.createDataFrame([(path, content, size)], "p string, c string, s long")
    assert rows.select(C.classify_file(F.col("p"), F.col("s"), F.col("c")).alias("x")).first().x == want


def test_languages(spark):
    assert one(spark, C.path_language(F.col("p")), p="a/B.PY") == "python"
    assert one(spark, C.path_language(F.col("p")), p="a/x.zig") == "zig"
    assert one(spark, C.path_language(F.col("p")), p="a/.env") == "text"


def test_a_token_in_an_assignment_is_one_secret(spark):
    text = 'API_TOKEN = "ghp_' + "a1" * 18 + '"\nx = 1'
    got = one(spark, findings(F.col("t")), t=text)
    assert got["count"] == 1 and got["high"] == 1 and got["types"] == ["github_token"]
    assert "ghp_" not in got["text"] and "[REDACTED_SECRET]" in got["text"]
    none = one(spark, findings(F.col("t")), t="nothing here")
    assert none["count"] == 0 and none["text"] == "nothing here" and none["types"] == []
