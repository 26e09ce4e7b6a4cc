"""Queries over texts, paths and ids: analysis, classification, chunking, secrets, routes, rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions import identity as I
from lodestone.functions import querytext as Q
from lodestone.functions.secrets import ANY, PATTERNS, PLACEHOLDER, findings
from lodestone.operators.chunking import MAX_CHARS
from lodestone.plans import ingest
from lodestone.plans.book import Book, table
from lodestone.sources.files import split_lines

BOOK = Book()
ENDINGS = [".py", ".md", ".yml", ".test.ts", ".sql", "", ".zig", ".java"]
FOLDERS = ["src", "tests", "node_modules", ".github", "deploy", "migrations", "docs"]
_ENDINGS_SQL = "[" + ", ".join(f"'{x}'" for x in ENDINGS) + "]"
_FOLDERS_SQL = "[" + ", ".join(f"'{x}'" for x in FOLDERS) + "]"
PATH_SQL = f"source || '/' || {_FOLDERS_SQL}[(doc_id % 7 + 1)::INT] || '/Doc' || doc_id || {_ENDINGS_SQL}[(doc_id % 8 + 1)::INT]"


def _quoted(xs: list[str]) -> str:
    return ", ".join("'" + x.replace("'", "''") + "'" for x in xs)


def as_files(docs: DataFrame) -> DataFrame:
    """documents as the files of repositories: a source is a repository, an id chooses folder and ending."""
    pick = lambda xs, n: F.element_at(F.array(*(F.lit(x) for x in xs)), (F.col("doc_id") % n + 1).cast("int"))
    path = F.concat(F.col("source"), F.lit("/"), pick(FOLDERS, 7), F.lit("/Doc"), F.col("doc_id"), pick(ENDINGS, 8))
    return docs.select("doc_id", F.lit("default").alias("tenant_id"), F.col("source").alias("gitlab_project_id"), F.concat(F.lit("group/"), F.col("source")).alias("repo_path_with_namespace"), F.lit("main").alias("branch"), F.lit("abc123").alias("commit_sha"), path.alias("file_path"), F.col("text").alias("content"), F.col("n_chars").alias("size_bytes"))


@BOOK.query(
    "SELECT conv_id, turn, CASE "
    + " ".join("WHEN " + " OR ".join(f"contains(lower(text), '{t}')" for t in terms) + f" THEN '{name}'" for name, terms in Q.QUERY_TERMS)
    + f" ELSE '{Q.OTHERWISE}' END AS query_type FROM conversations WHERE role = 'user'"
)
def classify_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").where("role = 'user'")
    return rows.select("conv_id", "turn", Q.classify_query(F.col("text")).alias("query_type"))


@BOOK.query(
    "SELECT page_id, array_to_string(list_filter(ids, lambda x, i: list_position(ids, x) = i), ' ') AS identifiers FROM (SELECT page_id, list_filter(list_transform(regexp_extract_all(url, '"
    + Q.IDENTIFIER
    + f"'), lambda x: trim(x, '`''\"')), lambda x: len(x) > 0 AND NOT list_contains([{_quoted(Q.STOP_WORDS)}], x)) AS ids FROM pages)"
)
def identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(Q.identifiers(F.col("url")), " ").alias("identifiers"))


_SYNONYMS_SQL = "MAP {" + ", ".join(f"'{k}': [{_quoted(v)}]" for k, v in Q.SYNONYMS.items()) + "}"
_SHORT_SQL = "[" + _quoted(["auth db", "getUserById", "user_service impl", "payment", "api config x", "the quick brown fox"]) + "]"
SHORT = ["auth db", "getUserById", "user_service impl", "payment", "api config x", "the quick brown fox"]


@BOOK.query(
    f"""WITH q AS (SELECT p_partkey, {_SHORT_SQL}[(p_partkey % 6 + 1)::INT] || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' ' || p_brand END AS q FROM part),
t AS (SELECT *, list_filter(string_split_regex(q, '\\s+'), lambda x: len(x) > 0) AS ts FROM q),
e AS (SELECT *, flatten(list_transform(ts, lambda t: list_concat(list_transform(list_concat(list_filter(string_split_regex(regexp_replace(t, '([A-Z])', ' \\1', 'g'), '\\s+'), lambda x: len(x) > 1),
      list_filter(string_split_regex(t, '[_\\-]'), lambda x: len(x) > 1)), lambda x: lower(x)), coalesce({_SYNONYMS_SQL}[lower(t)], []::VARCHAR[])))) AS extra, list_transform(ts, lambda x: lower(x)) AS own FROM t),
n AS (SELECT *, list_filter(extra, lambda x: NOT list_contains(own, lower(x))) AS fresh FROM e)
SELECT p_partkey, CASE WHEN len(ts) >= 4 OR len(fresh) = 0 THEN q ELSE q || ' ' || array_to_string(fresh, ' ') END AS expanded FROM n"""
)
def expand_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = F.element_at(F.array(*(F.lit(x) for x in SHORT)), (F.col("p_partkey") % 6 + 1).cast("int"))
    q = F.concat(short, F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.concat(F.lit(" "), F.col("p_brand"))))
    return table(spark, sf_dir, "part").select("p_partkey", Q.expand_query(q).alias("expanded"))


_LANGUAGES_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in C.LANGUAGES.items()) + "}"


@BOOK.query(f"WITH p AS (SELECT doc_id, lower(regexp_extract({PATH_SQL}, '^.*[^/](\\.[^./]+)$', 1)) AS e FROM documents) SELECT doc_id, coalesce({_LANGUAGES_SQL}[e], nullif(substr(e, 2), ''), 'text') AS language FROM p")
def path_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = as_files(table(spark, sf_dir, "documents"))
    return files.select("doc_id", C.path_language(F.col("file_path")).alias("language"))


@BOOK.query(
    f"""WITH p AS (SELECT doc_id, lower({PATH_SQL}) AS p, n_chars AS size, text FROM documents),
f AS (SELECT *, string_split(p, '/') AS parts, regexp_extract(p, '^.*[^/](\\.[^./]+)$', 1) AS e, string_split(p, '/')[-1] AS name, lower(text[1:2048]) AS head FROM p),
c AS (SELECT *, CASE WHEN list_has_any(parts, [{_quoted(C.VENDOR_DIRS)}]) THEN 'vendor' WHEN size > {C.MAX_FILE_BYTES} THEN 'large_unknown' WHEN text IS NULL OR contains(text[1:4096], chr(0)) THEN 'binary'
 WHEN {" OR ".join(f"contains(head, '{m}')" for m in C.GENERATED_MARKERS)} THEN 'generated' WHEN list_has_any(parts, [{_quoted(C.CI_DIRS)}]) OR name = '.gitlab-ci.yml' THEN 'ci_cd'
 WHEN name IN ({_quoted(C.DEPLOYMENT_NAMES)}) OR list_has_any(parts, ['deploy', 'helm']) THEN 'deployment' WHEN list_has_any(parts, ['migration', 'migrations']) THEN 'migration'
 WHEN e IN ({_quoted(C.SCHEMA_EXTENSIONS)}) THEN 'schema' WHEN e IN ({_quoted(C.DOC_EXTENSIONS)}) THEN 'documentation' WHEN e IN ({_quoted([*C.CONFIG_EXTENSIONS, ".yml", ".yaml", ".xml"])}) THEN 'config'
 WHEN list_has_any(parts, ['test', 'tests']) OR starts_with(name, 'test_') OR ends_with(name, '_test.py') OR ends_with(name, '.test.ts') OR ends_with(name, '.spec.ts') OR ends_with(name, 'test.java') THEN 'test_code'
 WHEN e IN ({_quoted(C.SOURCE_EXTENSIONS)}) THEN 'source_code' WHEN e = '' THEN 'unknown' ELSE 'config' END AS file_class FROM f)
SELECT doc_id, file_class, NOT list_has_any(parts, [{_quoted(C.VENDOR_DIRS)}]) AND size <= {C.MAX_FILE_BYTES} AND file_class NOT IN ({_quoted(C.NOT_INDEXED)}) AS indexed,
 file_class = 'test_code' AS is_test, file_class IN ('config', 'ci_cd', 'deployment', 'schema') AS is_config FROM c"""
)
def classify_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = as_files(table(spark, sf_dir, "documents"))
    path, size = F.col("file_path"), F.col("size_bytes")
    rows = files.withColumn("file_class", C.classify_file(path, size, F.col("content")))
    flags = C.flags(F.col("file_class"))
    return rows.select("doc_id", "file_class", C.should_index(path, size, F.col("file_class")).alias("indexed"), flags["is_test"].alias("is_test"), flags["is_config"].alias("is_config"))


@BOOK.query(
    f"""WITH p AS (SELECT doc_id, source, {PATH_SQL} AS p, text, n_chars % 3 AS a FROM documents)
SELECT doc_id, sha256(coalesce(text, '')) AS file_hash, sha256(array_to_string(['default', source, 'main', p, sha256(coalesce(text, '')), CASE WHEN a = 0 THEN '' ELSE a::VARCHAR END, ''], chr(31))) AS chunk_id,
 'https://git.example.com/group/' || source || '/-/blob/abc123/' || p || '#L1-L' || (a + 1) AS blob_url,
 'group.' || source || '.' || replace(regexp_replace(p, '([^/])\\.[^./]+$', '\\1'), '/', '.') || '.Outer.run' AS symbol_fqn FROM p"""
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = as_files(table(spark, sf_dir, "documents")).withColumn("a", F.col("size_bytes") % 3)
    path, digest = F.col("file_path"), I.content_hash(F.coalesce("content", F.lit("")))
    return files.select(
        "doc_id",
        digest.alias("file_hash"),
        I.stable_id("default", F.col("gitlab_project_id"), "main", path, digest, I.line_part(F.col("a")), None).alias("chunk_id"),
        I.blob_url(F.lit("https://git.example.com/"), F.col("repo_path_with_namespace"), F.lit("abc123"), path, F.lit(1), F.col("a") + 1).alias("blob_url"),
        I.symbol_fqn(F.col("repo_path_with_namespace"), path, F.lit("Outer"), F.lit("run")).alias("symbol_fqn"),
    )


_TYPES_SQL = "CASE " + " ".join(f"WHEN regexp_matches(s, '{p.replace(chr(39), chr(39) * 2)}') THEN '{k}'" for k, _, p in PATTERNS if k != "assignment") + " ELSE 'assignment' END"
_ANY_SQL = ANY.replace("'", "''")


@BOOK.query(
    f"""WITH f AS (SELECT doc_id, regexp_extract_all(text, '{_ANY_SQL}') AS found, regexp_replace(text, '{_ANY_SQL}', '{PLACEHOLDER}', 'g') AS redacted FROM documents),
t AS (SELECT doc_id, string_agg(DISTINCT {_TYPES_SQL}, ',' ORDER BY {_TYPES_SQL}) AS types FROM (SELECT doc_id, unnest(found) AS s FROM f) GROUP BY doc_id)
SELECT doc_id, len(found)::BIGINT AS n, sha256(redacted) AS redacted_sha256, coalesce(types, '') AS types FROM f LEFT JOIN t USING (doc_id)"""
)
def secret_redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "documents").select("doc_id", findings(F.col("text")).alias("f"))
    return found.select("doc_id", F.col("f.count").cast("long").alias("n"), F.sha2(F.col("f.text").cast("binary"), 256).alias("redacted_sha256"), F.array_join("f.types", ",").alias("types"))


@BOOK.query("SELECT page_id, len(r)::BIGINT AS n_routes, array_to_string(list_sort(r), ' ') AS routes FROM (SELECT page_id, list_distinct(regexp_extract_all(html, '" + ingest.ROUTE.replace("'", "''") + "', 1)) AS r FROM pages)")
def route_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = table(spark, sf_dir, "pages").select("page_id", ingest.routes(F.array().cast("array<string>"), F.col("html")).alias("r"))
    return found.select("page_id", F.size("r").cast("long").alias("n_routes"), F.array_join("r", " ").alias("routes"))


@BOOK.query(
    "WITH e AS (SELECT DISTINCT page_id, url, 'EXPOSES_ENDPOINT' AS edge_type, unnest(regexp_extract_all(html, '" + ingest.ROUTE.replace("'", "''") + "', 1)) AS target FROM pages UNION SELECT page_id, url, 'IMPORTS', split_part(url, '/', 3) FROM pages "
    "UNION SELECT page_id, url, 'TESTS', 'page' || page_id FROM pages WHERE page_id % 2 = 0 UNION SELECT page_id, url, 'CONFIGURES', url FROM pages WHERE page_id % 3 = 0) "
    "SELECT page_id, edge_type, target, CASE edge_type " + " ".join(f"WHEN '{k}' THEN {v}::DOUBLE" for k, v in ingest.CONFIDENCE.items()) + " END AS confidence, sha256(array_to_string(['default', page_id::VARCHAR, 'main', url, 'c' || page_id, edge_type, target], chr(31))) AS edge_id FROM e"
)
def edge_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as chunks: routes in their code, an import of their host, some of them tests or configuration."""
    none, n = F.array().cast("array<string>"), F.col("page_id")
    chunks = table(spark, sf_dir, "pages").select(
        F.lit("default").alias("tenant_id"), n.alias("gitlab_project_id"), F.lit("main").alias("branch"), F.lit("abc").alias("commit_sha"), F.concat(F.lit("c"), n).alias("chunk_id"), F.lit(None).cast("string").alias("symbol_fqn"), F.lit("g/r").alias("repo_path_with_namespace"), F.col("url").alias("file_path"),
        F.lit(1).alias("line_start"), F.array(F.split_part("url", F.lit("/"), F.lit(3))).alias("imports"), none.alias("calls"), none.alias("references"), none.alias("decorators"), F.col("html").alias("code"), (n % 2 == 0).alias("is_test"), F.concat(F.lit("page"), n).alias("symbol_name"), (n % 3 == 0).alias("is_config"),
    )
    return ingest.edge_rows(chunks).select(F.col("gitlab_project_id").alias("page_id"), "edge_type", F.col("target_symbol_fqn").alias("target"), "confidence", "edge_id")


@BOOK.query("SELECT doc_id, len(string_split(rtrim_one, chr(10))) * (text <> '')::INT AS line_count, strlen(text)::BIGINT AS size_bytes FROM (SELECT doc_id, text, regexp_replace(text, '\\n$', '') AS rtrim_one FROM documents)")
def file_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.size(split_lines(F.col("text"))).alias("line_count"), F.octet_length("text").cast("long").alias("size_bytes"))


@BOOK.query(
    "SELECT conv_id, array_to_string(list_sort(list_distinct(list(role))), ',') AS symbols, count(*) AS n_chunks, sum(length(text))::BIGINT AS findings, sha256(string_agg(turn::VARCHAR, ',' ORDER BY turn)) AS chunks_sha256, array_to_string(list_sort(list_distinct(list(text[1:8]))), ',') AS referenced FROM conversations GROUP BY conv_id"
)
def file_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as files, their turns as chunks."""
    turns = table(spark, sf_dir, "conversations").select(
        *(F.lit("x").alias(k) for k in ingest.KEYS if k != "file_path"), F.col("conv_id").cast("string").alias("file_path"), F.col("turn").alias("ordinal"), F.col("turn").cast("string").alias("chunk_id"), F.col("role").alias("symbol_fqn"),
        F.array(F.substring("text", 1, 8)).alias("references"), F.array().cast("array<string>").alias("imports"), *(F.char_length("text").alias(c) for c in ("secret_findings_count", "secret_redactions_count", "secret_high_confidence_count")),
    )
    got = ingest.file_rows(turns.select(*ingest.KEYS, F.lit("").alias("content")).distinct(), turns)
    joined = lambda c: F.array_join(c, ",")
    return got.select(F.col("file_path").cast("long").alias("conv_id"), joined("defined_symbols").alias("symbols"), F.size("chunk_ids").cast("long").alias("n_chunks"), F.col("secret_findings_count").alias("findings"), F.sha2(joined("chunk_ids").cast("binary"), 256).alias("chunks_sha256"), joined("referenced_symbols").alias("referenced"))


@BOOK.query(
    f"""WITH RECURSIVE d AS (SELECT doc_id, string_split(regexp_replace(text, '\\n$', ''), chr(10)) AS ls FROM documents WHERE text <> ''),
u AS (SELECT doc_id, i, sum(len(ls[i]) + 1) OVER (PARTITION BY doc_id ORDER BY i) AS upto, len(ls) AS n FROM d, unnest(range(1, len(ls) + 1)) AS x(i)),
z AS (SELECT doc_id, i, upto, n FROM u UNION ALL SELECT doc_id, 0, 0, n FROM u WHERE i = 1),
e AS (SELECT a.doc_id, a.i AS s, a.n, coalesce((SELECT min(b.i) FROM z b WHERE b.doc_id = a.doc_id AND b.upto - a.upto >= {MAX_CHARS}), a.n) AS e FROM z a WHERE a.i < a.n),
w(doc_id, s, e, n) AS (SELECT doc_id, s, e, n FROM e WHERE s = 0 UNION ALL SELECT e.doc_id, e.s, e.e, e.n FROM w JOIN e ON e.doc_id = w.doc_id AND e.s = greatest(w.s + 1, w.e - 3))
SELECT doc_id, (s + 1)::INT AS line_start, e::INT AS line_end FROM w"""
)
def fixed_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of lines of every document, taken as configuration files."""
    files = as_files(table(spark, sf_dir, "documents")).withColumns({"language": F.lit("text"), "file_class": F.lit("config"), "file_path": F.col("doc_id").cast("string")})
    return ingest.raw_chunks(files).select(F.col("file_path").cast("long").alias("doc_id"), "line_start", "line_end")


@BOOK.query()
def ingest_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chunks of all documents taken as files, by the chunker that fits each."""
    out = ingest.ingest(as_files(table(spark, sf_dir, "documents")))["chunks"]
    return out.select("chunk_id", "file_path", "chunk_kind", "line_start", "line_end", "symbol_fqn", "secret_findings_count", F.sha2("text", 256).alias("text_sha256"))


@BOOK.query()
def hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.operators.vector import DENSE
    from lodestone.operators.vector import hash_embedding as embed

    e = table(spark, sf_dir, "benchmark").select("item_id", embed(DENSE)(F.col("text")).alias("v"))
    return e.select("item_id", F.size("v").alias("dim"), F.round(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x), 9).alias("norm"), F.size(F.filter("v", lambda x: x != 0)).alias("nonzero"))
