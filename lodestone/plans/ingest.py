"""From files to chunks, symbols, edges and file rows.

Parsing is the only step in Python: one mapInPandas over the files. Chunks, symbols and edges are
projections of the same raw chunks. Secrets are taken out of a chunk's text, signature and docstring
before anything is derived from it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions import classify as C
from lodestone.functions.identity import blob_url, content_hash, extension, line_part, raw_url, stable_id, symbol_fqn
from lodestone.functions.secrets import findings, redact
from lodestone.operators.chunking import MAX_CHARS, OVERLAP, RAW_SCHEMA, chunk_partitions
from lodestone.shipping import ship
from lodestone.sources.files import split_lines
from lodestone.sources.tables import last_written

KEYS = ["tenant_id", "gitlab_project_id", "repo_path_with_namespace", "branch", "commit_sha", "file_path"]
META = ["team_owner", "business_domain", "service_name", "slack_channel", "jira_project", "service_type", "deployment_name"]
CONFIDENCE = {"IMPORTS": 0.65, "CALLS": 0.55, "REFERENCES": 0.35, "TESTS": 0.45, "CONFIGURES": 0.4, "EXPOSES_ENDPOINT": 0.7}
ROUTE = r"['\"](/[A-Za-z0-9_./{}:-]*)['\"]"
ROUTE_WORDS = "route|get|post|put|delete|patch"


def describe_files(files: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """files (KEYS, content, size_bytes) with language, class, flags, hash, line count and repository metadata."""
    path, content = F.col("file_path"), F.col("content")
    out = files.withColumns({"language": C.path_language(path), "file_class": C.classify_file(path, F.col("size_bytes"), content), "file_extension": extension(path), "file_name": F.element_at(F.split(path, "/"), -1), "file_hash": content_hash(content), "line_count": F.size(split_lines(content))})
    out = out.withColumns(C.flags(F.col("file_class")))
    if metadata is not None:
        out = out.join(metadata, "repo_path_with_namespace", "left")
    return out.withColumns({m: F.lit(None).cast("string") for m in META if m not in out.columns})


def indexable(described: DataFrame) -> DataFrame:
    return described.where(C.should_index(F.col("file_path"), F.col("size_bytes"), F.col("file_class")))


def raw_chunks(described: DataFrame, most: int = MAX_CHARS, overlap: int = OVERLAP) -> DataFrame:
    """(KEYS, ordinal, raw chunk columns)"""
    ship(described.sparkSession)
    schema = ", ".join(f"{k} string" for k in KEYS) + ", ordinal int, " + RAW_SCHEMA
    keys = list(KEYS)
    rows = described.select(*(F.col(k).cast("string") for k in KEYS), "language", "file_class", "content")
    return rows.mapInPandas(lambda frames: chunk_partitions(frames, keys, most, overlap), schema)


def header() -> Column:
    """The lines that stand above a chunk's code; those without a value are left out."""
    named = F.coalesce(F.length("symbol_name"), F.lit(0)) > 0
    line = lambda label, c: F.when(F.coalesce(F.length(c.cast("string")), F.lit(0)) > 0, F.concat(F.lit(label + ": "), c))
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Repository: "), "repo_path_with_namespace"),
        F.concat(F.lit("Path: "), "file_path"),
        F.concat(F.lit("Language: "), "language"),
        F.concat(F.lit("Kind: "), "kind"),
        F.concat(F.lit("Line range: "), "line_start", F.lit("-"), "line_end"),
        F.when(named, F.concat(F.lit("Symbol: "), "symbol_name")),
        F.when(named, F.concat(F.lit("Symbol FQN: "), "symbol_fqn")),
        F.when(named, F.concat(F.lit("Symbol kind: "), "symbol_kind")),
        line("Parent", F.col("parent_symbol")),
        line("Signature", F.col("signature")),
        F.when(F.coalesce(F.size("decorators"), F.lit(0)) > 0, F.concat(F.lit("Decorators/annotations: "), F.array_join("decorators", ", "))),
        line("Team owner", F.col("team_owner")),
        line("Business domain", F.col("business_domain")),
        line("Service", F.col("service_name")),
    )


def chunk_rows(raws: DataFrame, described: DataFrame, base_url: str) -> DataFrame:
    """Chunks with ids, names, URLs, enriched and redacted text, and the link to their class's chunk."""
    facts = described.select(*(F.col(k).cast("string") for k in KEYS), "language", "file_class", "file_extension", "file_hash", "is_test", "is_config", "is_migration", *META)
    out = raws.join(facts, KEYS)
    names = ["signature", "docstring"]
    out = out.withColumns({n: redact(F.col(n)) for n in names}).withColumn("found", findings(F.col("text")))
    out = out.withColumn("code", F.col("found.text")).withColumn("symbol_fqn", symbol_fqn(F.col("repo_path_with_namespace"), F.col("file_path"), F.col("parent_symbol"), F.col("symbol_name")))
    out = out.withColumn("chunk_id", stable_id(F.col("tenant_id"), F.col("gitlab_project_id"), F.col("branch"), F.col("file_path"), F.col("file_hash"), line_part(F.col("line_start")), line_part(F.col("line_end")), F.col("symbol_name")))
    base = F.lit(base_url)
    out = out.withColumns(
        {
            "enriched": F.concat(header(), F.lit("\n\nCode:\n"), F.col("code")),
            "blob_url": blob_url(base, F.col("repo_path_with_namespace"), F.col("commit_sha"), F.col("file_path"), F.col("line_start"), F.col("line_end")),
            "raw_url": raw_url(base, F.col("repo_path_with_namespace"), F.col("commit_sha"), F.col("file_path")),
            "symbol_role": F.when(F.col("symbol_fqn").isNotNull(), "definition").otherwise("none"),
            "secret_findings_count": F.col("found.count"),
            "secret_redactions_count": F.col("found.count"),
            "secret_high_confidence_count": F.col("found.high"),
            "secret_types": F.col("found.types"),
            "active_snapshot": F.lit(True),
        }
    ).withColumn("embedding_input_hash", stable_id(F.col("enriched")))
    return link_parents(out).drop("found", "text").withColumnRenamed("enriched", "text").withColumnRenamed("kind", "chunk_kind")


def link_parents(chunks: DataFrame) -> DataFrame:
    """chunks with parent_chunk_id: the last chunk of the class in the file that a chunk's outermost parent names."""
    classes = chunks.where("kind = 'class_definition' and symbol_name is not null").groupBy(*KEYS, F.col("symbol_name").alias("top")).agg(F.max_by("chunk_id", "ordinal").alias("parent_chunk_id"))
    return chunks.withColumn("top", F.substring_index("parent_symbol", ".", 1)).join(classes, [*KEYS, "top"], "left").drop("top")


def symbol_rows(chunks: DataFrame) -> DataFrame:
    """A symbol for each chunk that has one; of equal qualified names the last stays."""
    own = chunks.where("symbol_fqn is not null")
    sid = stable_id(F.col("tenant_id"), F.col("gitlab_project_id"), F.col("branch"), F.col("symbol_fqn"))
    rows = own.select(
        sid.alias("symbol_id"), "tenant_id", "gitlab_project_id", "repo_path_with_namespace", "branch", "commit_sha", "language", "symbol_name", "symbol_fqn", F.coalesce("symbol_kind", F.lit("symbol")).alias("symbol_kind"),
        F.col("file_path").alias("definition_file_path"), F.col("line_start").alias("definition_line_start"), F.col("line_end").alias("definition_line_end"), F.col("chunk_id").alias("definition_chunk_id"), F.col("blob_url").alias("definition_url"),
        F.col("parent_symbol"), "docstring", "signature", "decorators", F.struct("file_path", "ordinal").alias("written"),
    )
    return last_written(rows, ["symbol_id"], "written")


def routes(decorators: Column, code: Column) -> Column:
    """Decorators that name a route or a method, and quoted paths in the code, sorted and distinct."""
    marked = F.filter(F.coalesce(decorators, F.array().cast("array<string>")), lambda d: F.lower(d).rlike(ROUTE_WORDS))
    return F.array_sort(F.array_union(marked, F.regexp_extract_all(code, F.lit(ROUTE), F.lit(1))))


def edge_rows(chunks: DataFrame) -> DataFrame:
    """Edges of all kinds, exploded from one array a chunk."""
    none = F.array().cast("array<string>")
    many = {"IMPORTS": F.col("imports"), "CALLS": F.col("calls"), "REFERENCES": F.col("references"), "EXPOSES_ENDPOINT": routes(F.col("decorators"), F.col("code"))}
    one = {"TESTS": F.when(F.col("is_test") & F.col("symbol_name").isNotNull(), F.array("symbol_name")), "CONFIGURES": F.when(F.col("is_config"), F.array("file_path"))}
    def cell(kind: str):
        return lambda x: F.struct(F.lit(kind).alias("edge_type"), x.alias("target_symbol_fqn"), F.lit(CONFIDENCE[kind]).alias("confidence"))

    cells = F.concat(*(F.transform(F.coalesce(t, none), cell(k)) for k, t in (many | one).items()))
    source = F.coalesce("symbol_fqn", F.concat("repo_path_with_namespace", F.lit(":"), "file_path"))
    rows = chunks.select("tenant_id", "gitlab_project_id", "branch", "commit_sha", F.col("chunk_id").alias("source_chunk_id"), source.alias("source_symbol_fqn"), F.col("gitlab_project_id").alias("source_repo_project_id"), F.col("repo_path_with_namespace").alias("source_repo_path"), F.col("file_path").alias("source_file_path"), F.col("line_start").alias("source_line_start"), F.explode(cells).alias("e"))
    rows = rows.select("*", "e.*").drop("e")
    eid = stable_id(F.col("tenant_id"), F.col("gitlab_project_id"), F.col("branch"), F.col("source_file_path"), F.col("source_chunk_id"), F.col("edge_type"), F.col("target_symbol_fqn"))
    return rows.withColumn("edge_id", eid).dropDuplicates(["edge_id"])


def drop_secret_chunks(chunks: DataFrame, symbols: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """All three without chunks that hold secrets of high confidence."""
    bad = chunks.where("secret_high_confidence_count > 0").select("chunk_id")
    return (
        chunks.where("secret_high_confidence_count = 0"),
        symbols.join(bad.withColumnRenamed("chunk_id", "definition_chunk_id"), "definition_chunk_id", "left_anti"),
        edges.join(bad.withColumnRenamed("chunk_id", "source_chunk_id"), "source_chunk_id", "left_anti"),
    )


def file_rows(described: DataFrame, chunks: DataFrame) -> DataFrame:
    """File facts with what their chunks add up to."""
    key = [F.col(k).cast("string").alias(k) for k in KEYS]
    union = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast("array<string>"))))))
    per = chunks.groupBy(*KEYS).agg(
        F.array_sort(F.collect_set("symbol_fqn")).alias("defined_symbols"),
        union(F.col("references")).alias("referenced_symbols"),
        union(F.col("imports")).alias("imports"),
        F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "chunk_id"))), lambda x: x["chunk_id"]).alias("chunk_ids"),
        *(F.sum(c).alias(c) for c in ("secret_findings_count", "secret_redactions_count", "secret_high_confidence_count")),
    )
    return described.select(*key, *[c for c in described.columns if c not in (*KEYS, "content")]).join(per, KEYS, "left")


def ingest(files: DataFrame, *, metadata: DataFrame | None = None, base_url: str = "https://gitlab.example.com", skip_secrets: bool = False, settle: Callable[[DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
    """files to the tables files, chunks, symbols and edges. settle, given the chunks, keeps them, so that files are parsed once for all tables."""
    described = indexable(describe_files(files, metadata))
    chunks = chunk_rows(raw_chunks(described), described, base_url)
    chunks = one_per_id(chunks)
    if settle is not None:
        chunks = settle(chunks)
    symbols, edges = symbol_rows(chunks), edge_rows(chunks)
    if skip_secrets:
        chunks, symbols, edges = drop_secret_chunks(chunks, symbols, edges)
    return {"files": file_rows(described, chunks), "chunks": chunks, "symbols": symbols, "edges": edges}


def one_per_id(chunks: DataFrame) -> DataFrame:
    """Chunks of equal id (windows of two oversized definitions may share one): the last stays."""
    return last_written(chunks.withColumn("written", F.col("ordinal")), ["chunk_id"], "written")
