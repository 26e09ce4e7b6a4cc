"""Language and class of a file from its path, size and content, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions.identity import extension

#: Languages by extension.
LANGUAGES = {
    ".py": "python", ".js": "javascript", ".jsx": "javascript", ".ts": "typescript", ".tsx": "typescript", ".java": "java", ".kt": "kotlin",
    ".go": "go", ".rs": "rust", ".cs": "csharp", ".cpp": "cpp", ".cc": "cpp", ".cxx": "cpp", ".c": "c", ".h": "c", ".hpp": "cpp", ".rb": "ruby",
    ".php": "php", ".scala": "scala", ".md": "markdown", ".yml": "yaml", ".yaml": "yaml", ".json": "json", ".toml": "toml", ".xml": "xml", ".sql": "sql",
}
#: What decides a file's class.
VENDOR_DIRS = [".git", ".venv", "venv", "node_modules", "vendor", "target", "build", "dist", "coverage", ".mypy_cache", ".pytest_cache", "__pycache__"]
GENERATED_MARKERS = ["@generated", "auto-generated", "autogenerated", "generated by"]
CONFIG_EXTENSIONS = [".json", ".toml", ".ini", ".cfg", ".properties", ".env"]
DOC_EXTENSIONS = [".md", ".rst", ".txt", ".adoc"]
SCHEMA_EXTENSIONS = [".sql", ".graphql", ".proto", ".avsc"]
DEPLOYMENT_NAMES = ["dockerfile", "docker-compose.yml", "helmfile.yaml", "kustomization.yaml"]
CI_DIRS = [".github", ".gitlab", ".circleci"]
SOURCE_EXTENSIONS = [".py", ".js", ".jsx", ".ts", ".tsx", ".java", ".kt", ".go", ".rs", ".cs", ".cpp", ".c", ".h", ".hpp", ".rb", ".php", ".scala"]
MAX_FILE_BYTES = 750_000
NOT_INDEXED = ["binary", "vendor", "generated", "large_unknown", "unknown"]


def path_language(path: Column) -> Column:
    """The language of the extension; else the extension itself; else text."""
    ext = extension(path)
    known = F.create_map(*(F.lit(x) for x in chain.from_iterable(LANGUAGES.items())))
    return F.coalesce(F.try_element_at(known, ext), F.nullif(F.substring(ext, 2, 1 << 20), F.lit("")), F.lit("text"))


def _parts(path: Column) -> Column:
    return F.split(F.lower(path), "/")


def _among(parts: Column, names: list[str]) -> Column:
    return F.arrays_overlap(parts, F.array(*(F.lit(n) for n in names)))


def is_test_path(path: Column) -> Column:
    name = F.element_at(_parts(path), -1)
    ends = name.endswith("_test.py") | name.endswith(".test.ts") | name.endswith(".spec.ts") | name.endswith("test.java")
    return _among(_parts(path), ["test", "tests"]) | name.startswith("test_") | ends


def is_binary(content: Column) -> Column:
    """A zero byte among the first 4096; unreadable content (null) counts as binary."""
    return F.coalesce(F.instr(F.substring(content.cast("string"), 1, 4096), "\0") > 0, F.lit(True))


def looks_generated(content: Column) -> Column:
    head = F.lower(F.substring(content.cast("string"), 1, 2048))
    found = F.lit(False)
    for marker in GENERATED_MARKERS:
        found = found | head.contains(marker)
    return F.coalesce(found, F.lit(False))


def classify_file(path: Column, size: Column, content: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    """The file's class; the first rule that holds decides."""
    parts, ext = _parts(path), extension(path)
    name = F.element_at(parts, -1)
    return (
        F.when(_among(parts, VENDOR_DIRS), "vendor")
        .when(size > max_bytes, "large_unknown")
        .when(is_binary(content), "binary")
        .when(looks_generated(content), "generated")
        .when(_among(parts, CI_DIRS) | (name == ".gitlab-ci.yml"), "ci_cd")
        .when(name.isin(DEPLOYMENT_NAMES) | _among(parts, ["deploy", "helm"]), "deployment")
        .when(_among(parts, ["migration", "migrations"]), "migration")
        .when(ext.isin(SCHEMA_EXTENSIONS), "schema")
        .when(ext.isin(DOC_EXTENSIONS), "documentation")
        .when(ext.isin([*CONFIG_EXTENSIONS, ".yml", ".yaml", ".xml"]), "config")
        .when(is_test_path(path), "test_code")
        .when(ext.isin(SOURCE_EXTENSIONS), "source_code")
        .when(path_language(path) == "text", "unknown")
        .otherwise("config")
    )


def should_index(path: Column, size: Column, file_class: Column, max_bytes: int = MAX_FILE_BYTES) -> Column:
    return ~_among(_parts(path), VENDOR_DIRS) & (size <= max_bytes) & ~file_class.isin(NOT_INDEXED)


def flags(file_class: Column) -> dict[str, Column]:
    """The boolean columns that follow from a file's class."""
    return {
        "is_test": file_class == "test_code",
        "is_generated": file_class == "generated",
        "is_vendor": file_class == "vendor",
        "is_config": file_class.isin("config", "ci_cd", "deployment", "schema"),
        "is_migration": file_class == "migration",
        "is_binary": file_class == "binary",
        "is_large": file_class == "large_unknown",
    }
