"""Identity functions: stable ids, content hashes, qualified names, source URLs, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "\x1f"


def stable_id(*parts: Column | str | int | None) -> Column:
    """SHA-256 over the parts joined by U+001F; null, empty and integer zero all count as empty."""
    columns = [p if isinstance(p, Column) else F.lit(None if p is None else str(p) if p else "") for p in parts]
    return F.sha2(F.concat_ws(SEPARATOR, *(F.coalesce(c.cast("string"), F.lit("")) for c in columns)), 256)


def line_part(n: Column) -> Column:
    """A line number as an id's part: zero is empty."""
    return F.when(n != 0, n.cast("string")).otherwise(F.lit(""))


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def extension(path: Column) -> Column:
    """Lower-case suffix with its dot, empty without one; names that only begin with a dot have none."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)), F.lit("")), F.lit(""))


def symbol_fqn(repo_path: Column, file_path: Column, parent: Column, name: Column) -> Column:
    """Repository, path without its extension, parent and name, dotted; empty parts are left out. Null without a name."""
    ext = extension(file_path)
    dotted = F.translate(file_path, "/", ".")
    stem = F.when((F.length(ext) > 0) & dotted.endswith(ext), F.substring(dotted, F.lit(1), F.length(dotted) - F.length(ext))).otherwise(dotted)
    joined = F.concat_ws(".", *(F.nullif(p, F.lit("")) for p in (F.translate(repo_path, "/", "."), stem, parent, name)))
    return F.when(F.coalesce(F.length(name), F.lit(0)) > 0, joined)


def blob_url(base: Column, repo_path: Column, commit: Column, file_path: Column, start: Column, end: Column) -> Column:
    return F.format_string("%s/%s/-/blob/%s/%s#L%d-L%d", F.rtrim(base, F.lit("/")), repo_path, commit, file_path, start.cast("int"), end.cast("int"))


def raw_url(base: Column, repo_path: Column, commit: Column, file_path: Column) -> Column:
    return F.format_string("%s/%s/-/raw/%s/%s", F.rtrim(base, F.lit("/")), repo_path, commit, file_path)


def short_name(fqn: Column) -> Column:
    """The last part of a dotted name."""
    return F.substring_index(fqn, ".", -1)


def search_forms(path: Column, fqn: Column) -> tuple[Column, Column]:
    """A path and a qualified name with spaces for their separators, for text analysis."""
    return F.translate(path, "/", " "), F.translate(fqn, ".", " ")
