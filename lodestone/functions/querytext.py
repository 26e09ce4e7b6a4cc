"""Preparation of query texts: class, identifiers, expansion and validation, as column expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The terms of each query class, in the order in which they are tried.
QUERY_TERMS = [
    ("ownership_question", ["owner", "who owns", "team", "maintainer"]),
    ("definition_lookup", ["where is", "implemented", "defined", "source"]),
    ("usage_lookup", ["who calls", "where used", "references", "uses ", "called by"]),
    ("api_question", ["endpoint", "route", "api", "http"]),
    ("config_question", ["config", "setting", "environment", "env var", "property"]),
    ("test_question", ["test", "spec", "coverage"]),
    ("deployment_question", ["deploy", "helm", "kubernetes", "docker"]),
    ("debugging_question", ["debug", "error", "exception", "traceback", "bug"]),
    ("migration_question", ["migration", "schema", "table"]),
]
OTHERWISE = "architecture_question"
#: Words that look like identifiers but are not.
STOP_WORDS = ["A", "An", "And", "Are", "Can", "Does", "How", "Is", "The", "What", "When", "Where", "Which", "Who", "Why"]
#: Fixed value: the pattern of identifiers.
IDENTIFIER = r"\b(?:[A-Z][A-Za-z0-9_]+|[a-zA-Z_][\w]*(?:\.[a-zA-Z_][\w]*)+|/[A-Za-z0-9_./-]+|[A-Z0-9_]{3,})\b"
#: Terms that short queries gain.
SYNONYMS = {
    "auth": ["authentication", "authorization"],
    "authn": ["authentication"],
    "authz": ["authorization"],
    "config": ["configuration", "settings"],
    "db": ["database"],
    "repo": ["repository"],
    "svc": ["service"],
    "mgr": ["manager"],
    "util": ["utility", "helper"],
    "utils": ["utilities", "helpers"],
    "msg": ["message"],
    "err": ["error", "exception"],
    "req": ["request"],
    "res": ["response"],
    "ctx": ["context"],
    "impl": ["implementation"],
    "handler": ["controller", "processor"],
    "dto": ["data transfer object"],
    "orm": ["object relational mapping"],
    "api": ["application programming interface"],
    "sdk": ["software development kit"],
    "cli": ["command line interface"],
}
EXPAND_BELOW = 4


def classify_query(query: Column) -> Column:
    """The first class one of whose terms occurs in the lower-cased query."""
    low = F.lower(query)
    out = None
    for name, terms in QUERY_TERMS:
        found = F.lit(False)
        for term in terms:
            found = found | low.contains(term)
        out = F.when(found, name) if out is None else out.when(found, name)
    return out.otherwise(OTHERWISE)


def identifiers(query: Column) -> Column:
    """Distinct identifiers in the order in which they first occur."""
    found = F.transform(F.regexp_extract_all(query, F.lit("(?U)" + IDENTIFIER), F.lit(0)), lambda x: F.btrim(x, F.lit("`'\"")))
    return F.array_distinct(F.filter(found, lambda x: (F.length(x) > 0) & ~x.isin(STOP_WORDS)))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+", -1), lambda x: F.length(x) > 0)


def split_identifier(token: Column) -> Column:
    """Lower-case words of a camel-case name, then of a snake- or kebab-case one; single letters are left out."""
    long_ = lambda x: F.length(x) > 1
    camel = F.filter(_words(F.regexp_replace(token, "([A-Z])", " $1")), long_)
    snake = F.filter(F.split(token, "[_\\-]", -1), long_)
    return F.transform(F.concat(camel, snake), lambda x: F.lower(x))


def expand_query(query: Column) -> Column:
    """A query of fewer than four words gains the parts of its identifiers and synonyms that it does not hold itself; repetitions among these stay."""
    tokens = _words(query)
    synonyms = F.create_map(*chain.from_iterable((F.lit(k), F.array(*(F.lit(x) for x in v))) for k, v in SYNONYMS.items()))
    extra = F.flatten(F.transform(tokens, lambda t: F.concat(split_identifier(t), F.coalesce(F.try_element_at(synonyms, F.lower(t)), F.array().cast("array<string>")))))
    own = F.transform(tokens, lambda t: F.lower(t))
    new = F.filter(extra, lambda x: ~F.array_contains(own, F.lower(x)))
    return F.when((F.size(tokens) >= EXPAND_BELOW) | (F.size(new) == 0), query).otherwise(F.concat(query, F.lit(" "), F.array_join(new, " ")))


def merge_repo_filter(one: Column, many: Column) -> Column:
    """A single and several repository paths as one list without repetitions."""
    return F.array_distinct(F.array_compact(F.concat(F.array(one), F.coalesce(many, F.array().cast("array<string>")))))


def request_error(query: Column, projects: Column, repos: Column, top_k: Column) -> Column:
    """Why a search request is out of bounds, or null."""
    n = F.coalesce(F.char_length(query), F.lit(0))
    return (
        F.when((n < 1) | (n > 2000), "query must have 1 to 2000 characters")
        .when(F.coalesce(F.size(projects), F.lit(0)) > 500, "at most 500 project ids")
        .when(F.coalesce(F.size(repos), F.lit(0)) > 50, "at most 50 repository paths")
        .when((top_k < 1) | (top_k > 50), "top_k must be 1 to 50")
    )


def with_hypothetical(query: Column, snippet: Column | None = None) -> Column:
    """The text to embed: the query and a snippet that answers it, where there is one."""
    return query if snippet is None else F.concat_ws("\n", query, F.nullif(snippet, F.lit("")))
