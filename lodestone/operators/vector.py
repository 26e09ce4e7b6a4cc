"""Vectors: hash embeddings, reuse of stored ones, exact nearest neighbours by cosine, late interaction."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from lodestone.operators.access import scope_keys
from lodestone.operators.lexical import DIGITS, Best, names, top_n
from lodestone.scratch import cut

DENSE, LATE, LATE_TOKENS, LATE_QUERY = 384, 128, 128, 32
#: Queries of a block, at most, and where rows are filtered by pairs; bytes of their vectors.
QUERY_BLOCK, FILTERED_BLOCK, BLOCK_BYTES = 32768, 2048, 32 << 20
#: Vectors and queries that are multiplied at once, and pairs scored in double precision at once.
VECTOR_ROWS, TILE, PAIRS = 8192, 256, 1 << 16
_HASH_TOKEN = re.compile(r"[A-Za-z_][A-Za-z0-9_]*|[0-9]+")


def hash_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(_HASH_TOKEN.pattern), F.lit(0))


def _place(token: str, dim: int) -> tuple[int, float]:
    d = hashlib.blake2b(token.encode(), digest_size=16).digest()
    return int.from_bytes(d[:4], "big") % dim, -1.0 if d[4] & 1 else 1.0


def embed(text: str | None, dim: int = DENSE) -> list[float]:
    """Signed feature hashing of the tokens, at unit length; zeros without tokens."""
    out = np.zeros(dim)
    for token in _HASH_TOKEN.findall((text or "").lower()):
        at, sign = _place(token, dim)
        out[at] += sign
    return (out / (float(np.linalg.norm(out)) or 1.0)).tolist()


def hash_embedding(dim: int = DENSE) -> Callable[[Column], Column]:
    @F.pandas_udf("array<double>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: embed(t, dim))

    return run


def late_places(dim: int = LATE, most: int = LATE_TOKENS) -> Callable[[Column], Column]:
    """One vector a token, each a signed unit vector: its place and sign."""

    @F.pandas_udf("array<struct<at:int,sign:double>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(("at", "sign"), _place(x, dim), strict=True)) for x in _HASH_TOKEN.findall((t or "").lower())[:most]])

    return run


def late_vectors(places: Column, dim: int = LATE) -> Column:
    """The places as dense vectors."""
    return F.transform(places, lambda p: F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.when(i == p["at"], p["sign"]).otherwise(0.0)))


def mean_pool(vectors: Column, dim: int) -> Column:
    """The mean of the vectors, cut or filled with zeros to dim."""
    n = F.size(vectors)
    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.coalesce(F.aggregate(vectors, F.lit(0.0), lambda s, v: s + F.coalesce(F.get(v, i), F.lit(0.0))) / F.nullif(n, F.lit(0)), F.lit(0.0)))


def embed_batches(rows: DataFrame, provider: Callable[[list[str]], list[list[float]]], *, text: str = "text", into: str = "embedding", batch: int = 64) -> DataFrame:
    """rows with vectors from a provider that takes lists of texts; each task sends its own batches."""
    names = [c for c in rows.columns if c != into]
    schema = T.StructType([*(rows.schema[c] for c in names), T.StructField(into, T.ArrayType(T.DoubleType()))])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame[text].tolist()
            frame[into] = [v for a in range(0, len(texts), batch) for v in provider(texts[a : a + batch])]
            yield frame[[*names, into]]

    return rows.mapInPandas(run, schema)


def fit_dim(vector: Column, dim: int) -> Column:
    """vector cut or filled with zeros to dim."""
    v = vector.cast("array<double>")
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), dim)), 1, dim)


def embed_with(rows: DataFrame, provider: str = "auto", *, text: str = "text", into: str = "embedding", dim: int = DENSE, model: Callable[[list[str]], list[list[float]]] | None = None, remote: Callable[[list[str]], list[list[float]]] | None = None) -> DataFrame:
    """rows with vectors of dim by the provider asked for: `local`, a model that each task calls on its batches; else (`auto`, `http`, `hash`) a remote one if there is one, and the hash embedding where that fails or gives nothing for a batch."""
    if provider == "local":
        if model is None:
            raise ValueError("the local provider needs a model")
        return embed_batches(rows, model, text=text, into=into).withColumn(into, fit_dim(F.col(into), dim))
    if provider not in ("auto", "http", "hash"):
        raise ValueError(f"no such provider: {provider}")
    if provider == "hash" or remote is None:
        return rows.withColumn(into, hash_embedding(dim)(F.col(text)))

    def guarded(texts: list[str]) -> list[list[float]]:
        try:
            got = remote(texts)
        except Exception:  # an endpoint that can't be reached
            got = []
        return got if len(got) == len(texts) and all(got) else [embed(t, dim) for t in texts]

    return embed_batches(rows, guarded, text=text, into=into).withColumn(into, fit_dim(F.col(into), dim))


def parse_embedding_reply(reply: object) -> list[list[float]]:
    """Vectors of a provider's answer: a list, its results or data, or a single vector; anything else is empty."""
    if isinstance(reply, dict):
        for key in ("embeddings", "results", "data", "embedding", "dense"):
            if key in reply:
                return parse_embedding_reply(reply[key] if key != "embedding" and key != "dense" else [reply[key]])
        return []
    if not isinstance(reply, list):
        return []
    out = []
    for item in reply:
        if isinstance(item, dict):
            item = item.get("embedding", item.get("dense"))
        if not isinstance(item, list) or not all(isinstance(x, int | float) for x in item):
            return []
        out.append([float(x) for x in item])
    return out


def reuse_embeddings(chunks: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks with their stored vector, chunks to embed): a vector serves while its chunk's input hash is the same."""
    held = stored.select("chunk_id", F.col("embedding_input_hash").alias("__hash"), "embedding_dense")
    joined = chunks.join(held, "chunk_id", "left")
    same = F.coalesce((F.col("__hash") == F.col("embedding_input_hash")) & F.col("embedding_dense").isNotNull(), F.lit(False))
    return joined.where(same).drop("__hash"), joined.where(~same).drop("__hash", "embedding_dense")


def cosine(a: Column, b: Column) -> Column:
    """0 where either is the zero vector."""
    dot = F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    norm = lambda v: F.sqrt(F.aggregate(v.cast("array<double>"), F.lit(0.0), lambda s, x: s + x * x))
    return F.coalesce(dot / F.nullif(norm(a) * norm(b), F.lit(0.0)), F.lit(0.0))


def _unit(m: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def knn(vectors: DataFrame, queries: DataFrame, n: int, *, vec_id: str, vec: str, query_id: str, query_vec: str, block: int = QUERY_BLOCK, allowed: DataFrame | None = None, granted: DataFrame | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): the n nearest by cosine, exact.

    Queries go out in blocks of a bounded size; vectors are dealt over all cores, and each task multiplies its own with a block in
    single precision, takes up what comes near enough to its n best of a query, and scores that in double precision. What is
    shuffled is n rows a query and task. Filters on vectors apply before, and
    so do allowed, (query_id, doc_id) pairs that may be returned, and granted, rows of (query_id, tenant_id,
    branch, project_id): a scope's readers go to its vectors, in one row a scope.
    """
    spark = vectors.sparkSession
    keys = scope_keys(vectors, granted) if granted is not None else {}
    own = vectors.select(F.col(vec_id).alias("i"), F.col(vec).cast("array<double>").alias("v"), *(F.col(c).alias(k) for k, c in keys.items())).where(F.col("v").isNotNull() & (F.size("v") > 0))
    filtered = allowed is not None or granted is not None
    if granted is not None:
        own = own.join(granted.groupBy(*keys).agg(F.collect_set("query_id").alias("readers")), list(keys)).select("i", "v", "readers")
    elif filtered:
        own = own.join(allowed.groupBy(F.col("doc_id").alias("i")).agg(F.collect_set("query_id").alias("readers")), "i")
    if filtered:
        block = min(block, FILTERED_BLOCK)
    own = cut(own.repartition(max(2, spark.sparkContext.defaultParallelism)))
    kinds = [queries.schema[query_id].dataType, own.schema["i"].dataType]
    of_query, of_doc = (to_arrow_type(k) for k in kinds)
    schema = f"query_id {kinds[0].simpleString()}, doc_id {kinds[1].simpleString()}, score double"

    def scan(ids: list, matrix: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, _unit(matrix)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, exact = sent.value
            rough, place = exact.astype(np.float32), {x: q for q, x in enumerate(ids)}
            slack = (exact.shape[1] + 8) * 2.0**-22 + 2 * 10.0**-DIGITS  # of single precision
            tiles = [(a, min(a + TILE, len(ids))) for a in range(0, len(ids), TILE)]
            best = [Best(b - a, n) for a, b in tiles]
            for whole in batches:
                for batch in (whole.slice(x, VECTOR_ROWS) for x in range(0, whole.num_rows, VECTOR_ROWS)):
                    docs = names(batch.column(0))
                    unit = _unit(batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(docs), -1))
                    may = None
                    if filtered:
                        may = np.zeros((len(ids), len(docs)), dtype=bool)
                        for j, readers in enumerate(batch.column(2).to_pylist()):
                            may[[place[x] for x in readers if x in place], j] = True
                    else:  # of equal vectors only the n with the smallest ids can be among the best
                        _, same = np.unique(np.ascontiguousarray(unit).view(f"V{unit.shape[1] * 8}").ravel(), return_inverse=True)
                        order = np.lexsort((docs if docs.dtype != object else np.array(["" if x is None else x for x in docs], dtype=object), same))
                        first = np.flatnonzero(np.r_[True, same[order][1:] != same[order][:-1]])
                        kept = np.sort(order[np.arange(len(order)) - np.repeat(first, np.diff(np.r_[first, len(order)])) < n])
                        docs, unit = docs[kept], unit[kept]
                    near = np.ascontiguousarray(unit.astype(np.float32).T)
                    for (a, b), top in zip(tiles, best, strict=True):
                        sims = rough[a:b] @ near
                        if may is not None:
                            sims[~may[a:b]] = -np.inf
                        floor = top.floor - slack
                        new = np.isneginf(floor)
                        if new.any() and n < sims.shape[1]:
                            floor[new] = np.partition(sims[new], -n, axis=1)[:, -n] - slack
                        # a comparison turned round lets NaN through
                        at = np.flatnonzero(~(sims < floor.astype(np.float32)[:, None]))
                        for part in np.array_split(at, max(1, -(-len(at) // PAIRS))):
                            q, j = np.divmod(part, sims.shape[1])
                            if may is not None:
                                held = may[a + q, j]
                                q, j = q[held], j[held]
                            top.add(q, docs[j], np.round(np.einsum("ij,ij->i", exact[a + q], unit[j]), 12))
            for (a, _), top in zip(tiles, best, strict=True):
                if len(top.q):
                    yield pa.RecordBatch.from_arrays([pa.array([ids[a + q] for q in top.q], of_query), pa.array(top.ids.tolist(), of_doc), pa.array(top.s, pa.float64())], names=["query_id", "doc_id", "score"])

        return own.mapInArrow(run, schema)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                offsets = pa.array([0, batch.num_rows], pa.int32())
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(offsets, batch.column(0)), pa.array([batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).tobytes()], pa.binary())], names=["ids", "m"])

    asked = queries.select(F.col(query_id).alias("i"), F.col(query_vec).cast("array<double>").alias("v")).where("v is not null and size(v) > 0")
    scans, ids, parts = [], [], []
    for row in asked.mapInArrow(pack, f"ids array<{kinds[0].simpleString()}>, m binary").toLocalIterator():
        m = np.frombuffer(row.m).reshape(len(row.ids), -1)
        most = max(1, min(block, BLOCK_BYTES // (8 * m.shape[1])))
        at = 0
        while at < len(m):
            take = min(most - len(ids), len(m) - at)
            ids, parts, at = ids + row.ids[at : at + take], [*parts, m[at : at + take]], at + take
            if len(ids) >= most:
                scans.append(scan(ids, np.concatenate(parts)))
                ids, parts = [], []
    if ids:
        scans.append(scan(ids, np.concatenate(parts)))
    if not scans:
        return spark.createDataFrame([], f"{schema}, rank int")
    out = scans[0]
    for more in scans[1:]:
        out = out.unionByName(more)
    return top_n(out, n)


def maxsim(query: Column, doc: Column) -> Column:
    """Mean over the first 32 query vectors of the largest dot product with the first 128 of the document; 0 where either has none."""
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    q, d = F.slice(query, 1, LATE_QUERY), F.slice(doc, 1, LATE_TOKENS)
    best = F.transform(q, lambda a: F.array_max(F.transform(d, lambda b: dot(a, b))))
    return F.when((F.coalesce(F.size(q), F.lit(0)) > 0) & (F.coalesce(F.size(d), F.lit(0)) > 0), F.aggregate(best, F.lit(0.0), lambda s, x: s + x) / F.size(q)).otherwise(0.0)
