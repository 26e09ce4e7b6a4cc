"""Quality classifier by hierarchical empirical Bayes.

A logistic regression on a dozen features of the text gives each document evidence of its own: the
probability p that it is good. Hosts and the paths on them are then given posteriors. The global share m
of good documents is the prior of every host, with a strength (in documents) that the method of moments
takes from how far host means spread beyond chance; the host's posterior is likewise the prior of its
paths. Sparse sites so shrink toward the level above, sites with many documents stand on their own. A
document's score is its own odds times the odds of its path without itself, over the global odds:

    logit(score) = logit(p) + logit(path posterior without this document) - logit(m)

Sums are grouped aggregations over all documents, summed in each task first, so a host with a third of
all rows is one row a task. The regression is fitted on at most about `max_rows` labelled documents,
picked by a hash; everything else covers all documents.

Edge cases: a null or empty text is judged by its features (all zero) like any other; a text of any
length is read whole; a null host or path
is a site of its own; labels that are null are left out, repeated ones averaged; without labels of both
kinds nothing is rejected (score 1); repeated rows count as often as they occur; an empty table gives an
empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, cut, worker_runs
from lodestone.llm.wordhash import NOT_SPACE, blocks, hash_words, string_buffers
from lodestone.scratch import spread_join

#: Bound of the fitting sample, in labelled documents.
MAX_ROWS = 20_000
RIDGE = 1e-3
TEXT_ROWS = 2000
#: A document is kept from this score on.
KEEP = 0.5

_UPPER, _LOWER, _DIGIT, _SPACE, _HIGH, _STOP, _SHOUT, _BAR, _SYMBOL = range(9)
_CLASS = np.full(256, _SYMBOL, np.uint8)
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58], _CLASS[128:] = _UPPER, _LOWER, _DIGIT, _HIGH
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[[ord(c) for c in ".,;:?'\"-()"]] = _STOP
_CLASS[ord("!")], _CLASS[ord("|")] = _SHOUT, _BAR
FEATURES = 12


def features(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of features a text."""
    out = []
    for a, b in blocks(off):
        own = off[a : b + 1]
        hashes, first = hash_words(buf, own, NOT_SPACE)
        kinds = _CLASS[buf[own[0] : own[-1]]]
        newline = buf[own[0] : own[-1]] == 10
        for i in range(b - a):
            s, e, x, y = int(first[i]), int(first[i + 1]), int(own[i] - own[0]), int(own[i + 1] - own[0])
            n, size = e - s, y - x
            c = np.bincount(kinds[x:y], minlength=9).astype(float)
            w, z = max(n, 1), max(size, 1)
            h = np.sort(hashes[s:e])
            edge = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True]))) if n else np.zeros(1, np.int64)
            distinct, top = len(edge) - 1, int(np.diff(edge).max()) if n else 0
            again = int((hashes[s + 1 : e] == hashes[s : e - 1]).sum()) if n > 1 else 0
            letters = max(c[_UPPER] + c[_LOWER] + c[_HIGH], 1)
            out.append((np.log1p(n), np.log1p(size / w), c[_UPPER] / letters, np.sqrt(c[_SYMBOL] / z), np.sqrt(c[_SHOUT] / w), np.sqrt(c[_BAR] / w), np.sqrt(c[_DIGIT] / z), distinct / w, top / w, np.sqrt(int(newline[x:y].sum()) / w), np.sqrt(c[_STOP] / w), np.sqrt(again / w)))
    return np.array(out).reshape(-1, FEATURES)


class Model:
    """Logistic regression on standardised features."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray):
        self.mean, self.scale, self.weights = mean, scale, weights

    def predict(self, x: np.ndarray) -> np.ndarray:
        z = ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 30) -> Model | None:
    """By Newton's method with a ridge; None unless both labels occur."""
    if len(np.unique(y)) < 2:
        return None
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-6)
    z = np.column_stack(((x - mean) / scale, np.ones(len(x))))
    w = np.zeros(z.shape[1])
    ridge = np.full(len(w), RIDGE * len(x))
    ridge[-1] = 1e-9
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return Model(mean, scale, w)


def train(docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_ROWS) -> Model | None:
    usable = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__id"), F.col(label).cast("double").alias("__y"))
    n = usable.count()
    unit = F.pmod(F.xxhash64("__id", F.lit(23)), F.lit(1 << 20)) / float(1 << 20)
    picked = usable.where(unit < min(1.0, max_rows / max(n, 1))).groupBy("__id").agg(F.avg("__y").alias("__y"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(*string_buffers(batch.column(0)))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(list(x), pa.list_(pa.float64())), batch.column(2)], names=["id", "x", "y"])

    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        joined = docs.select(F.col(text).alias("t"), F.col(doc_id).alias("__d")).join(F.broadcast(picked), F.col("__d") == F.col("__id"))  # bounded by max_rows
        got = joined.select("t", F.xxhash64("__id").alias("id"), "__y").mapInArrow(rows, "id long, x array<double>, y double").collect()
    if not got:
        return None
    got.sort(key=lambda r: (r.id, r.x))
    return fit(np.array([r.x for r in got]), (np.array([r.y for r in got]) >= 0.5).astype(float))


def evidence(docs: DataFrame, model: Model | None, *, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, same, host, path, p): of each document's text alone; same tells rows that share a doc_id apart."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_runs("quality")
        for batch in batches:
            x = features(*string_buffers(batch.column(4)))
            p = sent.value.predict(x) if sent.value is not None else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(p, pa.float64())], names=["doc_id", "same", "host", "path", "p"])

    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("same"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text).alias("text"))
    kind = dict(own.dtypes)["doc_id"]
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return cut(own.mapInArrow(run, f"doc_id {kind}, same long, host string, path string, p double"))


def _strength(spread: float, chance: float, m: float) -> float:
    """Documents that the level above counts for, from the variance of the means beyond chance."""
    beyond = max(spread - chance, 1e-6)
    return float(min(max(m * (1 - m) / beyond - 1, 1.0), 1e6))


def posteriors(found: DataFrame) -> tuple[DataFrame, float, float, float]:
    """(host, path, n, s, hn, hs) with documents and sums of p of paths and hosts; the global share m and the strengths of global over host and host over path."""
    paths = cut(found.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("p").alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs"))
    of_host = hosts.select(F.coalesce("host", F.lit("")).alias("__h"), F.col("host").isNull().alias("__n"), "hn", "hs")
    named = paths.withColumns({"__h": F.coalesce("host", F.lit("")), "__n": F.col("host").isNull()})
    sites = cut(spread_join(named, cut(of_host), ["__h", "__n"]).drop("__h", "__n"))
    total = hosts.agg(F.sum("hn").alias("n"), F.sum("hs").alias("s"), F.count("*").alias("k")).first()
    if not total.n:
        return sites, 1.0, 1.0, 1.0
    m = min(max(total.s / total.n, 1e-6), 1 - 1e-6)
    over = hosts.agg(F.sum(F.col("hn") * F.pow(F.col("hs") / F.col("hn") - m, 2)).alias("v")).first().v / total.n
    top = _strength(over, total.k * m * (1 - m) / total.n, m)
    host_mean = (F.col("hs") + top * m) / (F.col("hn") + top)
    row = sites.agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - host_mean, 2)).alias("v"), F.count("*").alias("k")).first()
    return sites, m, top, _strength(row.v / total.n, row.k * m * (1 - m) / total.n, m)


def _logit(x: Column) -> Column:
    return F.log(x / (1 - x))


def classify(docs: DataFrame, labels: DataFrame, *, host: Column, path: Column, doc_id: str = "doc_id", text: str = "text", keep_from: float = KEEP, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, same, host, path, p_text, p_site, score, keep) of every row of docs."""
    model = train(docs, labels, doc_id=doc_id, text=text, max_rows=max_rows)
    found = evidence(docs, model, host=host, path=path, doc_id=doc_id, text=text)
    if model is None:
        one = F.lit(1.0)
        return found.select("doc_id", "same", "host", "path", F.col("p").alias("p_text"), one.alias("p_site"), one.alias("score"), F.lit(True).alias("keep"))
    sites, m, top, low = posteriors(found)
    # a host may hold a third of all rows
    key = lambda df: df.withColumns({"__h": F.coalesce("host", F.lit("")), "__p": F.coalesce("path", F.lit("")), "__n": F.col("host").isNull().cast("int") * 2 + F.col("path").isNull().cast("int")})
    both = spread_join(key(found), key(sites).drop("host", "path"), ["__h", "__p", "__n"])
    clip = lambda x: F.least(F.greatest(x, F.lit(1e-9)), F.lit(1 - 1e-9))
    host_prior = (F.col("hs") - F.col("p") + top * m) / (F.col("hn") - 1 + top)
    site = clip((F.col("s") - F.col("p") + low * host_prior) / (F.col("n") - 1 + low))
    score = 1 / (1 + F.exp(-(_logit(clip(F.col("p"))) + _logit(F.col("p_site")) - float(np.log(m / (1 - m))))))
    return both.withColumn("p_site", site).withColumn("score", score).select("doc_id", "same", "host", "path", F.col("p").alias("p_text"), "p_site", "score", (F.col("score") >= keep_from).alias("keep"))
