"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Text is lower-cased, everything but letters becomes one space, and n-grams of 1 to 4 characters are
hashed into buckets. A document's vector is (1 + ln tf) * idf, at unit length. Document frequencies are
counted over all training documents. The weights are learned by follow-the-regularised-leader (per
coordinate, proximal) under L1 and L2 penalties, on a sample of at most about `max_rows` training
documents: the same number from each language, picked by a hash, fewer where a language has fewer. One
document in five of the sample is kept from the learning and sets the temperature that the logits are
divided by (least negative log-likelihood).

Prediction reads the text alone. Edge cases: a text that is null or has no letter is `und` with score 0;
without training documents every text is `und`; with one language every text with a letter is that; a
null label is never learned from; repeated rows are learned from as often as they occur; texts of any
length are read whole, in pieces; extra columns stay where asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, worker_runs
from lodestone.scratch import cut, scratch

BUCKETS = 1 << 15
ORDERS = (1, 2, 3, 4)
#: Bound of the fitting sample, in documents.
MAX_ROWS = 6000
#: Bound of their vectors, in bytes: a longer sample is thinned by its hash before it is sent to the driver.
MAX_BYTES = 192 << 20
EPOCHS = 3
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1e-5
PIECE = 1 << 18
UNKNOWN = "und"
TEXT_ROWS = 2000

_tables: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    """For every code point below 0x30000 its lower-case letter, or a space. Higher ones are letters as they are."""
    if "letters" not in _tables:
        out = np.full(0x30000, 32, np.uint32)
        for c in range(0x30000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                out[c] = ord(low) if len(low) == 1 else c
        _tables["letters"] = out
    return _tables["letters"]


def counts(text: str) -> np.ndarray | None:
    """How often each bucket's n-grams occur, or None for a text without letters."""
    total, tail = None, np.array([32], np.uint32)
    for a in range(0, len(text), PIECE):
        code = np.frombuffer(text[a : a + PIECE].encode("utf-32-le", "replace"), np.uint32)
        low = np.where(code < 0x30000, _letters()[np.minimum(code, 0x2FFFF)], code)
        low = np.concatenate((tail, low, [np.uint32(32)] if a + PIECE >= len(text) else low[:0]))
        keep = np.ones(len(low), bool)
        keep[1:] = (low[1:] != 32) | (low[:-1] != 32)
        low = low[keep].astype(np.uint64)
        fresh = len(tail) if a else 1
        if len(low) > 1 or (len(low) and low[0] != 32):
            h = np.zeros(len(low), np.uint64)
            parts = []
            for n in ORDERS:
                # h[i]: the n characters that end at i
                h = (np.concatenate(([np.uint64(0)], h[:-1])) if n > 1 else h) * np.uint64(0x9E3779B97F4A7C15) + (low + np.uint64(1)) * np.uint64(0xC2B2AE3D27D4EB4F)
                x = h[max(n - 1, min(fresh, len(h)) if a else n - 1) :]
                x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9 + 2 * n)
                parts.append((x >> np.uint64(49)).astype(np.int64))
            got = np.bincount(np.concatenate(parts), minlength=BUCKETS)
            total = got if total is None else total + got
        tail = low[-(max(ORDERS) - 1) :].astype(np.uint32) if len(low) else tail
    return total if total is not None and _has_letter(text) else None


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text)


def vector(tf: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a document's unit vector."""
    at = np.flatnonzero(tf)
    x = (1.0 + np.log(tf[at])) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


class Model:
    def __init__(self, langs: list[str], idf: np.ndarray, weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.langs, self.idf, self.weights, self.bias, self.temperature = langs, idf, weights, bias, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        tf = counts(text) if text and self.langs else None
        if tf is None:
            return UNKNOWN, 0.0
        at, x = vector(tf, self.idf)
        p = softmax((x @ self.weights[at] + self.bias) / self.temperature)
        best = int(np.argmax(p))
        return self.langs[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal on (buckets, values, class), in the order given. The last bucket is the bias."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))

    def weights(zs: np.ndarray, ns: np.ndarray) -> np.ndarray:
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(ns)) / ALPHA + L2))

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at.astype(np.int64), BUCKETS), np.append(x.astype(np.float64), 1.0)
            w = weights(z[at], n[at])
            p = softmax(x @ w)
            p[y] -= 1.0
            g = x[:, None] * p
            own = n[at]
            more = own + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(own)) / ALPHA * w
            n[at] = more
    w = weights(z, n)
    return w[:BUCKETS], w[BUCKETS]


def temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least negative log-likelihood, by golden section on its logarithm."""
    if not len(y):
        return 1.0

    def loss(t: float) -> float:
        return float(-np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-12)).mean())

    low, high, g = -4.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - g * (high - low), low + g * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all the texts each bucket occurs, and how many texts have letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                tf = counts(text) if text else None
                if tf is not None:
                    df += tf > 0
                    n += 1
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(BUCKETS + 1)), pa.array(np.append(df, n))], names=["bucket", "df"])

    rows = texts.mapInArrow(count, "bucket long, df long").groupBy("bucket").agg(F.sum("df").alias("df")).toPandas()  # a row a bucket
    df = np.zeros(BUCKETS + 1, np.int64)
    df[rows["bucket"]] = rows["df"]
    return df[:BUCKETS], int(df[BUCKETS])


def sample(labelled: DataFrame, max_rows: int) -> DataFrame:
    """About max_rows rows (text, lang, key) at most, evenly over the languages, the same ones each time."""
    sizes = {r.lang: r.n for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    quota = max(1, max_rows // max(1, len(sizes)))
    unit = F.pmod(F.col("key"), F.lit(1 << 20)) / float(1 << 20)
    share = F.lit(0.0)
    for lang, n in sizes.items():
        share = F.when(F.col("lang") == lang, F.lit(min(1.0, quota / n))).otherwise(share)
    return labelled.where(unit < share)


def train(docs: DataFrame, *, lang: str = "lang", text: str = "text", doc_id: str = "doc_id", max_rows: int = MAX_ROWS, max_bytes: int = MAX_BYTES) -> Model:
    """The model learned from docs; doc_id only picks the sample."""
    spark = docs.sparkSession
    labelled = docs.where(F.col(lang).isNotNull()).select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.xxhash64(F.col(doc_id), F.lit(11)).alias("key"))
    with arrow_rows(spark, TEXT_ROWS):
        df, n = document_frequencies(labelled.select("text"))
        idf = np.log((1.0 + n) / (1.0 + df)) + 1.0

        def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for x, y, k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    tf = counts(x) if x else None
                    if tf is not None:
                        at, v = vector(tf, idf)
                        out.append((at.astype(np.uint16).tobytes(), v.astype(np.float32).tobytes(), y, k))
                cols = list(zip(*out, strict=True)) or [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.binary()), pa.array(cols[1], pa.binary()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())], names=["at", "x", "lang", "key"])

        with scratch(spark):
            found = cut(sample(labelled, max_rows).mapInArrow(vectors, "at binary, x binary, lang string, key long"))
            size = found.agg(F.sum(F.octet_length("at") + F.octet_length("x"))).first()[0] or 0
            thin = F.pmod(F.xxhash64("key"), F.lit(1 << 20)) < (1 << 20) * min(1.0, max_bytes / max(size, 1))
            rows = found.where(thin).collect()  # about max_rows and max_bytes at most
    langs = sorted({r.lang for r in rows})
    rows = sorted(rows, key=lambda r: (r.key, r.lang, bytes(r.at)))
    data = [(np.frombuffer(r.at, np.uint16), np.frombuffer(r.x, np.float32), langs.index(r.lang)) for r in rows]  # views: widened a document at a time
    rng = np.random.default_rng(5)
    data = [data[i] for i in rng.permutation(len(data))]
    held = max(0, len(data) // 5)
    weights, bias = fit(data[held:], max(1, len(langs)))
    logits = np.array([x @ weights[at] + bias for at, x, _ in data[:held]]).reshape(held, max(1, len(langs)))
    return Model(langs, idf, weights.astype(np.float32), bias, temperature(logits, np.array([y for *_, y in data[:held]], np.int64)))


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns keep, and lang_pred and score of each whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_runs("langid")
        for batch in batches:
            said = [sent.value.predict(x) for x in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(i + 1) for i in range(len(keep))] + [pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64())], names=[*keep, "lang_pred", "score"])

    own = docs.select(F.col(text).alias("__text"), *keep)
    kept = ", ".join(f"`{c}` {t}" for c, t in own.drop("__text").dtypes)
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        return own.mapInArrow(run, f"{kept}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning. A null doc_id isn't."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
