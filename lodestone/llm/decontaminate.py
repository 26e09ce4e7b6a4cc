"""Benchmark decontamination: a prefix-filtered set join of item windows against whole documents.

A window is `window` consecutive words of an item (an item of fewer words is one window). Its shingles
are ordered by rarity over all documents. A document that holds the window holds all its shingles, so
at containment 1 the necessary prefix is the rarest shingle alone: only it is joined. Its place in the
window then gives the one place where the window could start (positional bound), which must lie within
the document (length bound), and the words there are compared with the window's (exact verification).

Items come to the executors in blocks of a fixed number of words, one after another, however many
there are; equal windows of a block are one. Documents are never shuffled, so no key can be hot. Words are
compared as 64-bit hashes. An item, of any length, is held whole on the driver.

Edge cases: a null or empty text has no words and no hits; a null item text gives no window; repeated
items count apart under their own ids; a null item id is listed as the empty string; extra columns stay
as they are, texts of any length are read whole, and `into` names the one column that is added, in place of an earlier one of that name.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import worker_runs
from lodestone.llm.wordhash import ALNUM, blocks, hash_words, shingles, string_buffers

WINDOW = 13
SHINGLE = 4
BLOCK_WORDS = 500_000
_OTHER = 0x3C6EF372FE94F82B

RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("item_ids", T.ArrayType(T.StringType())),
        T.StructField("spans", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    ]
)
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(_SPAN))])


class Windows:
    """The distinct windows of a block of items: words[at[i] : at[i] + length[i]] is window i, of the items item[of[i] : of[i + 1]]."""

    def __init__(self, ids: list[str], texts: list[str | None], window: int):
        buf, off = string_buffers(pa.array(texts, pa.large_string()))
        self.words, first = hash_words(buf, off, ALNUM)
        self.ids = ids
        size = np.diff(first)
        n = np.minimum(size, window)
        many = np.where(n > 0, size - n + 1, 0)
        item = np.repeat(np.arange(len(ids)), many)
        at = np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many) + first[:-1][item]
        length = n[item]
        # equal windows become one, with the items of all: they are told apart by 128 bits and their length
        one, two = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
        for x in np.unique(length):
            own = np.flatnonzero(length == x)
            one[own] = shingles(self.words, int(x))[at[own]]
            two[own] = shingles(self.words ^ np.uint64(_OTHER), int(x))[at[own]]
        by = np.lexsort((item, one, two, length))
        new = np.ones(len(by), bool)
        new[1:] = (one[by][1:] != one[by][:-1]) | (two[by][1:] != two[by][:-1]) | (length[by][1:] != length[by][:-1])
        again = np.zeros(len(by), bool)
        again[1:] = ~new[1:] & (item[by][1:] == item[by][:-1])
        kept = np.flatnonzero(~again)
        begin = np.flatnonzero(new[kept])
        self.item, self.of = item[by[kept]], np.append(begin, len(kept))
        self.at, self.length = at[by[kept[begin]]], length[by[kept[begin]]]
        self.sizes = sorted({min(SHINGLE, int(x)) for x in np.unique(self.length)})
        self.runs = {q: shingles(self.words, q) for q in self.sizes}
        self.tokens = {q: np.unique(np.concatenate([self.runs[q][p.ravel()] for _, p in self._places(q)])) for q in self.sizes}

    def _places(self, q: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Windows of one length whose shingles have q words, and where these begin, a row a window."""
        for x in np.unique(self.length):
            if min(SHINGLE, int(x)) == q:
                own = np.flatnonzero(self.length == x)
                yield own, self.at[own][:, None] + np.arange(int(x) - q + 1)

    def order(self, df: dict[int, np.ndarray]) -> None:
        """Chooses the rarest shingle of each window as the prefix, given how many documents hold each."""
        self.keys: dict[int, tuple] = {}
        for q in self.sizes:
            rank = np.empty(len(self.tokens[q]), np.int64)
            rank[np.lexsort((self.tokens[q], df[q]))] = np.arange(len(rank))
            wins, keys, places = [], [], []
            for own, p in self._places(q):
                runs = self.runs[q][p]
                best = np.argmin(rank[np.searchsorted(self.tokens[q], runs)], axis=1)
                wins.append(own)
                keys.append(runs[np.arange(len(own)), best])
                places.append(best)
            own, key, place = np.concatenate(wins), np.concatenate(keys), np.concatenate(places)
            by = np.argsort(key, kind="stable")
            distinct, begin = np.unique(key[by], return_index=True)
            self.keys[q] = (distinct, np.append(begin, len(by)), own[by], place[by], _sieve(distinct))
        del self.runs


def _sieve(hashes: np.ndarray) -> np.ndarray:
    """Bitmap that most other hashes fail."""
    seen = np.zeros(1 << 22, bool)
    seen[(hashes & np.uint64(len(seen) - 1)).astype(np.int64)] = True
    return seen


def _find(runs: np.ndarray, table: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of runs that are in the sorted table, and where in it."""
    may = np.flatnonzero(sieve[(runs & np.uint64(len(sieve) - 1)).astype(np.int64)])
    at = np.minimum(np.searchsorted(table, runs[may]), len(table) - 1)
    same = table[at] == runs[may]
    return may[same], at[same]


def _frequencies(docs: DataFrame, text: str, win: Windows) -> dict[int, np.ndarray]:
    """Number of documents with each of the block's shingles, counted over all documents."""
    sent = docs.sparkSession.sparkContext.broadcast((win.sizes, win.tokens))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_runs("decontaminate")
        sizes, tokens = sent.value
        seen = {q: np.zeros(len(tokens[q]), np.int64) for q in sizes}
        sieves = {q: _sieve(tokens[q]) for q in sizes}
        for batch in batches:
            buf, off = string_buffers(batch.column(0))
            for a, b in blocks(off):
                hashes, first = hash_words(buf, off[a : b + 1], ALNUM)
                for q in sizes:
                    place, at = _find(shingles(hashes, q), tokens[q], sieves[q])
                    doc = np.searchsorted(first, place, side="right") - 1
                    inside = place + q <= first[doc + 1]
                    pairs = np.unique(doc[inside] * len(tokens[q]) + at[inside])
                    seen[q] += np.bincount(pairs % len(tokens[q]), minlength=len(tokens[q]))
        for q in sizes:
            some = np.flatnonzero(seen[q])
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), q, np.int32)), pa.array(some), pa.array(seen[q][some])], names=["q", "at", "df"])

    rows = docs.select(text).mapInArrow(count, "q int, at long, df long").groupBy("q", "at").agg(F.sum("df").alias("df")).toLocalIterator()
    out = {q: np.zeros(len(win.tokens[q]), np.int64) for q in win.sizes}
    for r in rows:  # a row for each of the block's shingles at most
        out[r.q][r.at] = r.df
    return out


def _scan(hashes: np.ndarray, first: np.ndarray, win: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Verified occurrences: document, first word, window."""
    docs, starts, found = [], [], []
    for q, (distinct, begin, own, place, sieve) in win.keys.items():
        pos, at = _find(shingles(hashes, q), distinct, sieve)
        many = begin[at + 1] - begin[at]
        for lo in range(0, len(pos), 20_000):
            n = many[lo : lo + 20_000]
            p = np.repeat(pos[lo : lo + 20_000], n)
            j = np.repeat(begin[at[lo : lo + 20_000]], n) + np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n)
            w, s = own[j], p - place[j]
            doc = np.searchsorted(first, p, side="right") - 1
            ok = (s >= first[doc]) & (s + win.length[w] <= first[doc + 1])
            w, s, doc = w[ok], s[ok], doc[ok]
            for size in np.unique(win.length[w]):
                own_size = np.flatnonzero(win.length[w] == size)
                step = np.arange(size)
                for c in range(0, len(own_size), 50_000):
                    i = own_size[c : c + 50_000]
                    same = (hashes[s[i][:, None] + step] == win.words[win.at[w[i]][:, None] + step]).all(axis=1)
                    docs.append(doc[i[same]])
                    starts.append(s[i[same]])
                    found.append(w[i[same]])
    empty = [np.zeros(0, np.int64)]
    return tuple(np.concatenate(x or empty) for x in (docs, starts, found))


def _mark(docs: DataFrame, text: str, into: str, win: Windows, former: str | None) -> DataFrame:
    """docs with the column `into`; the column `former` of an earlier block is taken in and dropped."""
    sent = docs.sparkSession.sparkContext.broadcast(win)
    kept = [f for f in docs.schema.fields if f.name != former]
    text_at, former_at = docs.columns.index(text), docs.columns.index(former) if former else None
    kept_at = [docs.columns.index(f.name) for f in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        win = sent.value
        for batch in batches:
            buf, off = string_buffers(batch.column(text_at))
            old = batch.column(former_at).to_pylist() if former_at is not None else None
            out = []
            for a, b in blocks(off):
                hashes, first = hash_words(buf, off[a : b + 1], ALNUM)
                doc, start, w = _scan(hashes, first, win)
                depth = np.zeros(len(hashes) + 1, np.int64)
                np.add.at(depth, start, 1)
                np.add.at(depth, start + win.length[w], -1)
                hit = np.cumsum(depth)[:-1] > 0
                ids: dict[int, set[str]] = {}
                for d, x in set(zip(doc.tolist(), w.tolist(), strict=True)):
                    ids.setdefault(d, set()).update(win.ids[i] for i in win.item[win.of[x] : win.of[x + 1]].tolist())
                for i in range(b - a):
                    s, e = int(first[i]), int(first[i + 1])
                    own, prior = hit[s:e], old[a + i] if old else None
                    items, spans = ids.get(i, set()), []
                    if prior and prior["spans"]:
                        own = own.copy()
                        for x in prior["spans"]:
                            own[x["start"] : x["end"]] = True
                        items = items | set(prior["item_ids"])
                    if items:
                        turn = np.diff(np.concatenate(([0], own.astype(np.int8), [0])))
                        spans = [{"start": int(x), "end": int(y)} for x, y in zip(np.flatnonzero(turn == 1), np.flatnonzero(turn == -1), strict=True)]
                    out.append({"n_words": e - s, "n_hit": int(own.sum()) if items else 0, "item_ids": sorted(items), "spans": spans})
            yield pa.RecordBatch.from_arrays([batch.column(i) for i in kept_at] + [pa.array(out, _ARROW)], names=[f.name for f in kept] + [into])

    return docs.mapInArrow(run, T.StructType([*kept, T.StructField(into, RESULT)]))


def find_contamination(docs: DataFrame, items: DataFrame, *, into: str = "contamination", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with a struct column `into`: words, hit words, ids of the items with occurring windows, hit spans (in words)."""
    former = None
    ids: list[str] = []
    texts: list[str | None] = []
    held = 0

    def add() -> None:
        nonlocal docs, former, ids, texts, held
        win = Windows(ids, texts, window)
        if len(win.at) or former is None:
            win.order(_frequencies(plain, text, win) if win.sizes else {})
            name = f"__{into}_{uuid.uuid4().hex}"
            docs = _mark(docs, text, name, win, former)
            former = name
        ids, texts, held = [], [], 0

    docs = plain = docs.drop(into)
    source = items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("i"), F.col(item_text).alias("t"))
    for row in source.toLocalIterator():  # a block at a time is held here
        ids.append(row.i)
        texts.append(row.t)
        held += len(row.t or "") // 4 + 1
        if held >= block_words:
            add()
    if texts or former is None:
        add()
    return docs.withColumnRenamed(former, into)
