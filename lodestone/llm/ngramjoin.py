"""N-gram Jaccard join: a size-aware heavy-light set join, exact.

A document is the set of its distinct k-word shingles. Two documents link when the Jaccard similarity
of their sets is at least num / den.

1. Documents with equal sets are one class; its smallest doc_id stands for it. Only these are joined.
2. Shingles are ordered by rarity (those that many documents hold come last, the others by hash). Sets
   of n shingles that link share the first of their common ones within the first
   p = n - ceil(n * num / den) + 1, and the first two within p + 1.
3. Small sets enumerate their subsets of two out of those p + 1 and meet in equal subsets. Large sets,
   and the small ones near enough in size to link with a large one, post p single shingles into inverted
   lists that are scanned. The boundary is the size at which the two cost the least: subsets written
   against postings written plus the meetings expected in shared lists.
4. A meeting counts only if the sizes allow a link and so many shingles remain behind the meeting's place
   on both sides (positional bound).
5. Lists of shingles that are not known to be frequent are dealt and sorted by key and scanned as a
   stream; those of up to LIGHT entries give their pairs right there. Longer ones, and those of frequent
   shingles, are not multiplied out: first each entry meets two hubs of its list; links are verified and
   contracted. Then only entries outside their list's main component meet the entries of other
   components, dealt by length. A group of near copies thus costs in proportion to its size, and these
   lists are handled by sums and joins that can be split.
6. Candidates pass an upper bound by histograms of about eight shingles a bin and are then verified on the whole sets, which
   are made again from the whole texts of the candidates alone.

Words and shingles are compared as 64-bit hashes throughout, so two different ones count as equal with a
chance of 2**-64 a pair. The links that come out span the components; `all_links` gives every link.
Documents nearly all of whose shingles are frequent, and that share some but do not link, are compared
pair by pair. A text of any length is read whole; a pair of sets is held in one worker, 16 bytes a word.

Ids are integers. Edge cases: a null or empty text, or one without words, has an empty set and links with
nothing; a text of fewer than k words has its whole sequence as its one shingle; rows that share a doc_id
are one document whose rows' links are joined; a null doc_id links with nothing and has no component;
an empty table gives an empty result; extra columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_rows, shuffle_width, small, worker_runs
from lodestone.llm.components import components
from lodestone.llm.wordhash import mix, shingle_sets, string_buffers
from lodestone.scratch import cut, scratch, spread_join

#: How many of the most frequent shingles the order by rarity knows; the others count as equally rare.
HEAVY = 100_000
BINS, PER_BIN = 64, 8
#: Cost of an entry in a shared list, in subsets or postings written: it meets two hubs.
ENTRY_COST = 3.0
#: Entries of a list that are paired as they stream by.
LIGHT = 16
BOUNDARIES = (0, 6, 8, 10, 13, 16, 20, 26, 34, 44, 56, 72, 96, 128)
#: Texts in an Arrow batch.
TEXT_ROWS = 500
#: Pairs of sets in an Arrow batch.
SET_ROWS = 16
_FLIP = 0x5555555555555555


def _prefix(n: int, num: int, den: int) -> int:
    return n - -(-n * num // den) + 1


def _bins(n: int) -> int:
    """Bins of a set's histogram: BINS, doubled until no more than PER_BIN shingles come on one. No bin then nears 32767."""
    out = BINS
    while out * PER_BIN < n:
        out *= 2
    return out


def thrice(held: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The values that the arrays hold three times or more, sorted, and how often. held is emptied, so that no more than two copies are in memory."""
    value = np.concatenate(held)
    held.clear()
    value.sort()
    often = np.unique(value[2:][value[2:] == value[:-2]])
    return often, np.searchsorted(value, often, side="right") - np.searchsorted(value, often)


def heavy_shingles(texts: DataFrame, k: int, most: int = HEAVY) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles (sorted) and in how many documents they were met. Shingles that no part of the input holds three times are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_runs("ngramjoin")
        held, n = [], 0

        def flush() -> pa.RecordBatch:
            value, times = thrice(held)
            return pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(times)], names=["h", "df"])

        for batch in batches:
            for s in shingle_sets(*string_buffers(batch.column(0)), k):
                held.append(s)
                n += len(s)
                if n > 2_000_000:
                    yield flush()
                    n = 0
        if held:
            yield flush()

    seen = texts.mapInArrow(count, "h long, df long").groupBy("h").agg(F.sum("df").alias("df")).orderBy(F.col("df").desc(), "h").limit(most)
    rows = seen.toPandas()  # bounded by most
    h = rows["h"].to_numpy(np.int64).view(np.uint64)
    by = np.argsort(h)
    return h[by], rows["df"].to_numpy(np.int64)[by]


def signatures(docs: DataFrame, k: int, num: int, den: int, heavy: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """Of docs (doc_id, text): doc_id, n, h1, h2, pre, cold, hist: size, 128-bit hash of the set, its rarest p + 1 shingles in order, how many of these are not known to be frequent, histogram."""
    sent = docs.sparkSession.sparkContext.broadcast(heavy)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_runs("ngramjoin")
        heavy, df = sent.value
        with np.errstate(over="ignore"):
            for batch in batches:
                n, h1, h2, pre, cold, hist = [], [], [], [], [], []
                for s in shingle_sets(*string_buffers(batch.column(1)), k):
                    n.append(len(s))
                    h1.append(np.int64(np.add.reduce(mix(s)).astype(np.int64)))
                    h2.append(np.int64(np.bitwise_xor.reduce(mix(s ^ np.uint64(_FLIP)), initial=np.uint64(0)).astype(np.int64)))
                    if len(heavy):
                        at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
                        freq = np.where(heavy[at] == s, df[at], 0)
                    else:
                        freq = np.zeros(len(s), np.int64)
                    first = np.lexsort((s, freq))[: _prefix(len(s), num, den) + 1] if len(s) else np.zeros(0, np.int64)
                    pre.append(s[first].view(np.int64))
                    cold.append(int((freq[first] == 0).sum()))
                    bins = _bins(len(s))
                    hist.append(np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % bins, minlength=bins), 32767).astype(np.int16))
                lists = [pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum([len(x) for x in part]))).astype(np.int32)), pa.array(np.concatenate(part) if part else [], kind)) for part, kind in ((pre, pa.int64()), (hist, pa.int16()))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), lists[0], pa.array(cold, pa.int32()), lists[1]], names=["doc_id", "n", "h1", "h2", "pre", "cold", "hist"])

    return docs.mapInArrow(sign, "doc_id long, n long, h1 long, h2 long, pre array<long>, cold int, hist array<short>")


def boundary(reps: DataFrame, num: int, den: int) -> int:
    """The largest size of sets that enumerate subsets, by the least total cost over all sets."""
    p = F.size("pre") - 1
    costs = []
    for b in BOUNDARIES:
        subsets = F.when(F.col("n") <= b, p * (p + 1) / 2).otherwise(0.0)
        lists = F.when((F.col("n") > b) | (F.col("n") * den >= num * (b + 1)), p + F.greatest(p - F.col("cold"), F.lit(0)) * ENTRY_COST).otherwise(0.0)
        costs.append(F.sum(subsets + lists).alias(f"b{b}"))
    row = reps.agg(*costs).first()
    return min(BOUNDARIES, key=lambda b: (row[f"b{b}"] or 0.0, b))


def postings(reps: DataFrame, b: int, num: int, den: int) -> DataFrame:
    """(key, doc, n, rem, hot): rem is how many common shingles a meeting here allows at most; hot keys are made of frequent shingles alone."""
    n = F.col("n")
    able = reps.where(n * (den - num) >= num)  # smaller sets link with equal ones alone
    single = able.where((n > b) | (n * den >= num * (b + 1))).select("doc_id", "n", "cold", F.posexplode(F.expr("slice(pre, 1, size(pre) - 1)")).alias("i", "key"))
    single = single.select("key", F.col("doc_id").alias("doc"), "n", (n - F.col("i")).alias("rem"), (F.col("i") >= F.col("cold")).alias("hot"))
    second = F.transform("pre", lambda x, i: F.struct(x.alias("x"), i.alias("i")))
    pairs = able.where((n <= b) & (F.size("pre") >= 2)).select("doc_id", "n", "pre", "cold", F.explode(second).alias("two"))
    pairs = pairs.where(F.col("two.i") > 0).select("doc_id", "n", "two", "cold", F.posexplode(F.expr("slice(pre, 1, two.i)")).alias("j", "one"))
    pairs = pairs.select(F.xxhash64(F.lit(2), "one", "two.x").alias("key"), F.col("doc_id").alias("doc"), "n", (n - F.col("two.i") + 1).alias("rem"), (F.col("j") >= F.col("cold")).alias("hot"))
    return single.unionByName(pairs)


def scan_lists(entries: DataFrame, num: int, den: int, light: int = LIGHT) -> DataFrame:
    """(a, b, n, rem) of entries dealt and sorted by key: pairs (a, b) of short lists that may link, with n null and in rem how often they met; entries (key, doc, n, rem) of long ones as they are."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_runs("ngramjoin")
        names = ["a", "b", "n", "rem"]

        def as_they_are(rows: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(rows[i]) for i in range(4)], names=names)

        def pairs(rows: np.ndarray, start: np.ndarray, size: np.ndarray) -> Iterator[pa.RecordBatch]:
            a, b = [], []
            for s in range(2, light + 1):
                own = start[size == s]
                for i in range(s if len(own) else 0):
                    for j in range(i):
                        x, y = rows[:, own + i], rows[:, own + j]
                        need = -(-(x[2] + y[2]) * num // (num + den))
                        ok = (x[1] != y[1]) & (np.minimum(x[2], y[2]) * den >= np.maximum(x[2], y[2]) * num) & (np.minimum(x[3], y[3]) >= need)
                        a.append(np.minimum(x[1], y[1])[ok])
                        b.append(np.maximum(x[1], y[1])[ok])
            if a:
                both, times = np.unique(np.column_stack((np.concatenate(a), np.concatenate(b))), axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.nulls(len(both), pa.int64()), pa.array(times.astype(np.int64))], names=names)

        held = np.zeros((4, 0), np.int64)
        long_key = None  # the key of a list that is already known to be long
        for batch in batches:
            rows = np.concatenate((held, np.array([batch.column(i).to_numpy() for i in range(4)])), axis=1)
            if long_key is not None:
                k = int(np.searchsorted(rows[0], long_key, side="right"))
                if k:
                    yield as_they_are(rows[:, :k])
                rows = rows[:, k:]
                if rows.shape[1]:
                    long_key = None
            if not rows.shape[1]:
                held = rows
                continue
            start = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1])))
            size = np.diff(np.append(start, rows.shape[1]))
            held = rows[:, start[-1] :]  # the last list may go on in the next batch
            yield from pairs(rows, start[:-1], size[:-1])
            for s, n in zip(start[:-1][size[:-1] > light], size[:-1][size[:-1] > light], strict=True):
                yield as_they_are(rows[:, s : s + n])
            if held.shape[1] > light:
                long_key = held[0, 0]
                yield as_they_are(held)
                held = held[:, :0]
        if held.shape[1]:
            yield from pairs(held, np.zeros(1, np.int64), np.array([held.shape[1]]))

    dealt = entries.select("key", "doc", "n", F.col("rem").cast("long").alias("rem")).repartition(shuffle_width(entries.sparkSession), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(scan, "a long, b long, n long, rem long")


def _may(a_n: Column, b_n: Column, a_rem: Column, b_rem: Column, num: int, den: int) -> Column:
    """Whether sizes and places allow a link."""
    need = F.ceil((a_n + b_n) * num / (num + den))
    return (F.least(a_n, b_n) * den >= F.greatest(a_n, b_n) * num) & (F.least(a_rem, b_rem) >= need)


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Those of the pairs (a, b) that link, with their overlap."""
    spark = docs.sparkSession
    pairs = cut(pairs.distinct())
    both, hist = pairs, reps.select("doc_id", "n", "hist")
    for end in ("a", "b"):  # a pair's ends may be in many pairs
        both = spread_join(both, hist.select(F.col("doc_id").alias(end), F.col("n").alias(f"{end}n"), F.col("hist").alias(f"{end}h")), [end], counted=pairs)
    # of two histograms the finer is folded to the bins of the other; sets that may link differ by one doubling at most
    bins = F.least(F.size("ah"), F.size("bh"))
    fold = lambda h: F.when(F.size(h) > bins, F.zip_with(F.slice(h, 1, bins), F.slice(h, bins + 1, bins), lambda x, y: x.cast("int") + y.cast("int"))).otherwise(F.col(h).cast("array<int>"))
    most = F.aggregate(F.zip_with(fold("ah"), fold("bh"), lambda x, y: F.least(x, y)), F.lit(0).cast("int"), lambda x, y: x + y)
    may = most * (num + den) >= (F.col("an") + F.col("bn")) * num
    pairs = cut(both.where(may).select("a", "b"))
    ids = cut(pairs.select(F.col("a").alias("__id")).union(pairs.select("b")).distinct())
    own = docs.join(small(ids), F.col("doc_id") == F.col("__id"), "left_semi")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_runs("ngramjoin")
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([s.tobytes() for s in shingle_sets(*string_buffers(batch.column(1)), k)], pa.binary())], names=["doc_id", "s"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worker_runs("ngramjoin")
        for batch in batches:
            a, b, overlap = [], [], []
            for i in range(batch.num_rows):
                s, t = (np.frombuffer(batch.column(c)[i].as_buffer(), np.uint64) for c in (2, 3))
                at = np.minimum(np.searchsorted(t, s), max(len(t) - 1, 0))
                common = int((t[at] == s).sum()) if len(t) else 0
                if common * den >= num * (len(s) + len(t) - common):
                    a.append(batch.column(0)[i].as_py())
                    b.append(batch.column(1)[i].as_py())
                    overlap.append(common)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(overlap, pa.int64())], names=["a", "b", "overlap"])

    with arrow_rows(spark, TEXT_ROWS):
        held = cut(own.mapInArrow(sets, "doc_id long, s binary"))
    full = pairs
    for end in ("a", "b"):
        full = spread_join(full, held.select(F.col("doc_id").alias(end), F.col("s").alias(f"s{end}")), [end], counted=pairs)
    with arrow_rows(spark, SET_ROWS):
        return cut(full.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long, overlap long"))


def apart(pairs: DataFrame, known: DataFrame) -> DataFrame:
    """The pairs (a, b) whose ends are not in one component of known (id, component)."""
    for end in ("a", "b"):
        pairs = spread_join(pairs, known.select(F.col("id").alias(end), F.col("component").alias(f"__c{end}")), [end], "left")
    return pairs.where(F.coalesce("__ca", "a") != F.coalesce("__cb", "b")).select("a", "b")


def _pairs(left: DataFrame, right: DataFrame, on: list[str], num: int, den: int) -> DataFrame:
    """Pairs a < b of (doc, n, rem) of left and right that meet on `on` and may link."""
    other = right.select(*on, F.col("doc").alias("odoc"), F.col("n").alias("on_"), F.col("rem").alias("orem"))
    met = spread_join(left.select(*on, "doc", "n", "rem"), other, on)
    met = met.where((F.col("doc") != F.col("odoc")) & _may(F.col("n"), F.col("on_"), F.col("rem"), F.col("orem"), num, den))
    return met.select(F.least("doc", "odoc").alias("a"), F.greatest("doc", "odoc").alias("b"))


def _signed(docs: DataFrame, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of docs (doc_id, text): each row once; signatures of all rows; classes of equal sets (n, h1, h2, rep); signatures of their representatives."""
    repeated = not docs.groupBy("doc_id", F.xxhash64("text").alias("h")).agg(F.count("*").alias("c")).where("c > 1").isEmpty()
    once = cut(docs.distinct()) if repeated else docs
    with arrow_rows(docs.sparkSession, TEXT_ROWS):
        signed = cut(signatures(docs, k, num, den, heavy_shingles(docs.select("text"), k)))
    named = signed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    classes = cut(named.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("rep")))
    # every row but its class's representative is a copy: these are left out, by broadcast where few enough
    copies = named.select("n", "h1", "h2", "doc_id").join(classes, ["n", "h1", "h2"]).where("doc_id <> rep").select("doc_id", "h1", "h2")
    reps = named.join(small(cut(copies)), ["doc_id", "h1", "h2"], "left_anti")
    reps = reps.dropDuplicates(["doc_id", "h1", "h2"]) if repeated else reps
    return once, signed, classes, reps.select("doc_id", "n", "pre", "cold", "hist")


def _own(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def all_links(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(a, b, overlap): every link between two classes of equal sets, each under its smallest doc_id. As many rows as links, which in a group of near copies is the square of its size."""
    with scratch(docs.sparkSession) as keep:
        texts, _, _, reps = _signed(_own(docs, doc_id, text), k, num, den)
        entries = cut(postings(reps, boundary(reps, num, den), num, den).select("key", "doc", "n", F.col("rem").cast("long").alias("rem")))
        return keep(verify(_pairs(entries, entries, ["key"], num, den), reps, texts, k, num, den))


def ngram_join(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", k: int = 5, num: int = 80, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """(per row doc_id, n_shingles, class_id, component_id; verified links a, b, overlap between classes that span the components)."""
    with scratch(docs.sparkSession) as keep:
        texts, signed, classes, reps = _signed(_own(docs, doc_id, text), k, num, den)
        entries = cut(postings(reps, boundary(reps, num, den), num, den))
        scanned = cut(scan_lists(entries.where(~F.col("hot")), num, den))
        light = scanned.where("n is null").select("a", "b", F.col("rem").alias("times"))
        long_ = scanned.where("n is not null").select(F.col("a").alias("key"), F.col("b").alias("doc"), "n", "rem")
        met = cut(entries.where("hot").select("key", "doc", "n", F.col("rem").cast("long").alias("rem")).unionByName(long_))

        entry = F.struct("doc", "n", "rem")
        lists = cut(met.groupBy("key").agg(F.count("*").alias("c"), F.min(entry).alias("lo"), F.max(entry).alias("hi")).where("lo.doc <> hi.doc"))
        hubs = lists.select("key", F.explode(F.array("lo", "hi")).alias("x")).select("key", "x.*")
        with_hub = _pairs(met, hubs, ["key"], num, den).withColumn("times", F.lit(1).cast("long"))
        first = cut(with_hub.unionByName(light).groupBy("a", "b").agg(F.sum("times").alias("times")))
        # each document is held against the one it met most often, then against others of other components alone
        best = first.groupBy("b").agg(F.max_by("a", F.struct("times", -F.col("a"))).alias("a")).select("a", "b")
        links = verify(best, reps, texts, k, num, den)
        links = links.unionByName(verify(apart(first.select("a", "b"), components(links)), reps, texts, k, num, den))

        # lists of up to three entries are done: each of their pairs has a hub
        own = spread_join(met, lists.where("c > 3").select("key"), ["key"], "left_semi")
        own = spread_join(own, components(links).withColumnRenamed("id", "doc"), ["doc"], "left").select("key", "doc", "n", "rem", F.coalesce("component", "doc").alias("comp"))
        own = cut(own)
        per = cut(own.groupBy("key", "comp").agg(F.count("*").alias("c")).groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k"))
        band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(den / num))).cast("long")
        own = cut(spread_join(own, per, ["key"]).withColumn("band", band))
        strays = own.where("comp <> main").withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
        rest = _pairs(own, strays, ["key", "band"], num, den).distinct().join(first, ["a", "b"], "left_anti")
        links = cut(links.unionByName(verify(apart(rest, components(links)), reps, texts, k, num, den)))

        member = signed.select("doc_id", "n", "h1", "h2").join(classes, ["n", "h1", "h2"], "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("rep", "doc_id")).alias("class_id"))
        member = cut(member)
        several = member.groupBy("doc_id").agg(F.min("class_id").alias("a"), F.max("class_id").alias("z")).where("a <> z")  # rows of one doc_id in different classes
        same = member.join(several, "doc_id", "left_semi").select("doc_id", F.col("class_id").alias("b"))
        edges = links.select("a", "b").union(same.select(F.col("doc_id").alias("a"), "b"))
        out = member.join(small(components(edges)), F.col("class_id") == F.col("id"), "left").select("doc_id", "n_shingles", "class_id", F.coalesce("component", "class_id").alias("component_id"))
        return keep(out), keep(links)
