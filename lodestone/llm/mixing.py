"""Mixing sources to target weights by hash-threshold histograms, on DataFrame functions alone.

Every document has a hash of 60 bits. A source whose target is f times its size plus a remainder takes
each document f times and those under a hash threshold once more. The threshold is found without a sort:
sum sizes by source and the top 10 bits of the hash, find the bucket where the running sum passes the
remainder, and refine only that bucket by the next 10 bits, until it holds one document or the bits end.
Thresholds are nested: a smaller target keeps a subset of what a larger one keeps.

Edge cases: a null text has size 0; a null source is a source of its own, last in order; sources without
words have target 0 and take nothing; a text of any length is counted whole; rows that repeat a doc_id share its hash and are taken alike; an
empty table gives an empty result; other columns of docs stay untouched, whatever their names. The
sources are ordered in one task, a row a source: some millions of them at most.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import by_code_point, cut, small

BITS, LEVELS = 10, 6
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash60(doc_id: Column) -> Column:
    """60 bits of an MD5, so that SQL engines agree on it."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size) -> also its target. share of all sizes goes out by weight; what passes most times a source's size is dealt again.

    The level that the water reaches is where the sources in order of size to weight stop being full.
    """
    nth = F.row_number().over(W.orderBy(by_code_point("source")))
    w = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), ((nth - 1) % len(weights) + 1).cast("int"))
    df = sizes.select("source", "source_size", w.alias("w")).withColumn("cap", F.col("source_size") * float(most))
    order = W.orderBy((F.col("cap") / F.col("w")).asc(), by_code_point("source"))
    everything = W.partitionBy()
    budget = F.least(F.sum("source_size").over(everything) * F.lit(float(share)), F.sum("cap").over(everything))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("w").over(order.rowsBetween(0, W.unboundedFollowing))
    df = df.withColumn("nth", F.row_number().over(order)).withColumn("level", (budget - before) / rest)
    # the first source in this order that its share does not fill sets the level for itself and all after it
    first = F.min(F.when(F.col("cap") > F.col("level") * F.col("w"), F.col("nth"))).over(everything)
    df = df.withColumn("first", first)
    level = F.max(F.when(F.col("nth") == F.col("first"), F.col("level"))).over(everything)
    target = F.when(F.col("nth") >= F.col("first"), F.least("cap", level * F.col("w"))).otherwise(F.col("cap"))
    return df.select("source", "source_size", target.alias("target"))


def thresholds(narrow: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, source_size, target, copies, below): taken are copies of every document, and one more of those with h < below."""
    whole = F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1))).cast("long")
    state = targets.withColumn("copies", whole).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    # first: the bucket still open, as the hash's leading bits; done: whether the threshold is known
    state = state.withColumn("below", F.lit(0).cast("long")).withColumn("done", F.col("left") <= 0)
    state = cut(state)
    for level in range(LEVELS):
        open_ = state.where(~F.col("done")).select(F.col("source").alias("s"), "below", "left")
        if open_.isEmpty():
            break
        shift = 60 - BITS * (level + 1)
        inside = F.shiftright("h", shift + BITS) == F.shiftright("below", shift + BITS)
        hist = narrow.join(small(open_), F.col("source").eqNullSafe(F.col("s")) & inside).groupBy("s", "below", "left", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("sum"), F.count("*").alias("n"))
        run = W.partitionBy("s").orderBy("b")
        hist = hist.withColumn("upto", F.sum("sum").over(run))
        edge = hist.where(F.col("upto") > F.col("left")).groupBy("s").agg(F.min_by(F.struct("b", "n", (F.col("upto") - F.col("sum")).alias("before"), "sum"), "b").alias("e"))
        state = state.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
        e = F.col("e")
        last = (e.n == 1) | F.lit(level == LEVELS - 1)
        take = (F.col("left") - e.before) * 2 >= e["sum"]  # the bucket at the edge as a whole, if that comes nearer
        at = F.shiftleft(F.col("e.b"), shift)
        step = F.shiftleft(F.lit(1).cast("long"), shift)
        state = state.select(
            "source", "source_size", "target", "copies",
            F.when(F.col("done") | e.isNull(), F.col("left")).otherwise(F.col("left") - e.before).alias("left"),
            F.when(F.col("done"), F.col("below")).when(e.isNull(), F.col("below") + F.shiftleft(F.lit(1).cast("long"), shift + BITS)).when(last & take, at + step).otherwise(at).alias("below"),
            (F.col("done") | e.isNull() | last).alias("done"),
        )
        state = cut(state)
    return state.drop("left", "done")


def mix_plan(docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """Sizes of all documents (doc_id, source, size, h), and the sources' targets and thresholds."""
    narrow = cut(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), hash60(F.col(doc_id)).alias("h")))
    sizes = narrow.groupBy("source").agg(F.sum("size").alias("source_size"))
    return narrow, thresholds(narrow, source_targets(sizes, weights=weights, share=share, most=most))


def copies_of(plan: DataFrame, docs: DataFrame, *, doc_id: str = "doc_id", source: str = "source") -> DataFrame:
    """docs with every document as often as the mix takes it; its columns stay as they are."""
    names = docs.columns
    plan = plan.select(*(F.col(c).alias(f"__mix_{c}") for c in ("source", "copies", "below")))
    out = docs.join(small(plan), F.col(source).eqNullSafe(F.col("__mix_source")), "left")
    n = F.col("__mix_copies") + (hash60(F.col(doc_id)) < F.col("__mix_below")).cast("long")
    return out.where(n > 0).withColumn("__mix_n", F.explode(F.array_repeat(F.lit(1), n.cast("int")))).select(*names)


def mix_sources(docs: DataFrame, **how) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted)."""
    narrow, plan = mix_plan(docs, **how)
    plan = plan.withColumnRenamed("source", "s")
    taken = F.col("size") * (F.col("copies") + (F.col("h") < F.col("below")).cast("long"))
    return narrow.join(small(plan), F.col("source").eqNullSafe(F.col("s"))).select("doc_id", "size", "source_size", "target", taken.alias("taken"))
