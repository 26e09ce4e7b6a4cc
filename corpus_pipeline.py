"""The corpus pipeline: quality, near duplicates, decontamination, mixing and token files, each on all that the stage before kept.

STAGES lists (name, function); each function takes (spark, docs, sf_dir) and returns a DataFrame. run()
applies them to documents, writing each stage's result as Parquet in the shared folder and reading it
again for the next. ORACLE_SQL is None: the classifier and the tokenizer have no SQL. tests/llm hold the
stages against plain versions.

Edge cases, by stage as its operator's docstring has them: a null or empty text is judged by the
classifier like any other, is nobody's copy, has no benchmark words, takes size 0 in the mix and its end id
alone in the files; rows that share a doc_id go by their own texts, and of those that share the text as
well one stays; a null doc_id is never a copy; very long texts are read whole; an empty table passes all
stages; extra columns stay until the last stage, whatever their names.

All but the last return the columns of docs, whatever they are. The last returns, per document as often
as the mix takes it, in the order of doc_id: doc_id, start, n_tokens, ids_crc32, read back from the files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestone.llm.common import table
from lodestone.scratch import cut, new_dir, scratch, small

TOKENIZER = "word_bpe_49k.json"
END_ID = 2
#: Share of a document's words inside benchmark passages from which it goes, as 1 in so many.
HIT_SHARE = 20


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less the rows with a doc_id and text hash (d, same) in gone."""
    gone = gone.select(F.col("d").alias("__gone_d"), F.col("same").alias("__gone_same")).distinct()
    return docs.join(small(cut(gone)), F.col("doc_id").eqNullSafe(F.col("__gone_d")) & (F.xxhash64("text") == F.col("__gone_same")), "left_anti")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality classifier rejects."""
    from lodestone.llm.quality import classify

    has = set(docs.columns)
    host = F.col("source") if "source" in has else F.lit(None).cast("string")
    path = F.concat_ws("/", "source", "lang") if {"source", "lang"} <= has else host
    found = classify(docs, table(spark, sf_dir, "labels"), host=host, path=path)
    return _without(docs, found.where(~F.col("keep")).select(F.col("doc_id").alias("d"), "same"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document stays of each group whose word 5-shingles have a Jaccard similarity of 0.8 or more: that with the smallest doc_id.

    Rows that share a doc_id and a text are copies of each other; rows that share a doc_id alone are not, and go by their own text.
    """
    from lodestone.llm.ngramjoin import ngram_join

    same = F.xxhash64("text")
    by_id = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min(same).alias("lo"), F.max(same).alias("hi"), F.count("*").alias("n")).where("n > 1")
    by_id = cut(by_id)
    if by_id.isEmpty():
        found, _ = ngram_join(docs, k=5, num=80, den=100)
        gone = found.where(F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("component_id"))).select(F.col("doc_id").alias("__gone_d")).distinct()
        return docs.join(small(cut(gone)), F.col("doc_id") == F.col("__gone_d"), "left_anti")
    # texts that share a doc_id go through the join under ids of their own
    clash = by_id.where("lo <> hi").select(F.col("doc_id").alias("__d"))
    own = docs.withColumn("__same", same)
    texts = own.join(small(clash), F.col("doc_id") == F.col("__d"), "left_semi").select(F.col("doc_id").alias("__d"), F.col("__same").alias("__s")).distinct()
    top = docs.agg(F.max("doc_id")).first()[0]
    ids = cut(cut(texts).withColumn("__id", F.monotonically_increasing_id() + F.lit(top).cast("long") + 1))
    named = own.join(small(ids), (F.col("doc_id") == F.col("__d")) & (F.col("__same") == F.col("__s")), "left").select(F.coalesce("__id", F.col("doc_id").cast("long")).alias("__key"), "text")
    found, _ = ngram_join(named, doc_id="__key", k=5, num=80, den=100)
    found = found.where("doc_id is not null and n_shingles > 0").select(F.col("doc_id").alias("__key"), "component_id").distinct()
    found = found.join(small(ids), F.col("__key") == F.col("__id"), "left").select("__key", "component_id", F.coalesce("__d", "__key").alias("d"), "__s")
    found = cut(found)
    first = found.groupBy("component_id").agg(F.min(F.struct("d", "__s")).alias("first"))
    gone = found.join(first, "component_id").where(~F.struct("d", "__s").eqNullSafe(F.col("first"))).select(F.col("d").alias("__gone_d"), F.col("__s").alias("__gone_s"))
    kept = own.join(small(cut(gone)), (F.col("doc_id") == F.col("__gone_d")) & (F.col("__gone_s").isNull() | (F.col("__same") == F.col("__gone_s"))), "left_anti")
    # of rows that share doc_id and text one stays, the first by its other columns; texts without words stay
    worded = found.select(F.col("d").alias("__w_d"), F.col("__s").alias("__w_s")).join(small(by_id.select(F.col("doc_id").alias("__w_d"))), "__w_d", "left_semi")
    is_worded = (F.col("doc_id") == F.col("__w_d")) & (F.col("__w_s").isNull() | (F.col("__same") == F.col("__w_s")))
    worded = small(cut(worded))
    order = W.partitionBy("doc_id", "__same").orderBy(F.to_json(F.struct(*(c for c in docs.columns if c != "text"))))
    once = kept.join(worded, is_worded, "left_semi").withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")
    return kept.join(worded, is_worded, "left_anti").unionByName(once).drop("__same")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents of which a twentieth of the words or more lie in 13-word windows of benchmark items."""
    from lodestone.llm.decontaminate import find_contamination

    marked = find_contamination(docs, table(spark, sf_dir, "benchmark"), into="__contamination")
    c = F.col("__contamination")
    return marked.where(~((c.n_hit > 0) & (c.n_hit * HIT_SHARE >= c.n_words))).drop("__contamination")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix of sources takes it: not at all, once or twice."""
    from lodestone.llm.mixing import copies_of, mix_plan

    _, plan = mix_plan(docs)
    return copies_of(plan, docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of all documents, read back."""
    import public_tokenizers

    from lodestone.llm.tokens import read_tokens, write_tokens

    path = new_dir(spark, "tokens")
    write_tokens(docs, path, str(public_tokenizers.path(TOKENIZER)), end_id=END_ID)
    return read_tokens(spark, path)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over documents."""
    docs = table(spark, sf_dir, "documents")
    base = new_dir(spark, "pipeline")
    for name, stage in STAGES[:-1]:
        with scratch(spark):  # what the stage kept for itself goes when its result is written
            stage(spark, docs, sf_dir).write.parquet(f"{base}/{name}")
        docs = spark.read.parquet(f"{base}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
