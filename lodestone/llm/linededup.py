"""Line dedup over levelled sorted runs of line hashes, on DataFrame functions alone.

A run is a stored table (k1, k2, n, frequent), bucketed and sorted by the 128-bit hash of a line's key: in
how many documents of its batches the key was, and whether it had reached the threshold by then. Documents
come in batches. A batch counts the documents of each of its keys, is merged with the runs there are, loses
the keys that a run knows as frequent (an anti-join), adds up what the runs hold of the others, and is
stored as a run of level 0. Buckets and order are the same in all runs, so this reads them as they lie,
without a shuffle. When `fan` runs of a level have gathered they are merged into one of the next level.
Each frequent key is marked in one run alone, and these marks are the result. Runs stay where they are
stored: a later session opens the folder again and adds the next batch.

A key is counted once a document and summed in each task before it is shuffled, so a line that a third
of all documents share is a few rows. Line numbers alone are joined to the documents.

Edge cases: a null or empty text is one empty line; keys shorter than `least_chars` are never dropped;
rows that share a doc_id are one document when documents are counted, and each row is edited on its own;
a null doc_id counts as one document; equal rows are edited alike; an empty table gives an empty result;
extra columns stay, and `into` names the one that is added, in place of an earlier one of that name. The
lines of a text of any length are passed over once; the text must fit a task a few times over. A document
must come in one batch: one that comes in two is counted twice.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm.common import lower_ascii, shuffle_width
from lodestone.scratch import cut, new_dir, remove, scratch, spread_join

SPACE = " \t\n\x0b\x0c\r"
DOCUMENTS = 10
BATCHES = 4
FAN = 3


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def key_of(line: Column) -> Column:
    bare = F.btrim(line, F.lit(SPACE))
    # the quick way for ASCII: beyond it, lower() changes other letters as well
    return F.when(F.octet_length(bare) == F.char_length(bare), F.lower(bare)).otherwise(lower_ascii(bare))


@dataclass(frozen=True)
class Run:
    """A stored run of the batches first to last."""

    level: int
    first: int
    last: int
    buckets: int

    @property
    def name(self) -> str:
        return f"run-{self.level}-{self.first}-{self.last}-{self.buckets}"


class LineRuns:
    """The levels of runs under a folder."""

    def __init__(self, spark: SparkSession, path: str, *, threshold: int = DOCUMENTS, fan: int = FAN):
        self.spark, self.path, self.threshold, self.fan = spark, path.rstrip("/"), threshold, fan
        self.tables: dict[Run, str] = {}
        self.runs = self._stored()
        self.buckets = self.runs[0].buckets if self.runs else shuffle_width(spark)

    def _stored(self) -> list[Run]:
        """The runs that were stored whole, less those that a merged run took in."""
        context = self.spark.sparkContext
        root = context._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(context._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        whole = [m for m in (re.fullmatch(r"run-(\d+)-(\d+)-(\d+)-(\d+)", n) for n in names) if m and fs.exists(context._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{m[0]}/_SUCCESS"))]
        found = [Run(*map(int, m.groups())) for m in whole]
        return sorted((r for r in found if not any(o.level > r.level and o.first <= r.first and r.last <= o.last for o in found)), key=lambda r: r.first)

    def table(self, run: Run) -> DataFrame:
        if run not in self.tables:
            name = f"lines_{uuid.uuid4().hex}"
            keys = f"CLUSTERED BY (k1, k2) SORTED BY (k1, k2) INTO {run.buckets} BUCKETS"
            self.spark.sql(f"CREATE TABLE {name} (k1 BIGINT, k2 BIGINT, n BIGINT, frequent BOOLEAN) USING PARQUET {keys} LOCATION '{self.path}/{run.name}'")
            self.tables[run] = name
        return self.spark.table(self.tables[run])

    def _store(self, rows: DataFrame, run: Run) -> None:
        name = f"lines_{uuid.uuid4().hex}"
        rows.write.format("parquet").mode("overwrite").bucketBy(self.buckets, "k1", "k2").sortBy("k1", "k2").option("path", f"{self.path}/{run.name}").saveAsTable(name)
        self.tables[run] = name

    def _beside(self, run: Run, i: int) -> DataFrame:
        return self.table(run).select("k1", "k2", F.col("n").alias(f"n{i}"), F.col("frequent").alias(f"f{i}")).hint("merge")

    def add(self, keys: DataFrame) -> None:
        """A batch (k1, k2, n), a row a key: n of its documents hold it."""
        rows = keys.repartition(self.buckets, "k1", "k2").sortWithinPartitions("k1", "k2")
        total, known = F.col("n"), F.lit(False)
        for i, run in enumerate(self.runs):
            rows = rows.join(self._beside(run, i), ["k1", "k2"], "left")
            total, known = total + F.coalesce(f"n{i}", F.lit(0)), known | F.coalesce(f"f{i}", F.lit(False))
        nth = self.runs[-1].last + 1 if self.runs else 0
        run = Run(0, nth, nth, self.buckets)
        self._store(rows.where(~known).select("k1", "k2", "n", (total >= self.threshold).alias("frequent")), run)
        self.runs.append(run)
        self._compact()

    def _compact(self) -> None:
        while len(last := self.runs[-self.fan :]) == self.fan and len({r.level for r in last}) == 1:
            rows = None
            for i, run in enumerate(last):
                rows = self._beside(run, i) if rows is None else rows.join(self._beside(run, i), ["k1", "k2"], "full_outer")
            n = sum((F.coalesce(f"n{i}", F.lit(0)) for i in range(self.fan)), F.lit(0).cast("long"))
            frequent = F.coalesce(*(F.when(F.col(f"f{i}"), True) for i in range(self.fan)), F.lit(False))
            merged = Run(last[0].level + 1, last[0].first, last[-1].last, self.buckets)
            self._store(rows.select("k1", "k2", n.alias("n"), frequent.alias("frequent")), merged)
            self.runs[-self.fan :] = [merged]
            for run in last:
                self._forget(run)
                remove(self.spark, f"{self.path}/{run.name}")

    def frequent(self) -> DataFrame:
        """Keys (k1, k2) in at least threshold documents, each once."""
        out = self.spark.range(0).select(F.col("id").alias("k1"), F.col("id").alias("k2"))
        for run in self.runs:
            out = out.unionByName(self.table(run).where("frequent").select("k1", "k2"))
        return out

    def _forget(self, run: Run) -> None:
        if run in self.tables:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.tables.pop(run)}")

    def close(self) -> None:
        """Takes the runs out of the session's catalog; their files stay."""
        for run in list(self.tables):
            self._forget(run)


def line_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(d, same, pos, k1, k2, len): a row a line, without the line itself; same tells rows that share a doc_id apart."""
    lines = docs.select(F.col(doc_id).alias("d"), F.xxhash64(F.col(text)).alias("same"), F.posexplode(lines_of(F.col(text))).alias("pos", "line"))
    keyed = lines.select("d", "same", "pos", key_of(F.col("line")).alias("key"))
    return keyed.select("d", "same", "pos", F.xxhash64("key").alias("k1"), F.xxhash64(F.lit(1), "key").alias("k2"), F.char_length("key").alias("len"))


def key_counts(rows: DataFrame) -> DataFrame:
    """(k1, k2, n): documents that hold each key."""
    return rows.select("d", "k1", "k2").distinct().groupBy("k1", "k2").agg(F.count("*").alias("n"))


def drop_frequent_lines(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", threshold: int = DOCUMENTS, least_chars: int = 1, batches: int = BATCHES, fan: int = FAN, into: str = "line_dedup") -> DataFrame:
    """docs with text_kept (the other lines joined by a newline), n_lines and n_dropped in the struct column `into`."""
    spark = docs.sparkSession
    docs = docs.drop(into)
    with scratch(spark) as keep:
        batch = F.pmod(F.xxhash64("d"), F.lit(batches)).cast("int")
        rows = cut(line_rows(docs, doc_id, text).where((F.col("len") >= least_chars) | (F.col("pos") == 0)).withColumn("batch", batch), by="batch")
        long_enough = rows.where(F.col("len") >= least_chars)
        runs = LineRuns(spark, new_dir(spark, "runs"), threshold=threshold, fan=fan)
        for b in range(batches):
            runs.add(key_counts(long_enough.where(F.col("batch") == b)))
        gone = spread_join(long_enough.select("d", "same", "pos", "k1", "k2"), cut(runs.frequent()), ["k1", "k2"], "left_semi")
        gone = keep(gone.groupBy("d", "same").agg(F.sort_array(F.collect_set("pos")).alias("__ld_gone")))
        every = keep(rows.where("pos = 0").select("d", "same"))
        runs.close()

    def keyed(df: DataFrame, d: Column, same: Column) -> DataFrame:
        return df.withColumns({"__ld_d": F.coalesce(d.cast("string"), F.lit("")), "__ld_none": d.isNull(), "__ld_same": same})

    on = ["__ld_d", "__ld_none", "__ld_same"]
    by_row = keyed(gone, F.col("d"), F.col("same")).select(*on, "__ld_gone")
    out = spread_join(keyed(docs, F.col(doc_id), F.xxhash64(F.col(text))), by_row, on, "left", counted=keyed(every, F.col("d"), F.col("same")), broadcast=False)
    lines, at = lines_of(F.col(text)), F.col("__ld_gone")
    # a flag a line, up to the last one that goes: as many that stay as lie between two that go
    steps = F.transform(at, lambda p, i: p - F.coalesce(F.get(at, i - 1), F.lit(-1)))
    flags = F.flatten(F.transform(steps, lambda n: F.concat(F.array_repeat(F.lit(False), n - 1), F.array(F.lit(True)))))
    left = F.zip_with(lines, flags, lambda x, goes: F.when(F.coalesce(goes, F.lit(False)), F.lit(None)).otherwise(x))  # nulls are passed over when joined
    kept = F.when(at.isNull(), F.coalesce(F.col(text), F.lit(""))).otherwise(F.array_join(left, "\n"))
    done = F.struct(kept.alias("text_kept"), F.size(lines).cast("long").alias("n_lines"), F.coalesce(F.size(at), F.lit(0)).cast("long").alias("n_dropped"))
    return out.select(*(F.col(f"`{c}`") for c in docs.columns), done.alias(into))
