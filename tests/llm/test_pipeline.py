from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as P

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The input and the output of every stage, each written and read again."""
    base = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{DIR}/documents.parquet").withColumn("extra", F.lit("e"))
    out = [("documents", docs)]
    for name, f in P.STAGES:
        f(spark, out[-1][1], DIR).write.parquet(str(base / name))
        out.append((name, spark.read.parquet(str(base / name))))
    return dict(out)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def shingled(t):
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_columns(stages):
    for name, _ in P.STAGES[:-1]:
        assert stages[name].columns == stages["documents"].columns
    assert stages["tokens"].columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "tokens"]


def test_quality_rejects_bad_documents_alone(spark, stages):
    kept = {r.doc_id for r in stages["quality"].collect()}
    labels = spark.read.parquet(f"{DIR}/labels.parquet").collect()
    assert all((r.doc_id in kept) == bool(r.quality) for r in labels)


def test_one_of_each_group_stays(stages):
    before = {r.doc_id: shingled(r.text) for r in stages["quality"].collect()}
    comp = {i: i for i in before}
    links = [(a, b) for a in comp for b in comp if a < b and before[a] and before[b] and 10 * len(before[a] & before[b]) >= 8 * len(before[a] | before[b])]
    for _ in range(20):
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    assert sorted(r.doc_id for r in stages["near_duplicates"].collect()) == sorted(set(comp.values()))


def test_contaminated_documents_go(spark, stages):
    items = [r.text for r in spark.read.parquet(f"{DIR}/benchmark.parquet").collect()]
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    windows = {tuple(w[i : i + 13]) if len(w) >= 13 else tuple(w) for t in items if (w := split(t)) for i in range(max(1, len(w) - 12))}
    want = []
    for r in stages["near_duplicates"].collect():
        w, hit = split(r.text), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= {*range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            want.append(r.doc_id)
    assert sorted(r.doc_id for r in stages["decontamination"].collect()) == sorted(want)


def test_mix_is_half_as_large_again(stages):
    size = lambda name: sum(len(words(r.text)) for r in stages[name].collect())
    assert size("mixing") == pytest.approx(1.5 * size("decontamination"), rel=0.1)
    assert stages["mixing"].groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2


def test_tokens_cover_the_mix(stages):
    rows = stages["tokens"].orderBy("start").collect()
    assert [r.doc_id for r in rows] == sorted(r.doc_id for r in stages["mixing"].collect())
    assert all(a.start + a.n_tokens == b.start for a, b in zip(rows, rows[1:], strict=False)) and rows[0].start == 0


def test_odd_rows_pass_all_stages(spark, tmp_path):
    docs = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b c", "en", "s", 5), (3, "a b c", "en", "s", 5), (None, "x y", "en", None, 3)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame, tag in ((docs, "odd"), (docs.limit(0), "empty")):
        for name, f in P.STAGES:
            f(spark, frame, DIR).write.parquet(str(tmp_path / tag / name))
            frame = spark.read.parquet(str(tmp_path / tag / name))
        if tag == "empty":
            assert frame.count() == 0


def test_texts_that_share_an_id_go_by_their_own_copies(spark):
    text = lambda x: " ".join(f"{x}{i}" for i in range(30))
    rows = [(1, text("a"), "s"), (2, text("a"), "s"), (2, text("b"), "s"), (2, text("c"), "z"), (2, text("c"), "y"), (3, text("b"), "s"), (4, text("d"), "s"), (5, "", "s"), (5, text("a") + " end", "s"), (None, text("a"), "s")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = [(1, text("a"), "s"), (2, text("b"), "s"), (2, text("c"), "y"), (4, text("d"), "s"), (5, "", "s"), (None, text("a"), "s")]
    for part in (docs, docs.orderBy(F.desc("source"), F.desc("text"))):
        assert sorted(map(tuple, P.near_duplicates(spark, part, DIR).collect()), key=str) == sorted(want, key=str)
