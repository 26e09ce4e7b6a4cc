from __future__ import annotations

import hashlib
import random
import re
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.llm import chat, langid, quality
from lodestone.llm.decontaminate import find_contamination
from lodestone.llm.linededup import LineRuns, drop_frequent_lines
from lodestone.llm.ngramjoin import ngram_join
from lodestone.llm.mixing import copies_of, mix_plan, mix_sources, source_targets
from lodestone.llm.tokens import read_tokens, write_tokens
from lodestone.llm.wordhash import ALNUM, NOT_SPACE, hash_words, string_buffers

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def ascii_lower(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("aAbZ09 \t\n\x0b\x1c.é  -"), max_size=30)), max_size=8))
def test_words_are_those_of_the_patterns(texts):
    import pyarrow as pa

    for word, pattern in ((NOT_SPACE, re.compile(r"[^\x20\x09-\x0D]+")), (ALNUM, WORD)):
        hashes, first = hash_words(*string_buffers(pa.array(texts, pa.string())), word)
        want = [pattern.findall(ascii_lower(t or "")) for t in texts]
        assert np.diff(first).tolist() == [len(w) for w in want]
        flat = [x for w in want for x in w]
        assert len({*zip(flat, hashes.tolist(), strict=True)}) == len(set(flat)) == len(set(hashes.tolist()))


def brute_contamination(texts, items):
    out = []
    for t in texts:
        w = WORD.findall(ascii_lower(t or ""))
        hit, ids = set(), set()
        for i, x in items:
            v = WORD.findall(ascii_lower(x or ""))
            n = min(13, len(v))
            for a in range(len(v) - n + 1 if n else 0):
                for s in range(len(w) - n + 1):
                    if w[s : s + n] == v[a : a + n]:
                        hit |= {*range(s, s + n)}
                        ids.add(str(i))
        out.append((len(w), len(hit), sorted(ids)))
    return out


@pytest.mark.parametrize("block_words", [500_000, 8])
def test_contamination(spark, docs, block_words):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(25)]
    items = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate([0, 1, 2, 3, 5, 12, 13, 14, 20, 40])] + [(10, None), (11, "W1, w2... W3!"), (3, "w5 w5 w5"), (12, "w1 " * 30)]
    texts = [None, "", "w1 w2 w3", "W1-w2-w3 w4", "w5 " * 9, "w1 " * 50] + [" ".join(rng.choices(words, k=40)) for _ in range(20)]
    texts += [f"intro {x.upper()}; outro" for _, x in items if x] + [f"{' '.join((x or '').split()[:13])} w9" for _, x in items]
    table = spark.createDataFrame(items, "item_id long, text string")
    frame = docs(texts).withColumn("n_words", F.lit(-1)).withColumn("contamination_0", F.lit("kept"))
    found = find_contamination(frame, table, into="found", block_words=block_words)
    assert set(frame.columns) | {"found"} == set(found.columns)
    got = [(r.found.n_words, r.found.n_hit, r.found.item_ids) for r in found.orderBy("doc_id").collect()]
    assert got == brute_contamination(texts, items)
    assert all(sum(s.end - s.start for s in r.found.spans) == r.found.n_hit for r in found.collect())
    empty = find_contamination(frame, table.limit(0)).select("contamination.*").agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(empty) == (0, len(texts))
    assert find_contamination(docs([]), table).count() == 0


def brute_lines(rows, threshold):
    key = lambda x: ascii_lower(x.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            held.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        ls = (t or "").split("\n")
        kept = [x for x in ls if not (key(x) and len(held[key(x)]) >= threshold)]
        out.append((i, len(ls), len(ls) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize(("threshold", "batches", "fan"), [(10, 4, 3), (3, 7, 2), (1, 1, 3)])
def test_frequent_lines(docs, threshold, batches, fan):
    rng = random.Random(threshold)
    pool = ["Home", " home\t", "HOME", "", "  ", "a\x0b", "é", "É", "unique"] + [f"l{i}" for i in range(30)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.choice([0, 1, 3, 8])))) for i in range(60)] + [(3, "home\nl1"), (3, "home\nl1"), (None, "home\nx"), (70, None)]
    found = drop_frequent_lines(docs([t for _, t in rows], [i for i, _ in rows]), threshold=threshold, batches=batches, fan=fan)
    got = sorted(((r.doc_id, r.line_dedup.n_lines, r.line_dedup.n_dropped, r.line_dedup.text_kept) for r in found.collect()), key=str)
    assert got == brute_lines(rows, threshold)
    assert drop_frequent_lines(docs([])).count() == 0


def test_runs_go_on_in_a_later_session(spark, tmp_path):
    """Batches added by one holder of the runs and by the next, against counts over all of them."""
    rng = random.Random(5)
    total = {}
    for b in range(9):
        docs_of = {k: rng.randrange(1, 4) for k in rng.sample(range(60), 25)}
        for k, n in docs_of.items():
            total[k] = total.get(k, 0) + n
        runs = LineRuns(spark.newSession() if b % 2 else spark, str(tmp_path / "runs"), threshold=6, fan=3)
        runs.add(runs.spark.createDataFrame([(k, k * 7, n) for k, n in docs_of.items()], "k1 long, k2 long, n long"))
        assert sorted(tuple(r) for r in runs.frequent().collect()) == sorted((k, k * 7) for k, n in total.items() if n >= 6)
        runs.close()
    again = LineRuns(spark, str(tmp_path / "runs"), threshold=6, fan=3)
    assert [(r.level, r.first, r.last) for r in again.runs] == [(2, 0, 8)]
    plan = again.table(again.runs[0]).select("k1", "k2").hint("merge").join(again._beside(again.runs[0], 1), ["k1", "k2"])._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "SortMergeJoin" in plan
    again.close()


def test_a_text_of_very_many_lines(docs):
    """Passed over once: a hundred thousand lines, half of which go."""
    n = 100_000
    long_text = "\n".join(f"line {i}" if i % 2 else "Same" for i in range(n))
    began = time.time()
    frame = docs([long_text, "same\nx", None]).withColumn("line_dedup", F.lit(3)).withColumn("pos", F.lit(1)).withColumn("d", F.lit(2))
    rows = {r.doc_id: r for r in drop_frequent_lines(frame, threshold=2).collect()}
    assert time.time() - began < 60
    assert rows[0].line_dedup.text_kept == "\n".join(f"line {i}" for i in range(1, n, 2)) and rows[0].line_dedup.n_dropped == n // 2
    assert (rows[1].line_dedup.text_kept, rows[2].line_dedup.text_kept, rows[1].pos) == ("x", "", 1)


def brute_targets(sizes):
    """Water filling by bisection on the level."""
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    low, high = 0.0, 10.0 * sum(sizes.values()) + 10
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(2 * sizes[s], mid * w[s]) for s in names) < 1.5 * sum(sizes.values()) else (low, mid)
    return {s: min(2 * sizes[s], low * w[s]) for s in names}


@pytest.mark.parametrize("sizes", [{"a": 100, "b": 100, "c": 100}, {"a": 1000, "b": 1, "c": 1, None: 5}, {"b": 10, "a": 500, "d": 3, "c": 77, "e": 0}, {"x": 9}, {"a": 10, "b": 1000, "c": 20, "d": 5000, "e": 9, "f": 100, "g": 1}])
def test_targets(spark, sizes):
    table = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r.source: r.target for r in source_targets(table).collect()}
    assert got == pytest.approx(brute_targets(sizes))


def test_mix(docs):
    rng = random.Random(8)
    texts = [None if i == 5 else " ".join("w" for _ in range(rng.choice([0, 1, 2, 30, 400] if i % 50 else [3000]))) for i in range(900)]
    source = [rng.choice(["big"] * 8 + ["a", "b", "Z", None]) for _ in texts]
    table = docs(texts, source=source)
    rows = mix_sources(table).collect()
    assert len(rows) == 900 and mix_sources(table).orderBy("doc_id").collect() == mix_sources(table.repartition(5)).orderBy("doc_id").collect()
    by = {}
    for r in rows:
        assert r["size"] == len((texts[r.doc_id] or "").split()) and r.taken in (0, r["size"], 2 * r["size"])
        got = by.setdefault(source[r.doc_id], [0, r.target, r.source_size, 0])
        got[0] += r.taken
        got[3] = max(got[3], r["size"])
    assert {s: x[1] for s, x in by.items()} == pytest.approx(brute_targets({s: x[2] for s, x in by.items()}))
    assert all(abs(x[0] - x[1]) <= x[3] for x in by.values())
    _, plan = mix_plan(table)
    copies = copies_of(plan, table)
    assert copies.columns == table.columns
    assert {r.doc_id: r["count"] * len((texts[r.doc_id] or "").split()) for r in copies.groupBy("doc_id").count().collect() if texts[r.doc_id]} == {r.doc_id: r.taken for r in rows if r.taken}
    assert mix_sources(docs([])).count() == 0


def test_chat(spark):
    rng = random.Random(6)
    bits = ["</s>", "[INST]", "[/INST]", "<|im_start|>", "<|im_end|>", "\\", "<\\|im_end|>", "<", "[", "\n", "assistant\n", "é", "x y"]
    convs, rows = {}, []
    for c in range(25):
        turns = [(rng.choice(["user", "assistant", "system", "a\\n\nb", "tool<|im_end|>"]), "".join(rng.choices(bits, k=rng.randrange(7)))) for _ in range(rng.randrange(1, 9))]
        convs[c] = turns
        rows += [(c, i, r, None if t == "" and i % 2 else t, "extra") for i, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    examples = chat.expand(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string"))
    got = {r.conv_id: r for r in chat.digest(examples).collect()}
    for c, turns in convs.items():
        loss = "".join(t for r, t in turns if r == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    for e in examples.collect():
        turns = convs[e.conv_id]
        marks = e.formatted.count("<|im_start|>")
        assert marks == e.formatted.count("<|im_end|>") == (len(turns) if e.target_turn is None else e.target_turn + 1)
        assert "</s>" not in e.formatted and "[INST]" not in e.formatted
        if e.target_turn is not None:
            assert turns[e.target_turn][0] == "assistant" and e.formatted[e.loss_end :] == "<|im_end|>\n"
    assert chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_tokens(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = str(public_tokenizers.path("word_bpe_49k.json"))
    rng = random.Random(1)
    bits = ["Hello", "wörld", "don't", "  ", "\n", "\t", "\x1c", " ", "<|endoftext|>", "12", "!!", "日本", "é", "x" * 50]
    rows = [(rng.randrange(500), "".join(rng.choices(bits, k=rng.randrange(12)))) for _ in range(200)] + [(7, None), (8, ""), (None, "null id"), (3, "same"), (3, "same")]
    table = docs([t for _, t in rows], [i for i, _ in rows])
    manifest = write_tokens(table, str(tmp_path / "out"), path, end_id=2, parts=5)
    got = sorted((tuple(r) for r in read_tokens(spark, str(tmp_path / "out"), ids=True).collect()), key=lambda r: r[1])
    t = Tokenizer.from_file(path)
    base = 0
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode()))
    for (i, text), r in zip(order, got, strict=True):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 2]
        assert r == (i, base, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        base += len(ids)
    assert manifest["width"] == 2 and sum(p["tokens"] for p in manifest["parts"]) == base
    write_tokens(docs([]), str(tmp_path / "none"), path, end_id=2)
    assert read_tokens(spark, str(tmp_path / "none")).count() == 0


def test_tokenizers_that_look_across_spaces(spark, docs, tmp_path, monkeypatch):
    """Byte-level rules take a space with the word behind it: whole texts are encoded. Words that were forgotten are encoded anew."""
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm import tokens

    texts = ["two  words\n\n and  more", " a", "", None, "a" * 3000, "don't  stop", "a.b c"] * 3
    for name, alone in (("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)):
        path = str(public_tokenizers.path(name))
        with open(path) as f:
            rules = f.read()
        assert tokens.words_stand_alone(json.loads(rules)) is alone
        own = Tokenizer.from_file(path)
        want = [[*own.encode(t or "", add_special_tokens=False).ids, 2] for t in texts]
        monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
        enc = tokens.Encoder(rules)
        for _ in range(2):
            flat, n = enc.encode(pa.array(texts), 2)
            assert flat.tolist() == [x for w in want for x in w] and n.tolist() == [len(w) for w in want]
        write_tokens(docs(texts), str(tmp_path / name), path, end_id=2, parts=3)
        got = {r.doc_id: r.ids for r in read_tokens(spark, str(tmp_path / name), ids=True).collect()}
        assert [got[i] for i in range(len(texts))] == want
    rules = json.loads(rules)
    for change in ({"normalizer": {"type": "Prepend", "prepend": "_"}}, {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Metaspace", "replacement": "_", "prepend_scheme": "always", "split": True}}):
        assert not tokens.words_stand_alone(rules | change)


def test_language(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = langid.train(table.where(~langid.held_out(F.col("doc_id"))))
    rows = langid.identify(table, model, keep=("doc_id", "lang")).where(langid.held_out(F.col("doc_id"))).collect()
    assert len(rows) > 30 and np.mean([r.lang == r.lang_pred for r in rows]) >= 0.95 and all(0 <= r.score <= 1 for r in rows)
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 !! \n"), (4, "the and of " * 60_000)], "doc_id long, text string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, model).collect()}
    assert got[1] == got[2] == got[3] == ("und", 0.0) and got[4][0] == "en"
    none = langid.train(table.limit(0))
    assert {r.lang_pred for r in langid.identify(odd, none).collect()} == {"und"}
    only = langid.train(table.where("lang = 'fr'").limit(20))
    assert {r.lang_pred for r in langid.identify(odd.where("doc_id = 4"), only).collect()} == {"fr"}


def test_pieces_of_a_text_count_as_the_whole(monkeypatch):
    text = "".join(random.Random(1).choices("abc éÉ \n1", k=3000))
    whole = langid.counts(text)
    for piece in (1, 2, 3, 7, 100):
        monkeypatch.setattr(langid, "PIECE", piece)
        assert (langid.counts(text) == whole).all(), piece


def test_calibration_lowers_the_loss():
    rng = np.random.default_rng(2)
    logits, y = rng.standard_normal((400, 3)) * 8, rng.integers(0, 3, 400)
    y[:250] = logits[:250].argmax(axis=1)
    t = langid.temperature(logits, y)
    loss = lambda t: -np.log(langid.softmax(logits / t)[np.arange(400), y]).mean()
    assert loss(t) < loss(1.0) and loss(t) <= min(loss(t * 1.1), loss(t / 1.1)) + 1e-9


def test_quality(spark, docs):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    part = labels.where("doc_id % 2 = 0")
    found = quality.classify(table, part, host=F.col("source"), path=F.concat_ws("/", "source", "lang"))
    rows = found.join(labels.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(rows) > 100 and np.mean([r.keep == bool(r.quality) for r in rows]) >= 0.97
    assert found.count() == table.count()
    odd = docs([None, "", "word"], source=[None, "s", "s"])
    none = quality.classify(odd, labels.limit(0), host=F.col("source"), path=F.col("source"))
    assert [r.keep for r in none.collect()] == [True] * 3
    some = quality.classify(table.unionByName(odd.select(*(c for c in table.columns if c in odd.columns)), allowMissingColumns=True), part, host=F.col("source"), path=F.col("source"))
    assert some.count() == table.count() + 3
    assert quality.classify(docs([]), part, host=F.col("source"), path=F.col("source")).count() == 0


def test_sparse_sites_shrink_toward_the_global_prior(spark):
    rows = [("big", "big/a", 0.95)] * 400 + [("bad", "bad/a", 0.05)] * 400 + [("one", "one/a", 0.05)]
    found = spark.createDataFrame(rows, "host string, path string, p double")
    sites, m, top, low = quality.posteriors(found)
    host = {r.host: (r.hs + top * m) / (r.hn + top) for r in sites.collect()}
    assert host["bad"] < 0.1 and host["big"] > 0.9 and host["bad"] < host["one"] < m and top >= 1 and low >= 1


def plain_counts(text):
    """Buckets of all 1- to 4-grams of the letters, in Python integers."""
    low = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in text).split()) + " "
    mask, out = (1 << 64) - 1, np.zeros(langid.BUCKETS, int)
    for n in langid.ORDERS:
        for i in range(len(low) - n + 1):
            h = 0
            for c in low[i : i + n]:
                h = (h * 0x9E3779B97F4A7C15 + (ord(c) + 1) * 0xC2B2AE3D27D4EB4F) & mask
            out[((h ^ (h >> 29)) * (0xBF58476D1CE4E5B9 + 2 * n) & mask) >> 49] += 1
    return out


def test_counts_and_predictions_are_the_plain_ones():
    rng = np.random.default_rng(2)
    texts = ["Hello, world!", "a", "été À ß", "one  two\nthree", "x1y2"]
    weights = rng.standard_normal((langid.BUCKETS, 3))
    model = langid.Model(["a", "b", "c"], rng.uniform(1, 3, langid.BUCKETS), weights, np.array([0.1, 0.0, -0.1]), 1.7)
    for t in texts:
        c = plain_counts(t)
        assert (langid.counts(t) == c).all()
        x = np.array([(1 + np.log(v)) * model.idf[i] if v else 0.0 for i, v in enumerate(c)])
        z = (x / np.linalg.norm(x) @ weights + model.bias) / 1.7
        p = np.exp(z) / np.exp(z).sum()
        lang, score = model.predict(t)
        assert lang == model.langs[int(p.argmax())] and score == pytest.approx(p.max())
    assert model.predict("12 .") == model.predict(None) == ("und", 0.0)


def test_ftrl_is_the_plain_one():
    """Against follow-the-regularised-leader written out a coordinate at a time."""
    rng = np.random.default_rng(4)
    rows = []
    for _ in range(60):
        y = int(rng.integers(3))
        at = np.sort(rng.choice(12, 4, replace=False)) + 12 * y * int(rng.random() < 0.8)
        rows.append((at, rng.uniform(0.2, 1, 4), y))
    z, n = {}, {}

    def weight(i, k):
        zi, ni = z.get((i, k), 0.0), n.get((i, k), 0.0)
        return 0.0 if abs(zi) <= langid.L1 else -(zi - np.sign(zi) * langid.L1) / ((langid.BETA + ni**0.5) / langid.ALPHA + langid.L2)

    for _ in range(2):
        for at, x, y in rows:
            feats = [*zip(at.tolist(), x.tolist(), strict=True), (langid.BUCKETS, 1.0)]
            w = {(i, k): weight(i, k) for i, _ in feats for k in range(3)}
            s = np.array([sum(v * w[i, k] for i, v in feats) for k in range(3)])
            p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
            for i, v in feats:
                for k in range(3):
                    g = v * (p[k] - (k == y))
                    old = n.get((i, k), 0.0)
                    z[i, k] = z.get((i, k), 0.0) + g - ((old + g * g) ** 0.5 - old**0.5) / langid.ALPHA * w[i, k]
                    n[i, k] = old + g * g
    got, bias = langid.fit(rows, 3, epochs=2)
    assert np.allclose(bias, [weight(langid.BUCKETS, k) for k in range(3)])
    for i in range(48):
        assert np.allclose(got[i], [weight(i, k) for k in range(3)])
    assert (got == 0).sum() > got.size - 200


def test_posteriors_are_the_plain_ones(docs):
    """Site posteriors and scores, worked out again from the documents' own evidence."""
    rng = random.Random(8)
    good = lambda: " ".join(rng.choices(["the", "and", "word", "green", "house", "river"], k=40)) + "."
    bad = lambda: "".join(rng.choices("$#@%!*", k=60)) + " " + "!" * 20
    n = 120
    texts = [good() if rng.random() < (0.9 if i % 4 else 0.2) else bad() for i in range(n)]
    frame = docs(texts, source=[None if i % 11 == 0 else f"h{i % 4}" for i in range(n)], lang=[f"p{i % 3}" for i in range(n)])
    labels = frame.select("doc_id", F.when(F.contains("text", F.lit("$")), 0).otherwise(1).alias("quality")).where("doc_id % 2 = 0")
    rows = quality.classify(frame, labels, host=F.col("source"), path=F.concat_ws("/", "source", "lang")).collect()
    assert len(rows) == n
    total, mean = len(rows), sum(r.p_text for r in rows) / len(rows)
    hosts, paths = {}, {}
    for r in rows:
        for group, key in ((hosts, r.host), (paths, (r.host, r.path))):
            a, b = group.get(key, (0, 0.0))
            group[key] = (a + 1, b + r.p_text)
    strength = lambda spread, chance: min(max(mean * (1 - mean) / max(spread - chance, 1e-6) - 1, 1.0), 1e6)
    top = strength(sum(k * (s / k - mean) ** 2 for k, s in hosts.values()) / total, len(hosts) * mean * (1 - mean) / total)
    prior = {h: (s + top * mean) / (k + top) for h, (k, s) in hosts.items()}
    low = strength(sum(k * (s / k - prior[h]) ** 2 for (h, _), (k, s) in paths.items()) / total, len(paths) * mean * (1 - mean) / total)
    logit = lambda x: np.log(x / (1 - x))
    for r in rows:
        (hn, hs), (pn, ps) = hosts[r.host], paths[r.host, r.path]
        host = (hs - r.p_text + top * mean) / (hn - 1 + top)
        site = min(max((ps - r.p_text + low * host) / (pn - 1 + low), 1e-9), 1 - 1e-9)
        p = min(max(r.p_text, 1e-9), 1 - 1e-9)
        score = 1 / (1 + np.exp(-(logit(p) + logit(site) - logit(mean))))
        assert r.p_site == pytest.approx(site, rel=1e-9) and r.score == pytest.approx(score, rel=1e-9) and r.keep == (score >= 0.5)


def test_very_long_texts(spark, docs):
    """Some hundred thousand words: read to the end by every operator."""
    n = 150_000
    words = [f"w{i * 7919 % 50_021}" for i in range(n)]
    long_text, item = " ".join(words), " ".join(f"item{i}" for i in range(20))
    texts = [long_text + " " + item, long_text + " " + item + " tail", "short text", None]
    frame = docs(texts)
    found, links = ngram_join(frame, k=4, num=85, den=100)
    assert {r.doc_id: r.component_id for r in found.collect()} == {0: 0, 1: 0, 2: 2, 3: 3} and links.count() == 1
    sizes = {r.doc_id: r["size"] for r in mix_sources(frame).collect()}
    assert sizes == {0: n + 20, 1: n + 21, 2: 2, 3: 0}
    hit = {r.doc_id: r.contamination.n_hit for r in find_contamination(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert hit == {0: 20, 1: 20, 2: 0, 3: 0}
    x = quality.features(*string_buffers(pa.array(texts)))
    assert x[0][0] == pytest.approx(np.log1p(n + 20)) and x[0][7] == pytest.approx((50_021 + 20) / (n + 20))
    talk = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", long_text)], "conv_id long, turn long, role string, text string")
    digest = chat.digest(chat.expand(talk)).first()
    assert digest.loss_chars == len(long_text) and digest.loss_sha256 == hashlib.sha256(long_text.encode()).hexdigest()


def test_words_met_again_stay_when_the_memory_of_words_is_full(monkeypatch):
    import public_tokenizers
    from tokenizers import Tokenizer

    from lodestone.llm import tokens

    with open(str(public_tokenizers.path("word_bpe_49k.json")), encoding="utf-8") as f:
        rules = f.read()
    monkeypatch.setattr(tokens, "CACHE_WORDS", 300)
    enc, own, asked = tokens.Encoder(rules), Tokenizer.from_str(rules), []
    monkeypatch.setattr(enc, "_ids", lambda words, f=enc._ids: asked.extend(words) or f(words))
    for n in range(40):
        text = " ".join([f"often{i}" for i in range(50)] + [f"once{n}x{i}" for i in range(40)])
        ids, _ = enc.encode(pa.array([text]), 2)
        assert ids.tolist() == [*own.encode(text, add_special_tokens=False).ids, 2]
        assert sum(map(len, enc.runs)) <= 300
    assert sum(w.startswith("often") for w in asked) == 50
